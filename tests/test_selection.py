import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import selection


def _brute(values, rank):
    own = sorted(values)
    v = own[rank]
    return selection.Place(v, sum(x < v for x in own), sum(x == v for x in own))


@pytest.mark.parametrize(("few", "kind"), [(selection.FEW, "double"), (40, "double"), (40, "long"), (selection.FEW, "long")])
def test_places_equal_sorting(spark, few, kind):
    rng = random.Random(few)
    made = {
        0: [rng.gauss(0, 1) for _ in range(3000)], 1: [float(rng.randrange(4)) for _ in range(2500)], 2: [7.0] * 900, 3: [1e300 * rng.random() for _ in range(50)] + [0.0] * 1000 + [-1e-300] * 30,
        4: [5.0], 5: [float(k) for k in range(2000)] + [1000.0] * 2000,
    }
    if kind == "long":
        made = {g: [int(x % (1 << 62)) if abs(x) > 1e17 else int(x * 1000) - (1 << 61) for x in own] for g, own in made.items()}
    rows = spark.createDataFrame([(g, x) for g, own in made.items() for x in own], f"g int, v {kind}").repartition(5)
    ranks = {g: sorted({0, len(own) - 1, len(own) // 2, len(own) // 3, len(own) * 9 // 10}) for g, own in made.items()}
    found = selection.order_statistics(rows, "g", "v", ranks, few=few)
    assert found == {(g, r): _brute(made[g], r) for g, own in ranks.items() for r in own}


def test_a_bad_sketch_is_noticed(spark):
    """The sketch of other values bounds the wrong rows; the counts tell."""
    rows = spark.createDataFrame([(1, float(x)) for x in range(5000)], "g int, v double")
    wrong = selection.sketches(rows.where("v < 100"), "g", "v")
    found = selection.order_statistics(rows, "g", "v", {1: [10, 4321]}, known={1: (5000, wrong[1][1])})
    assert found == {(1, 10): selection.Place(10.0, 10, 1), (1, 4321): selection.Place(4321.0, 4321, 1)}


def test_no_ranks_and_no_sort(spark):
    rows = spark.range(1000).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    assert selection.order_statistics(rows, "g", "v", {}) == {} and selection.order_statistics(rows, "g", "v", {"0": []}) == {}
    assert selection.order_statistics(rows, "g", "v", {"1": [3]})["1", 3] == selection.Place(7.0, 3, 1)
