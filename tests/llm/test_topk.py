import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import topk


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    got = topk.op2_topk(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(topk.SQL_OP2).fetchall())


def test_odd_rows(spark):
    rows = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, -1.0]), (3, [1.0]), (60, []), (4, []), (5, None), (80, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 2.0]), (100, [7.0, 7.0, 7.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = topk.exact_topk(frame, F.col("vec_id") % 20 == 0, 3, "vec_id", "embedding", 64.0)
    assert sorted(map(tuple, got.collect())) == [(20, 1, 1, 20480), (20, 2, 40, 20480), (20, 3, 2, -8192), (40, 1, 1, 20480), (40, 2, 20, 20480), (40, 3, 2, -8192), (60, 1, 4, 0)]
    assert topk.exact_topk(frame.limit(0), F.lit(True), 3, "vec_id", "embedding").count() == 0


def test_pruning_against_brute_force():
    rng = np.random.default_rng(2)
    for dim, spread, repeats in ((64, 10, 1), (7, 3, 1), (1, 2, 1), (64, 1 << 24, 1), (16, 40, 25)):
        x = np.floor(rng.normal(size=(500, dim)) * spread)
        if repeats > 1:  # close groups of long and short vectors: the bounds leave few survivors
            x = np.floor(np.repeat(x[: 500 // repeats] * rng.choice([1, 30], (500 // repeats, 1)), repeats, 0) + rng.normal(size=(500, dim)))
        ids = rng.permutation(500).astype(np.int64)
        full = x.astype(np.int64).astype(object) @ x.T.astype(np.int64).astype(object)
        best = topk.Best(ids[:40], x[:40], 20)
        order = np.argsort(-np.sqrt((x**2).sum(1)))
        for at in range(0, 500, 70):
            own = order[at : at + 70]
            best.offer(ids[own], x[own], float(np.sqrt((x[own] ** 2).sum(1)).max()))
        got = best.told().to_pandas()
        for i in range(40):
            want = sorted((-full[i, j], ids[j]) for j in range(500) if j != i)[:20]
            mine = got[got.query_id == ids[i]]
            assert mine["rank"].tolist() == list(range(1, 21))
            assert [(-b, a) for a, b in zip(mine.vec_id, mine.score, strict=True)] == want
    with pytest.raises(OverflowError):
        topk.exact_scores(np.full((1, 2), 2.0**32), np.full((1, 2), 2.0**32))


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, y = np.floor(rng.normal(size=(200, 50)) * 20), np.floor(rng.normal(size=(100, 50)) * 20)
    exact = x @ y.T
    coarse, fine = ((topk.segment_statistics(x, p) @ topk.segment_statistics(y, p).T) for p in topk.RESOLUTIONS)
    assert (coarse >= exact - 1e-6).all() and (fine >= exact - 1e-6).all() and fine.mean() < coarse.mean()


def test_vectors_equal_after_rounding_down(spark):
    frame = spark.createDataFrame([(20, [1.001]), (20, [1.002]), (3, [2.001]), (3, [2.002])], "vec_id long, embedding array<double>")
    got = topk.exact_topk(frame, F.col("vec_id") % 20 == 0, 3, "vec_id", "embedding", 64.0)
    assert sorted(map(tuple, got.collect())) == [(20, 1, 3, 64 * 128)]


def test_bounds_prune_where_vectors_have_structure():
    """Piecewise smooth vectors of a few groups: with the k-th scores known, under a tenth of the pairs get exact scores."""
    rng = np.random.default_rng(5)
    middles = np.repeat(rng.normal(0, 1, (40, 16)), 4, axis=1)
    x = np.floor(64 * (middles[np.arange(4000) % 40] + rng.normal(0, 0.05, (4000, 64))))
    best = topk.Best(np.arange(0, 4000, 20), x[::20], 20)
    for a in range(0, 4000, 500):
        best.offer(np.arange(a, a + 500), x[a : a + 500], float(np.sqrt((x**2).sum(1)).max()))
    alive, shares = np.ones((len(best.ids), len(x)), bool), []
    for mine, parts in zip(best.statistics, topk.RESOLUTIONS, strict=True):
        alive &= mine @ topk.segment_statistics(x, parts).T >= best.least[:, None] - 1e-6
        shares.append(alive.mean())
    exact = best.q @ x.T
    assert shares[0] < 0.25 and shares[1] < 0.1 and alive[exact >= best.least[:, None]].all()
