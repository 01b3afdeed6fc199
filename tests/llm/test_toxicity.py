import math
from random import Random

import pytest
from pyspark.sql import functions as F

from riskframe.llm import store, toxicity

DOCS = "doc_id long, text string, lang string, score string, statistic int"


def _all_maximal(x: list[float]) -> list[tuple[int, int, float]]:
    """By definition: the best segment (the shortest of equals), then what is left of it and right of it."""

    def find(a: int, b: int) -> list:
        best = max(((sum(x[i : j + 1]), i - j, -i, i, j) for i in range(a, b) for j in range(i, b)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3:]
        return [*find(a, i), (i, j, best[0]), *find(j + 1, b)]

    return find(0, len(x))


@pytest.mark.parametrize("seed", range(30))
def test_segments_equal_the_definition(seed):
    rng = Random(seed)
    n, drift = rng.randrange(1, 40), -0.30078125
    x = [round(rng.uniform(-2, 3) * 64) / 64 + 1 / 1024 * k if rng.random() < 0.4 else drift for k in range(n)]
    places = [k for k in range(n) if x[k] != drift]
    found = toxicity.segments(places, [x[k] for k in places], drift)
    want = _all_maximal(x)
    assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
    assert all(math.isclose(s, t, abs_tol=1e-9) for (_, _, s), (_, _, t) in zip(found, want, strict=True))


def test_segments_of_long_descents_are_found_quickly():
    assert len(toxicity.segments(list(range(0, 400_000, 2)), [1.0] * 200_000, -1.5)) == 200_000


def test_curve_rises_and_is_flat_in_pooled_blocks():
    x, v = toxicity.fitted_curve([(0.0, 5, 95), (1.0, 1, 9), (2.0, 0, 10), (5.0, 9, 1), (6.0, 10, 0)], 0.2)
    assert list(v) == sorted(v) and v[0] < 0.1 and v[-1] > 0.9 and x[0] == 0.0


def _made(seed: int, n: int = 400):
    """Documents in two languages of made words; toxic ones hold words that begin with one of three stems."""
    rng = Random(seed)
    word = lambda: "".join(rng.choice("abdeghilnorstu") for _ in range(rng.randrange(2, 9)))
    common = [word() for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        words, bad = [rng.choice(common) if rng.random() < 0.7 else word() for _ in range(rng.randrange(40, 200))], k % 5 == 0
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zork", "Vyxen", "qumf"]) + rng.choice(["", "ed", "ing,", "ös!"]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return docs, labels


def test_learns_stems_and_finds_passages(spark):
    docs, labels = _made(1)
    made = spark.createDataFrame([(k, t, "xx", "y", 3) for k, t in docs], DOCS)
    marks = spark.createDataFrame([(k, 1, b) for k, b in labels], "doc_id long, quality int, toxic int")
    model = toxicity.train(toxicity.with_labels(made, marks))
    assert model.token_score("Zorking!") > 2 and model.token_score("vyxen.") > 2 and math.isnan(model.token_score("nothing"))
    scored = {r.doc_id: r.score for r in toxicity.predict(made, model).collect()}
    held = {r[0] for r in made.where(toxicity.held_out_third(F.col("doc_id"))).select("doc_id").collect()}
    assert 50 < len(held) < 200
    assert all((scored[k] >= 0.7) == bool(b) for k, b in labels if k in held)
    texts = dict(docs)
    for r in toxicity.toxic_passages(made, model).collect():
        passage = texts[r.doc_id][r.start : r.end].lower()
        assert r.doc_id % 5 == 0 and passage.startswith(("zork", "vyxen", "qumf")) and r.expected <= toxicity.SIGNIFICANT


def test_copies_do_not_teach(spark):
    """One clean text that is toxic by its label, copied 300 times, teaches nothing about its words."""
    docs, labels = _made(2)
    copied = docs[1][1] + " unrepeatable oddity"
    docs += [(k, copied) for k in range(10_000, 10_300)]
    labels += [(k, 1) for k in range(10_000, 10_300)]
    rows = spark.createDataFrame([(t, b) for (_, t), (_, b) in zip(docs, labels, strict=True)], "text string, toxic int")
    uses = {r.word: (r.toxic, r.clean) for r in toxicity.word_uses(rows).collect()}
    assert uses["oddity"] == (1, 0) and uses["unrepeatable"] == (1, 0)


def test_nulls_empty_clashes_and_repeats(spark):
    docs, labels = _made(3)
    docs = [(k, t, "xx", "s", 1) for k, t in docs] + [(900, None, None, None, None), (901, "", "xx", "s", 1), (902, "123 ... 456", "xx", "s", 1), (None, "zorked zorking vyxen qumf", "xx", "s", 1), (0, docs[0][1], "xx", "s", 1), (903, "lonely " * 50_000 + "zorked qumfing vyxened zorking qumf vyxen", "xx", "s", 1)]
    made = spark.createDataFrame(docs, DOCS)
    marks = spark.createDataFrame([(k, None, b) for k, b in labels] + [(None, 1, 1), (900, 1, 0), (1, 1, None), (5, 0, 0), (5_000, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(toxicity.with_labels(made, marks))
    out = toxicity.predict(made, model, carry=("doc_id", "score", "statistic"))
    assert out.columns == ["doc_id", "score_in", "statistic", "score"]
    rows = out.collect()
    assert len(rows) == len(docs)
    told = {r.doc_id: r.score for r in rows}
    assert told[900] == told[901] == told[902] < 0.3 and told[None] >= 0.7 and told[903] >= 0.7
    assert len({r.score for r in rows if r.doc_id == 0}) == 1


def test_nothing_to_learn(spark):
    made = spark.createDataFrame([(k, "some words here", "xx", "s", 1) for k in range(9)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for marks, want in ((none, 0.0), (spark.createDataFrame([(k, 1, 1) for k in range(9)], none.schema), 1.0), (spark.createDataFrame([(k, 1, 0) for k in range(9)], none.schema), 0.0)):
        model = toxicity.train(toxicity.with_labels(made, marks))
        assert {r.score for r in toxicity.predict(made, model).collect()} == {want}
        assert toxicity.toxic_passages(made, model).count() == 0
    empty = made.where("false")
    assert toxicity.predict(empty, toxicity.train(toxicity.with_labels(empty, none))).count() == 0


def test_held_out_documents_of_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    labels = store.table(spark, sf, "labels").select("doc_id", "toxic")
    rows = toxicity.op13_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == 1 for r in rows if r.toxic == 1)
    assert right >= 0.7 * sum(r.toxic == 1 for r in rows) and sum(r.predicted == 1 for r in rows if r.toxic == 0) <= 1
