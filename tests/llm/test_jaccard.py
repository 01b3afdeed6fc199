import random

import duckdb
import numpy as np
import pyarrow as pa

from riskframe.llm import graph, jaccard


def brute(rows):
    def grams(text):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}

    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted([(i, len(sets[k]), low.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)], key=str)


def corpus(seed, families, copies, length):
    rng, rows = random.Random(seed), []
    passage = [f"p{k}" for k in range(60)]
    for f in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(4, length))] + (passage if f % 3 == 0 else [])
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(base) // 30])):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10000)}"
            rows.append(" ".join(text).title() if rng.random() < 0.3 else "\n".join(text))
    rng.shuffle(rows)
    return [(3 * k, t) for k, t in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, node string, n int")


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHARD", 8)
    monkeypatch.setattr(jaccard, "QUERIES", 5)
    monkeypatch.setattr(jaccard, "CLASSES", 6)
    rows = corpus(1, 60, 12, 150)
    rows += [(None, None), (1, ""), (2, " \t\n"), (4, "one"), (5, "ONE "), (None, "one"), (7, "one two"), (8, rows[0][1]), (8, rows[0][1]), (None, rows[1][1]), (9, "z " * 5000), (None, "only null ids"), (None, "only null ids")]
    got = jaccard.jaccard_classes(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert jaccard.jaccard_classes(frame(spark, rows[:1]).limit(0)).count() == 0


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = jaccard.op6_jaccard(spark, "/root/testdata/sf0.001")
    rel = con.sql(jaccard.SQL_OP6)
    assert rel.columns == got.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def test_divide_skip_finds_all():
    rng, sim = np.random.default_rng(3), jaccard.Similarity(80)
    base = np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[rng.random(len(base)) > d], rng.integers(0, 1 << 60, int(40 * d)).astype(np.uint64)))) for d in rng.random(60) * 0.3]
    shard = jaccard.Shard(sets, sim)
    for s in sets:
        want = {k for k, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o))}
        assert set(shard.search(s, np.zeros(len(sets), bool))) == want


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 7), (200, 201), (202, 201), (5, 5)]
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 31)}, 100: 0, 201: 200, 202: 200}


def test_fewer_words_than_a_shingle():
    for width in range(1, 8):
        for n in range(10):
            text = " ".join("abcdefghij"[:n])
            own = jaccard.shingle_sets(pa.array([text]), width)[0]
            assert len(own) == (n - width + 1 if n >= width else min(n, 1))
            # alone in a batch or not, a text has the same set
            assert np.array_equal(own, jaccard.shingle_sets(pa.array(["x y z " * 4, text, None]), width)[1])
