import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskframe.llm import lm
from riskframe.llm.lattice import START, Lattice

FILE = public_tokenizers.path("piece_bpe_32k.model")


def all_ways(word, weights, spelled):
    """Sum over every segmentation, one by one."""
    if not word:
        return 1.0
    total = spelled[word[0]] * all_ways(word[1:], weights, spelled)
    return total + sum(weights[word[:k]] * all_ways(word[k:], weights, spelled) for k in range(1, len(word) + 1) if word[:k] in weights)


def test_forward_and_backward_against_enumeration():
    pieces = [START, START + "a", "a", "b", "ab", "aba", "bb", "é", START + "ab"]
    p = np.array([0.1, 0.05, 0.2, 0.1, 0.1, 0.05, 0.1, 0.1, 0.1])
    bytes_ = np.full(256, 0.1 / 256)
    lattice, weights = Lattice(pieces, np.log(p), np.log(bytes_)), dict(zip(pieces, p, strict=True))
    words = ["a", "abab", "bba", "é", "zé", "ababababab", "", "a"]
    spelled = {c: float(np.prod(bytes_[list(c.encode())])) for c in START + "abéz"}
    want = [all_ways(START + w, weights, spelled) for w in words]
    assert np.allclose(10 ** lattice.log10(words), want)
    # expected counts are the derivatives of the log-likelihood by the log weights
    counts = np.array([2.0, 1, 3, 1, 1, 1, 1, 1])
    got = lattice.expected(words, counts)
    for k, piece in enumerate(pieces):
        up = {**weights, piece: weights[piece] * 1.000001}
        slope = sum(c * (math.log(all_ways(START + w, up, spelled)) - math.log(x)) for w, x, c in zip(words, want, counts, strict=True)) / math.log(1.000001)
        assert got[k] == pytest.approx(slope, abs=1e-3)


def brute(rows, held):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    c = Counter(w for (i, t), h in zip(rows, held, strict=True) if not h for w in split(t))
    n, v = sum(c.values()), len(c)
    return [(i, h, len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t))) for (i, t), h in zip(rows, held, strict=True)]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 20000)
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in table] + [(None, None), (7_000_001, ""), (7_000_002, "\x0b \x0cA\x1cB É日本 \t"), (7_000_003, "q" * 20000), (table[0]["doc_id"], table[0]["text"])]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    frame = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, word string, score double").repartition(3)
    got = lm.score_texts(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, FILE).collect()
    want = {(w[0], w[2]): w for w in brute(rows, held)}
    assert len(got) == len(rows)
    for r in got:
        w = want[r[0], r[2]]
        assert r[:5] == w[:5] and r.base_score == pytest.approx(w[5], rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    # what was learned makes held-out texts likelier than the prior alone
    prior = {r.doc_id: r.score for r in lm.score_texts(frame, F.lit(True), FILE).collect()}
    test = [r for r in got if r.held_out]
    assert test and sum(r.score for r in test) > sum(prior[r.doc_id] for r in test)


def test_no_training_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(lm.score_texts(frame, F.lit(True), FILE).collect())
    assert [r.n_known for r in got] == [0, 0] and all(math.isfinite(r.score) for r in got)
    assert got[0].base_score == pytest.approx(3 * math.log10(0.1 / 0.1))
    assert lm.score_texts(frame.limit(0), F.lit(True), FILE).count() == 0


def segmentations(word, pieces):
    """Every way to spell a word: lists of pieces, bytes as numbers."""
    if not word:
        return [[]]
    heads = [[b for b in word[0].encode()]] + [[word[:k]] for k in range(1, len(word) + 1) if word[:k] in pieces]
    return [head + rest for head in heads for rest in segmentations(word[sum(len(x) for x in head) if isinstance(head[0], str) else 1 :], pieces)]


@pytest.mark.parametrize("passes", [0, 1, 2])
def test_score_against_enumeration(spark, passes):
    """Prior from ranks, expected counts, forward recursion: all of it again by listing every segmentation."""
    train, texts = ["a b ab", "the cat é", "ab ab"], {1: "a b ab", 2: "the cat é", 3: "ab ab", 11: "the é", 12: "cab", 13: "", 14: None, 15: "zq"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_texts(frame, F.col("doc_id") > 10, FILE, passes=passes).collect()}
    pieces, prior, bytes_, end = lm.read_pieces(FILE)
    assert prior.sum() + bytes_.sum() + end == pytest.approx(1)
    first = dict(zip(pieces, prior, strict=True)) | dict(enumerate(bytes_)) | {"end": end}
    weights, ways = first, {}

    def weighed(word):
        ways.setdefault(word, segmentations(START + word, set(pieces)))
        return [(way, math.prod(weights[x] for x in way)) for way in ways[word]]

    for _ in range(passes):
        counts = Counter({"end": len(train)})
        for word in " ".join(train).split():
            every = weighed(word)
            for way, w in every:
                for x in way:
                    if isinstance(x, str):
                        counts[x] += w / sum(v for _, v in every)
        whole = sum(counts.values()) + lm.PRIOR_MASS
        weights = {x: (counts[x] + lm.PRIOR_MASS * p) / whole for x, p in first.items()}
    for k, text in texts.items():
        want = sum(math.log10(sum(v for _, v in weighed(w))) for w in (text or "").split()) + math.log10(weights["end"])
        assert got[k] == pytest.approx(want, rel=1e-9)


def test_text_above_a_batch(spark, monkeypatch):
    rows = [(k, f"word{k} " * 400) for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = sorted(lm.score_texts(frame, F.lit(False), FILE).collect())
    monkeypatch.setattr(lm, "BATCH", 1000)
    cut = sorted(lm.score_texts(frame, F.lit(False), FILE).collect())
    assert [r[:5] for r in cut] == [r[:5] for r in whole] and np.allclose([r.score for r in cut], [r.score for r in whole])
