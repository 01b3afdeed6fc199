from hashlib import sha256

import numpy as np
import pytest

from riskframe.llm import codes

VECTORS = "vec_id long, embedding array<double>, label int, row string, code int"


def _brute(vectors: list[tuple], scale: int, entries: int, rounds: int) -> list[tuple]:
    """vectors: (id, components, label). Every part against every entry, in Python's integers."""
    ints = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    for dim in {len(v) for _, v, _ in ints}:
        own, cut = [r for r in ints if len(r[1]) == dim], codes.cuts(dim)
        parts = [[tuple(v[a:b]) for a, b in zip(cut, cut[1:], strict=False)] for _, v, _ in own]
        books = [[p[k] for p in parts[:entries]] for k in range(4)]
        best = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), e) for e, c in enumerate(book))
        for _ in range(rounds):
            for k, book in enumerate(books):
                groups = {}
                for p in parts:
                    groups.setdefault(best(p[k], book)[1], []).append(p[k])
                for e, members in groups.items():
                    book[e] = tuple(sum(xs) // len(members) for xs in zip(*members, strict=True))
        digest = sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
        for (i, _, label), p in zip(own, parts, strict=True):
            found = [best(p[k], books[k]) for k in range(4)]
            out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label, digest))
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    return sorted(((i, c, e, sums[label], d) for i, c, e, label, d in out), key=str)


def _coded(spark, vectors, **how):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in vectors], VECTORS)
    return sorted((tuple(r) for r in codes.vector_codes(df, **how).collect()), key=str)


def test_equal_to_every_part_against_every_entry(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, rng.normal(0, 0.2, 10).tolist(), int(k % 3)) for k in range(150)] + [(k, rng.normal(0, 0.2, 8).tolist(), None) for k in range(1000, 1040)]
    assert _coded(spark, vectors, entries=9) == _brute(vectors, 1024, 9, 4)


def test_nulls_repeats_short_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, None, 1), (2, [0.1, None, 0.2, 0.3], 1), (3, [nan] * 4, 1), (4, [0.1, inf, 0.2, 0.3], None), (None, [0.5, -0.5, 0.25, 1.0], None), (5, [0.0] * 4, None), (5, [0.0] * 4, None), (5, [1.0] * 4, 2), (6, [0.5] * 4, 2)]
    vectors += [(7, [], 2), (8, [], None), (9, [0.3], 1), (10, [0.3, 0.4], 1), (11, [-0.0001, 0.0], 1), (12, [0.5] * 4, 2)]
    assert _coded(spark, vectors, entries=3, rounds=2) == _brute(vectors, 1024, 3, 2)


def test_empty_table_and_too_large_components(spark):
    assert _coded(spark, []) == [] and _coded(spark, [(1, None, 1)]) == []
    with pytest.raises(Exception, match="beyond 64 bits"):
        _coded(spark, [(1, [1e9] * 4, 1), (2, [-1e300] * 4, 1)])


def test_a_hot_label_and_a_hot_vector(spark):
    vectors = [(k, [0.25] * 8, None) for k in range(300)] + [(k, [k / 1000.0, *[0.1 * (k % 7)] * 7], k % 40) for k in range(300, 400)]
    assert _coded(spark, vectors, entries=16) == _brute(vectors, 1024, 16, 4)


def test_shortlists_keep_the_nearest_and_prune_where_vectors_have_structure(spark):
    rng = np.random.default_rng(3)
    for _ in range(20):
        entries = rng.integers(-900, 900, (40, 5))
        points = rng.integers(-900, 900, 5) + rng.integers(-200, 200, (30, 5))
        kept = codes.shortlists(points.min(0)[None], points.max(0)[None], (points.sum(0) // 30)[None], entries)[0]
        distances = ((points[:, None, :] - entries) ** 2).sum(2)
        assert all(kept[np.flatnonzero(row == row.min())].all() for row in distances)
    middles, told = rng.normal(0, 0.3, (60, 32)), []
    vectors = [(k, (middles[k % 60] + rng.normal(0, 0.004, 32)).tolist(), 0) for k in range(6000)]
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in vectors], VECTORS)
    codes.vector_codes(df, entries=60, told=told).count()
    assert all(t["compared"] < 0.1 * t["pairs"] for t in told) and sum(t["whole"] for t in told) > 0


def test_hilbert_order_goes_from_cell_to_neighbouring_cell():
    grid = np.stack(np.meshgrid(np.arange(256), np.arange(256)), 2).reshape(-1, 2)
    keys = codes.hilbert_keys(grid, np.zeros(2, int), np.full(2, 255))
    order = grid[sorted(range(len(grid)), key=keys.__getitem__)]
    assert len(set(keys)) == len(keys) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    cube = np.stack(np.meshgrid(*[np.arange(16)] * 3), 3).reshape(-1, 3)
    steps = np.abs(np.diff(cube[sorted(range(len(cube)), key=codes.hilbert_keys(cube * 16, np.zeros(3, int), np.full(3, 255)).__getitem__)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_exact_beyond_doubles():
    x = np.array([[2**27 + 1, 2**27 - 1]], np.int64)
    assert codes.exact_product(x, x)[0, 0] == (2**27 + 1) ** 2 + (2**27 - 1) ** 2
