from fractions import Fraction
from itertools import permutations
from random import Random

import duckdb
import pytest

from riskframe.llm import audit

DOCS = "doc_id long, text string, lang string, source string, digest string"


@pytest.mark.parametrize("n", [2, 3, 5])
def test_shapley_weights_equal_the_mean_over_all_orders(n):
    rng = Random(n)
    v = [0] + [rng.randrange(-50, 50) for _ in range((1 << n) - 1)]
    want = [0] * n
    for order in permutations(range(n)):
        before = 0
        for f in order:
            want[f] += v[before | 1 << f] - v[before]
            before |= 1 << f
    assert [sum(w * x for w, x in zip(row, v, strict=True)) for row in audit.shapley_weights(n)] == want


def test_solutions_are_exact():
    left = [[Fraction(2), Fraction(1)], [Fraction(1), Fraction(3)]]
    assert audit._solve(left, [[Fraction(1)], [Fraction(0)]]) == [[Fraction(3, 5)], [Fraction(-1, 5)]]


def _against_sql(spark, docs, labels):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, digest VARCHAR)")
    con.sql("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    if docs:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", docs)
    if labels:
        con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    rel = con.sql(audit.SQL_OP11)
    got = audit.audit_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string") if not labels else spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string"))
    assert sorted(got.columns) == sorted(rel.columns)
    rows = sorted(tuple(r[c] for c in rel.columns) for r in got.collect())
    assert rows == sorted(rel.fetchall())
    return rows


def test_nulls_ties_repeats_and_blanks(spark):
    long = " ".join(f"w{k}" for k in range(120))
    docs = [
        (1, None, None, "a", "x"), (2, "", "", "a", "x"), (3, long, "en", "a", "x"), (4, long, "en", None, None), (4, long, "en", None, None), (3, long, "de", "a", "x"),
        (None, long, "en", "a", "x"), (None, None, None, None, None), (7, "A\x0bB\x0cC D é ÀÉ", "fr", "a", "x"), (8, "same " * 300, "en", "a", "x"), (9, "$ " + long, "en", "a", "x"),
        (10, long.upper(), "de", "a", "x"), (11, "ÄÖÜ " * 40 + long, "de", "a", "x"), (5, "x " * 99 + "x", "fr", "a", "x"), (6, " \t\r\n ", "fr", "a", "x"),
    ]
    labels = [(3, 1, 0), (3, 0, 1), (4, None, 1), (9, 1, None), (None, 1, 1), (99, 1, 1), (7, 1, 1)]
    rows = _against_sql(spark, docs, labels)
    assert len(rows) == 4 * 600


def test_empty_tables(spark):
    assert _against_sql(spark, [], []) == []
    assert len(_against_sql(spark, [(1, "a", "en", "s", "d")], [])) == 600


def test_random_tables_equal_sql(spark):
    rng = Random(4)
    texts = [" ".join(rng.choice(["a", "B", "c#", "DD", "e"]) + str(rng.randrange(40)) for _ in range(rng.choice([50, 110, 160]))) for _ in range(12)]
    docs = [(rng.randrange(30), rng.choice(texts), rng.choice(["en", "de", None]), "s", "d") for _ in range(80)]
    _against_sql(spark, docs, [(k, rng.randrange(2), rng.randrange(2)) for k in range(0, 30, 2)])
