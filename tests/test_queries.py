import duckdb
import pandas as pd
import pytest

from riskframe.plans.checks import CHECKS
from riskframe.plans.oracle import ORACLE_SQL
from riskframe.plans.outputs import OUTPUTS
from riskframe.plans.proofs import PROOFS
from riskframe.plans.queries import QUERIES as CORE

QUERIES = CORE | CHECKS | OUTPUTS | PROOFS
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _cells(rows):
    return sorted([["" if v is None or (isinstance(v, float) and pd.isna(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r] for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, rel = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    order = sorted(got.columns)
    want = [[dict(zip(rel.columns, r, strict=True))[c] for c in order] for r in rel.fetchall()]
    assert _cells([[r[c] for c in order] for r in got.collect()]) == _cells(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
