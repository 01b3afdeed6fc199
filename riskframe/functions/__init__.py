"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(name: str) -> Column:
    """A column as double, whatever characters its name has."""
    return F.col(quoted(name)).cast("double")


def is_missing(value: Column) -> Column:
    """Null and NaN both count as missing."""
    return value.isNull() | F.isnan(value)


def is_infinite(value: Column) -> Column:
    return F.coalesce(F.abs(value) == float("inf"), F.lit(False))


def is_finite(value: Column) -> Column:
    return ~is_missing(value) & ~is_infinite(value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 (ANSI division would raise)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def decision(probability: Column, threshold: float) -> Column:
    """1 at or above the threshold. Check the scores first: Spark orders NaN above every number."""
    return (probability >= F.lit(float(threshold))).cast("tinyint")


#: terms that are written out by + or |, which Spark compiles; longer chains would overflow the analyzer's stack
CHAINED = 64


def dot(values: list[Column], weights: list[float]) -> Column:
    """Sum of products, from the left: a chain of few, else one array expression. Both give the same bits."""
    if len(values) <= CHAINED:
        out = F.lit(0.0)
        for value, w in zip(values, weights, strict=True):
            out = out + value * F.lit(float(w))
        return out
    products = F.zip_with(F.array(*values), F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row, however often ``use`` names it, also inside its lambdas."""
    return F.element_at(F.transform(F.array(x), use), 1)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table that needs no worker to be read."""
    fields = StructType.fromDDL(schema).fields
    columns = {f.name: pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(fields)}
    return spark.createDataFrame(pa.table(columns), StructType.fromDDL(schema))
