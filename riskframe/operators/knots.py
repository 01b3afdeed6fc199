"""Isotonic calibration with any number of knots: rows meet the few knots around them by a join on blocks.

Knots are cut into blocks of BLOCK, each with the first knot of the next, so every row needs one block only.
A row's block is told by the blocks' first boundaries; the blocks come by an equi-join which Spark makes a
broadcast or a shuffle by the table's size.  The result is that of the literal form for few knots.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import bound, local_table

#: knots in a block; boundaries that are searched in one go, more are searched in two steps
BLOCK, SEARCHED = 512, 128


def at_or_below(x: Column, boundaries: tuple[float, ...], b: Column) -> Column:
    """How many ascending boundaries are at or below x: first whole blocks of them, then one block's."""
    if len(boundaries) <= SEARCHED:
        return F.size(F.filter(b, lambda e: e <= x))
    step = int(len(boundaries) ** 0.5)
    heads = F.array(*(F.lit(float(n)) for n in boundaries[::step]))
    block = F.greatest(F.size(F.filter(heads, lambda e: e <= x)) - 1, F.lit(0))
    return block * step + F.size(F.filter(F.slice(b, block * step + 1, step), lambda e: e <= x))


def between(x: Column, below: Column, b: Column, v: Column, last: Column) -> Column:
    """Linear between the knots around x, constant outside; ``below`` of the ``last`` knots are at or below it."""
    x0, x1 = F.element_at(b, F.greatest(below, F.lit(1))), F.element_at(b, F.least(below + 1, last))
    y0, y1 = F.element_at(v, F.greatest(below, F.lit(1))), F.element_at(v, F.least(below + 1, last))
    inside = y0 + (y1 - y0) * F.coalesce(F.try_divide(x - x0, x1 - x0), F.lit(0.0))
    return F.when(below == 0, F.element_at(v, F.lit(1))).when(below >= last, F.element_at(v, -1)).otherwise(inside)


def interpolated(x: Column, boundaries: tuple[float, ...], values: tuple[float, ...]) -> Column:
    """The literal form: knots are part of the expression."""
    b, v = (F.array(*(F.lit(float(n)) for n in numbers)) for numbers in (boundaries, values))
    # a margin is a long expression: without the binding each knot that is looked at would make it anew
    return bound(x, lambda own: bound(at_or_below(own, boundaries, b), lambda below: between(own, below, b, v, F.lit(len(boundaries)))))


def blocks(spark: SparkSession, boundaries: tuple[float, ...], values: tuple[float, ...], size: int = BLOCK) -> DataFrame:
    """block, b, v: knots by block."""
    rows = [(k // size, list(boundaries[k : k + size + 1]), list(values[k : k + size + 1])) for k in range(0, len(boundaries), size)]
    return local_table(spark, rows, "block int, b array<double>, v array<double>")


def joined(df: DataFrame, x: str, boundaries: tuple[float, ...], values: tuple[float, ...], out: str, size: int = BLOCK) -> DataFrame:
    """Adds ``out``, the value at column ``x``, by a join with the blocks of knots."""
    heads, mark = boundaries[::size], uuid.uuid4().hex[:8]
    own = F.greatest(at_or_below(F.col(x), heads, F.array(*(F.lit(float(n)) for n in heads))) - 1, F.lit(0))
    known = blocks(df.sparkSession, boundaries, values, size).select(*(F.col(c).alias(f"_{c}_{mark}") for c in ("block", "b", "v")))
    met = df.withColumn(f"_at_{mark}", own).join(known, F.col(f"_at_{mark}") == F.col(f"_block_{mark}"), "left")
    b, v = F.col(f"_b_{mark}"), F.col(f"_v_{mark}")
    below = F.size(F.filter(b, lambda e: e <= F.col(x)))
    return met.withColumn(out, between(F.col(x), below, b, v, F.size(b))).drop(f"_at_{mark}", f"_block_{mark}", f"_b_{mark}", f"_v_{mark}")
