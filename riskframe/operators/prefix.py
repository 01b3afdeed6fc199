"""Running sums and ranks in a global order, by one shuffle and without one task that sees all rows.

Rows are shuffled once, into ranges of the order, and sorted there.  The task that has a range adds its
running sums as the rows pass, and writes them.  What earlier ranges sum up to is a row a range and group,
which is broadcast back: the number of partitions bounds it, as groups are few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskframe.sources.staging import keep


def _starts(batch: pa.RecordBatch, names: list[str], last: tuple | None) -> np.ndarray:
    """Where in a sorted batch a group begins, other than the one that ran before; empty for a single group."""
    n = batch.num_rows
    if not names or not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    for name in names:
        x = batch[name]
        same = pc.fill_null(pc.equal(x[1:], x[:-1]), False)
        both_null = pc.and_(pc.is_null(x[1:]), pc.is_null(x[:-1]))
        new[1:] |= ~np.asarray(pc.or_(same, both_null))
    new[0] = last is not None and last != tuple(batch[name][0].as_py() for name in names)
    return np.flatnonzero(new)


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str], merge: Callable | None = None) -> DataFrame:
    """Adds ``sums`` (new column to summed column): sums up to and with each row, in ``order`` within ``group``.

    Summed columns are counts, whole and not negative, so a range's last running sum is its greatest.
    ``merge`` may make fewer rows of a range's sorted batches before they are summed.  ``order`` should leave no ties: rows that tie are in no given order.
    """
    by, names = [*map(F.col, group), *order], list(sums)
    fields = [*df.schema.fields, *(T.StructField(new, T.LongType()) for new in names), T.StructField("_range", T.IntegerType())]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, last = np.zeros(len(names), np.int64), None
        part = TaskContext.get().partitionId()
        for batch in merge(batches) if merge else batches:
            if not batch.num_rows:
                continue
            ends, columns = _starts(batch, group, last), {}
            for k, new in enumerate(names):
                x = np.asarray(batch[sums[new]], np.int64)
                upto = np.cumsum(x)
                # a group starts from zero, the first one from what the batch before left
                starts = np.concatenate(([carried[k]], x[ends] - upto[ends]))
                at = np.searchsorted(ends, np.arange(batch.num_rows), side="right")
                columns[new] = upto + starts[at]
                carried[k] = columns[new][-1]
            last = tuple(batch[name][batch.num_rows - 1].as_py() for name in group)
            columns["_range"] = np.full(batch.num_rows, part, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name]) if f.name in columns else batch[f.name].cast(f.type) for f in arrow], schema=arrow)

    kept = keep(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = kept.groupBy(*group, "_range").agg(*(F.max(new).alias(f"_{new}") for new in names))
    offsets = totals.select(*(F.col(g).alias(f"_of_{k}") for k, g in enumerate(group)), F.col("_range").alias("_part"), *(F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in names))
    same = F.col("_range") == F.col("_part")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{k}"))
    joined = kept.join(F.broadcast(offsets), same)
    return joined.select(*df.columns, *((F.col(new) + F.col(f"_{new}")).alias(new) for new in names))


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the rank from 1 of each row in ``order`` within ``group``."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), group, order, {name: "_one"}).drop("_one")
