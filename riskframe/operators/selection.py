"""Exact order statistics by bracketing: no sort, no shuffle of rows, no task that holds a column.

A first aggregation makes a mergeable quantile sketch of each group's values.  The sketch bounds the
values at the asked ranks; the next aggregation counts what lies below, at and between these bounds,
and sketches again what lies inside a bracket or, once that is little, returns it with its counts.  A pass is
one scan that shuffles a few rows a task, and narrows what is left by a factor of hundreds.  Counts are
exact, so a rank that a sketch missed is noticed and looked for again with more items: results are exact.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: items of a sketch; the share of rows that a bracket leaves to either side of a rank (twice the error of so many items); rows inside brackets that are returned as they are
ITEMS, ROOM, FEW = 4096, 0.003, 100_000
_AGGREGATE = {"double": F.kll_sketch_agg_double, "bigint": F.kll_sketch_agg_bigint}
_QUANTILE = {"double": F.kll_sketch_get_quantile_double, "bigint": F.kll_sketch_get_quantile_bigint}


@dataclass(frozen=True)
class Place:
    """The value at a rank, how many are below it, and how many equal it."""

    value: float | int
    below: int
    equal: int


def _kind(rows: DataFrame, value: str) -> str:
    return "bigint" if isinstance(rows.schema[value].dataType, T.LongType) else "double"


def sketch(value: Column, kind: str, items: int = ITEMS) -> Column:
    """A sketch of a column's values (nulls take no part)."""
    return _AGGREGATE[kind](value, F.lit(items))


def sketches(rows: DataFrame, group: str, value: str, items: int = ITEMS) -> dict[Hashable, tuple[int, bytearray]]:
    """{group: (values, sketch)}: one row a group reaches the driver."""
    told = rows.groupBy(group).agg(F.count(value).alias("n"), sketch(F.col(value), _kind(rows, value), items).alias("sketch")).collect()
    return {r[group]: (r["n"], r["sketch"]) for r in told}


class _Brackets:
    """Bounds of each group, and which gaps between them lie inside the bracket of a rank."""

    def __init__(self):
        self.bounds: dict[Hashable, list] = {}
        self.inside: dict[Hashable, set[int]] = {}
        self.expected = 0.0

    @staticmethod
    def around(rows: DataFrame, kind: str, known: list[tuple[Hashable, int, bytearray, list[int]]]) -> _Brackets:
        """known: group, values of a sketch, the sketch, ranks among these values."""
        out, room = _Brackets(), lambda n: ROOM * n + 1
        asked = [(g, s, [min(1.0, max(0.0, x / n)) for r in ranks for x in (r - room(n), r + 1 + room(n))]) for g, n, s, ranks in known]
        one = rows.sparkSession.createDataFrame(pa.table({f"s{k}": pa.array([bytes(s)], pa.binary()) for k, (_, s, _) in enumerate(asked)}))
        found = one.select(*(_QUANTILE[kind](f"s{k}", F.array(*map(F.lit, at))) for k, (_, _, at) in enumerate(asked))).first()
        pairs: dict[Hashable, list[tuple]] = {}
        for (g, _, _), own in zip(asked, found, strict=True):
            pairs.setdefault(g, []).extend(zip(own[::2], own[1::2], strict=True))
        for g, own in pairs.items():
            out.bounds[g] = sorted({x for pair in own for x in pair})
            at = {x: k for k, x in enumerate(out.bounds[g])}
            out.inside[g] = {2 * k for a, b in own for k in range(at[a] + 1, at[b] + 1)}
        out.expected = sum(len(ranks) * min(n, 4 * room(n)) for _, n, _, ranks in known)
        return out

    def counted(self, rows: DataFrame, group: str, value: str, kind: str, listed: bool) -> DataFrame:
        """group, slot, x, n: how many rows a task has in each slot, x null; inside brackets rows are by value.

        Slot 2 k is below bound k and above bound k - 1, 2 k + 1 at bound k.
        """
        known = {g: (np.array(b, np.int64 if kind == "bigint" else np.float64), np.array(sorted(self.inside[g]), np.int64)) for g, b in self.bounds.items()}
        schema = T.StructType([T.StructField("g", rows.schema[group].dataType), T.StructField("slot", T.IntegerType()), T.StructField("x", rows.schema[value].dataType), T.StructField("n", T.LongType())])
        arrow = to_arrow_schema(schema)

        def made(g: Hashable, slots: np.ndarray, x: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            columns = ([g] * len(slots), slots, x, n)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = {g: np.zeros(2 * len(b) + 1, np.int64) for g, (b, _) in known.items()}
            for batch in batches:
                for g, (b, inside) in known.items():
                    x = np.asarray(batch.column(1).filter(pc.equal(batch.column(0), g)))
                    slot = np.searchsorted(b, x, "left") + np.searchsorted(b, x, "right")
                    by_value = np.isin(slot, inside)
                    counts[g] += np.bincount(slot[~by_value], minlength=len(counts[g]))
                    x, slot, n = x[by_value], slot[by_value], np.ones(int(by_value.sum()), np.int64)
                    if listed:
                        x, at, n = np.unique(x, return_index=True, return_counts=True)
                        slot = slot[at]
                    if len(x):
                        yield made(g, slot, x, n)
            for g, own in counts.items():
                slots = np.flatnonzero(own)
                yield made(g, slots, pa.nulls(len(slots), arrow.field("x").type), own[slots])

        return rows.select(F.col(group), F.col(value)).mapInArrow(run, schema)


def order_statistics(rows: DataFrame, group: str, value: str, ranks: dict[Hashable, list[int]], known: dict[Hashable, tuple[int, bytearray]] | None = None, few: int = FEW) -> dict[tuple[Hashable, int], Place]:
    """{(group, rank): place}; rows: a long table of groups and values (double, or long), neither ever null.

    Ranks count from 0.  ``known``: sketches of the groups, if an earlier aggregation made them.  Groups,
    and ranks a group, are few: both reach the driver.
    """
    kind, places, items = _kind(rows, value), {}, ITEMS
    left = {g: set(own) for g, own in ranks.items() if own}
    whole = known if known is not None else sketches(rows, group, value)
    now = [(g, *whole[g], sorted(own)) for g, own in left.items()]
    while now:
        around = _Brackets.around(rows, kind, now)
        listed = around.expected <= few
        counted = around.counted(rows.where(F.col(group).isin(list(left))), group, value, kind, listed)
        if listed:
            found = counted.groupBy("g", "slot", "x").agg(F.sum("n").alias("n")).collect()
        else:
            found = counted.groupBy("g", "slot").agg(F.sum("n").alias("n"), sketch(F.col("x"), kind).alias("x")).collect()
        told: dict[Hashable, dict[int, list]] = {g: {} for g in left}
        for r in found:
            told[r["g"]].setdefault(r["slot"], []).append((r["x"], r["n"]))
        narrower: list[tuple[Hashable, int, bytearray, list[int]]] = []
        for g, own in told.items():
            below, missed = 0, False
            for slot in sorted(own):
                gap, inside = slot % 2 == 0, slot in around.inside[g]
                # (value, count) of what is known one by one
                values = sorted(own[slot]) if gap and inside and listed else [] if gap else [(around.bounds[g][slot // 2], own[slot][0][1])]
                n, at = sum(k for _, k in own[slot]), below
                for v, k in values:
                    for r in [r for r in left[g] if at <= r < at + k]:
                        places[g, r] = Place(v, at, k)
                        left[g].discard(r)
                    at += k
                if rest := sorted(r - below for r in left[g] if below <= r < below + n):
                    missed = missed or not inside
                    narrower.append((g, n, own[slot][0][0], rest))
                below += n
            if missed:  # rarely: more items, and all ranks of the group that are left
                items = min(65535, 8 * items)
                n, more = sketches(rows.where(F.col(group) == F.lit(g)), group, value, items)[g]
                narrower = [own for own in narrower if own[0] != g] + [(g, n, more, sorted(left[g]))]
        left = {g: own for g, own in left.items() if own}
        now = narrower
    return places
