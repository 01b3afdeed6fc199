"""Cutoffs of a composite order: which rows are among the first n of their group, as one filter.

Columns of an order become longs that sort like them (positions).  The n-th row's first position is
found by exact selection; where several rows share it, the next position is looked at among these
rows only.  A cutoff is then a few longs, and a row is before it if its positions are: no row is
shuffled, ranked or written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.selection import order_statistics

#: bytes of a string that a position holds, and positions of a string
_BYTES, _CHUNKS = 7, 6
_LEAST = -(1 << 63)


def _of_double(x: Column) -> Column:
    """Never falls as x rises (NaN last), and tells doubles of usual sizes apart; those it doesn't are left to later positions."""
    finite = (F.signum(x) * F.log1p(F.abs(x)) * float(1 << 53)).cast("long")
    most = -(_LEAST + 1)
    return F.when(x.isNull(), _LEAST).when(F.isnan(x), most).when(x == float("inf"), most - 1).when(x == float("-inf"), _LEAST + 1).otherwise(finite)


def positions(column: Column, kind: T.DataType) -> list[Column]:
    """Longs that sort as the column does, null first, or as nearly as they can; equal values have equal positions."""
    least = lambda x: F.coalesce(x.cast("long"), F.lit(_LEAST))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return [least(column.cast("int") if isinstance(kind, T.BooleanType) else column)]
    if isinstance(kind, T.TimestampType):
        return [least(F.unix_micros(column))]
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(column.cast("date")).cast("long") * 86_400 + F.hour(column) * 3600 + F.minute(column) * 60
        return [least(seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long"))]
    if isinstance(kind, T.DateType):
        return [least(F.unix_date(column))]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [_of_double(column.cast("double"))]
    if isinstance(kind, T.DecimalType):
        whole = F.floor(column.cast("decimal(38,18)")) if kind.scale <= 18 and kind.precision - kind.scale <= 18 else None
        return [_of_double(column.cast("double"))] if whole is None else [least(whole), least((column.cast("decimal(38,18)") - whole) * F.lit(10**18).cast("decimal(20,0)"))]
    raw = column if isinstance(kind, T.BinaryType) else column.cast("string").cast("binary")
    chunk = lambda k: F.conv(F.rpad(F.hex(F.substring(raw, 1 + k * _BYTES, _BYTES)), 2 * _BYTES, "0"), 16, 10)
    # the length tells a string from one that zero bytes end
    return [least(chunk(k)) for k in range(_CHUNKS)] + [least(F.length(raw))]


def all_positions(df: DataFrame, order: list[Column]) -> list[Column]:
    kinds = [f.dataType for f in df.select(*order).schema.fields]
    return [p for column, kind in zip(order, kinds, strict=True) for p in positions(column, kind)]


@dataclass(frozen=True)
class Cutoff:
    """The positions of the last row that is before the cutoff, as many as tell it; none: no row is before it."""

    upto: tuple[int, ...] | None

    def holds(self, places: list[Column]) -> Column:
        """Whether a row is before it."""
        if self.upto is None:
            return F.lit(False)
        out = places[len(self.upto) - 1] <= self.upto[-1]
        for place, value in reversed(list(zip(places, self.upto[:-1], strict=False))):
            out = (place < value) | ((place == value) & out)
        return out


class TiedError(ValueError):
    """Rows on both sides of a cutoff are equal in all columns of the order."""


def cutoffs(df: DataFrame, group: Column, places: list[Column], wanted: dict[int, list[int]]) -> dict[tuple[int, int], Cutoff]:
    """{(group, n): cutoff after the group's first n rows}; raises TiedError where no filter can cut.

    ``group`` is an int, ``places`` are :func:`all_positions` of an order, n at most the group's rows.
    """
    found: dict[tuple[int, int], Cutoff] = {(g, 0): Cutoff(None) for g, own in wanted.items() if 0 in own}
    # rank within the rows that share the positions so far, for each cutoff that is still open
    rows, own = df.select(group.alias("g"), places[0].alias("v")), {g: {n: n - 1 for n in ns if n} for g, ns in wanted.items()}
    told = order_statistics(rows, "g", "v", {g: sorted(set(ranks.values())) for g, ranks in own.items()})
    for g, ranks in own.items():
        for n, rank in ranks.items():
            at, prefix = told[g, rank], []
            while True:
                prefix.append(at.value)
                rank -= at.below
                if rank + 1 == at.equal:
                    break
                if len(prefix) == len(places):
                    raise TiedError(f"rows {n} and {n + 1} of {g} are equal in all columns of the order")
                same = group == g
                for place, value in zip(places, prefix, strict=False):
                    same = same & (place == value)
                inner = df.where(same).select(F.lit(0).alias("g"), places[len(prefix)].alias("v"))
                at = order_statistics(inner, "g", "v", {0: [rank]})[0, rank]
            found[g, n] = Cutoff(tuple(prefix))
    return found
