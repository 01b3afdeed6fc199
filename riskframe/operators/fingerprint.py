"""Digests of a table's rows and labels that do not depend on their order: one of the table, and a tree by key ranges.

The tree tells in which ranges two versions of a table differ, and is brought up to date by reading these alone.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.contracts import FeatureContract
from riskframe.functions import local_table, number, quoted
from riskframe.sources.staging import keep


def fingerprint(df: DataFrame, contract: FeatureContract) -> str:
    """64 hex digits. Sums of row hashes under two seeds: repeated rows count."""
    names = [*contract.features, contract.target]
    values = [number(n) for n in names]
    sums = df.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(38,0)")) for seed in (1, 2))).first()
    return hashlib.sha256(json.dumps([names, *map(str, sums)]).encode()).hexdigest()


#: children of a node of a tree
FAN = 16
TREE = "level int, node long, n_rows long, digest string"


def part_of(key: str, width: int) -> Column:
    """The key range of a row: keys from part * width up to (part + 1) * width."""
    return F.floor(F.col(quoted(key)) / F.lit(width)).cast("long")


def leaves(df: DataFrame, contract: FeatureContract, key: str, width: int) -> DataFrame:
    """node, n_rows, digest of each key range that has rows: a digest of the range's rows in any order."""
    values = [number(n) for n in (key, *contract.features, *([contract.target] if contract.target else []))]
    sums = [F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    counted = df.groupBy(part_of(key, width).alias("node")).agg(F.count("*").alias("n_rows"), F.concat_ws("|", *sums).alias("sums"))
    return counted.select("node", "n_rows", F.sha2(F.concat_ws("|", F.col("node").cast("string"), F.col("n_rows").cast("string"), "sums"), 256).alias("digest"))


def tree(leaf_table: DataFrame) -> DataFrame:
    """TREE of :func:`leaves`: level 0 are the ranges, a node above digests its FAN children's digests in order.

    A level is one aggregation of at most a sixteenth of the level below; the last one has a single node, 0
    (keys below zero have a last level of two nodes, -1 and 0).
    """
    out = level = keep(leaf_table.select(F.lit(0).alias("level"), "node", "n_rows", "digest"))
    for k in range(1, 64):
        low, high, n = level.agg(F.min("node"), F.max("node"), F.count("*")).first()
        if n == 0 or (low >= -1 and high <= 0 and k > 1):
            break
        grouped = level.groupBy(F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(F.sum("n_rows").alias("n_rows"), F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("children"))
        told = F.concat_ws("|", F.transform("children", lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])))
        level = keep(grouped.select(F.lit(k).alias("level"), "node", "n_rows", F.sha2(told, 256).alias("digest")))
        out = out.union(level)
    return out


def changed_parts(old: DataFrame, new: DataFrame) -> DataFrame:
    """node, change (added, removed, changed) of the key ranges in which two trees differ.

    From the top down, only children of nodes that differ are looked at, so equal tables are told by their roots.
    """
    top = lambda t: t.agg(F.max("level")).first()[0]
    tops = [top(old), top(new)]
    known = max([t for t in tops if t is not None], default=0) if tops[0] == tops[1] else None
    compared = lambda level: old.where(F.col("level") == level).select("node", F.col("digest").alias("a")).join(new.where(F.col("level") == level).select("node", F.col("digest").alias("b")), "node", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    if known is None:  # trees of different heights are compared leaf by leaf
        differ = compared(0)
    else:
        differ = compared(known)
        for level in reversed(range(known)):
            parents = differ.select(F.col("node").alias("_up"))
            differ = compared(level).join(parents, F.floor(F.col("node") / FAN).cast("long") == F.col("_up"), "left_semi")
    return differ.select("node", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


#: spans of keys that reach a scan as filters, at most
SPANS = 64


def updated(old: DataFrame, df: DataFrame, contract: FeatureContract, key: str, width: int, parts: DataFrame | list[int]) -> DataFrame:
    """The tree after only ``parts`` changed: their rows are read and digested, the others' digests are taken over.

    Parts are a list, or a table with the column ``node`` of any size.  Rows meet it by a join; at most SPANS spans of keys around
    the parts reach the scan as filters.
    """
    if not isinstance(parts, DataFrame):
        parts = local_table(df.sparkSession, [(n,) for n in parts], "node long")
    wanted, k, inside = parts.select("node").distinct(), F.col(quoted(key)), F.lit(False)
    for first, last in _spans(wanted):
        inside = inside | ((k >= first * width) & (k < (last + 1) * width))
    again = wanted.select(F.col("node").alias("_part"))
    fresh = leaves(df.where(inside).join(again, part_of(key, width) == F.col("_part"), "left_semi"), contract, key, width)
    kept = old.where("level = 0").join(wanted, "node", "left_anti").select("node", "n_rows", "digest")
    return tree(kept.union(fresh))


def _spans(parts: DataFrame) -> list[tuple[int, int]]:
    """At most SPANS spans (first, last) that cover all ``node``."""
    low, high = parts.agg(F.min("node"), F.max("node")).first()
    if low is None:
        return []
    size = (high - low) // SPANS + 1
    found = parts.groupBy(F.floor((F.col("node") - low) / F.lit(size)).alias("span")).agg(F.min("node"), F.max("node")).orderBy("span").collect()
    return [(r[1], r[2]) for r in found]
