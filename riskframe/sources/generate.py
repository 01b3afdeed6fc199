"""A labelled demonstration table whose rows depend on seed and id only, not on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.contracts import DataError

DAY2, FEATURES = 172_800.0, 28


def _uniform(name: str, seed: int) -> Column:
    """In [0, 1), from a hash of id, seed and name."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1 << 53)) / float(1 << 53)


def _normal(name: str, seed: int) -> Column:
    return F.sqrt(-2 * F.ln(1 - _uniform(name + "r", seed))) * F.cos(2 * math.pi * _uniform(name + "a", seed))


def transactions(spark: SparkSession, rows: int = 5000, positive_rate: float = 0.02, seed: int = 42, parts: int | None = None) -> DataFrame:
    """id, Time (ascending by id), V1..V28 (12 informative, 8 mixtures, 8 noise), Amount, Class; ``parts``: partitions that make them."""
    if rows < 200 or not 0.005 <= positive_rate <= 0.5:
        raise DataError("rows must be at least 200 and the rate between 0.005 and 0.5")
    label = (_uniform("class", seed) < positive_rate).cast("tinyint")
    base = spark.range(0, rows, 1, parts).withColumn("Class", label)
    shift = F.when(F.col("Class") == 1, 1.0).otherwise(-0.1)
    informative = {f"V{k}": _normal(f"V{k}", seed) + shift * (0.5 + 0.1 * (k % 5)) * (1 if k % 2 else -1) for k in range(1, 13)}
    mixtures = {f"V{k}": 0.6 * F.col(f"V{k - 12}") - 0.4 * F.col(f"V{k - 11}") for k in range(13, 21)}
    noise = {f"V{k}": _normal(f"V{k}", seed) for k in range(21, FEATURES + 1)}
    amount = F.round(F.exp(3.2 + 1.1 * _normal("amount", seed)), 2)
    time = (F.col("id") + _uniform("time", seed)) * (DAY2 / rows)
    full = base.withColumns(informative).withColumns(mixtures).withColumns(noise).withColumn("Amount", amount).withColumn("Time", time)
    return full.select("id", "Time", *(f"V{k}" for k in range(1, FEATURES + 1)), "Amount", "Class")
