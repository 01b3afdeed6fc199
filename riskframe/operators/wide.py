"""Scores of wide or sparse tables in long form: (row, feature, value) rows that meet a table of parameters.

A value adds coefficient / scale times itself to its row's margin, and what a row lacks counts as zero, so
a row costs its present values.  Parameters are a row a feature; Spark joins them by broadcast or by shuffle as their
size asks.  Rows of one key are summed in tasks before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.contracts import FeatureContract, ModelError, SchemaError
from riskframe.functions import count_where, decision, is_finite, local_table, logistic, number, quoted
from riskframe.operators import knots
from riskframe.operators.fit import FoldModel


def long_rows(df: DataFrame, key: tuple[str, ...], features: tuple[str, ...], zeros: bool = False) -> DataFrame:
    """key, feature, value: one row a feature of a wide table, without zeros unless ``zeros``."""
    pairs = F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), F.array(*(number(f) for f in features)).alias("value"))
    out = df.select(*(F.col(quoted(k)) for k in key), F.inline(pairs).alias("feature", "value"))
    return out if zeros else out.where("value IS NULL OR value <> 0")


def parameters(spark, features: tuple[str, ...], models: list[FoldModel]) -> DataFrame:
    """feature, w: what a unit of the feature adds to the margin of each fold."""
    rows = [(f, [m.coefficients[k] / m.scales[k] for m in models]) for k, f in enumerate(features)]
    return local_table(spark, rows, "feature string, w array<double>")


def _calibrated(x: Column, model: FoldModel) -> Column:
    c = model.calibrator
    if c.method == "sigmoid":
        return logistic(-(c.slope * x + c.intercept))
    return knots.interpolated(x, c.boundaries, c.values) if c.method == "isotonic" else logistic(x)


def check_long(rows: DataFrame, contract: FeatureContract) -> None:
    """Features are the contract's, values finite, and no row has a feature twice: one aggregation, and one by row and feature."""
    known = parameters(rows.sparkSession, contract.features, [FoldModel((0.0,) * len(contract.features), (1.0,) * len(contract.features), (0.0,) * len(contract.features), 0.0)])
    met = rows.join(known.select(F.col("feature").alias("_known")), F.col("feature") == F.col("_known"), "left")
    unknown, bad, n = met.agg(F.array_sort(F.collect_set(F.when(F.col("_known").isNull(), F.substring(F.coalesce("feature", F.lit("")), 1, 64)))), count_where(~is_finite(F.col("value"))), F.count("*")).first()
    if unknown:
        raise SchemaError(f"Feature schema mismatch: unexpected={unknown[:20]}")
    if not n:
        raise SchemaError("The table is empty")
    if bad:
        raise SchemaError(f"{bad} values are missing or infinite")
    if rows.groupBy(*(F.col(quoted(k)) for k in contract.key), "feature").count().where("count > 1").limit(1).count():
        raise SchemaError("A row has a feature twice")


def score_long(rows: DataFrame, contract: FeatureContract, models: list[FoldModel], threshold: float, keys: DataFrame | None = None, score: str = "fraud_probability", flag: str = "is_fraud", checked: bool = False) -> DataFrame:
    """key, probability, decision; rows: key, feature, value.

    ``keys`` are all keys, where some may have no value at all (all zeros); without it a row needs a value.
    """
    if not contract.key:
        raise ModelError("Long rows need key columns")
    if not checked:
        check_long(rows, contract)
    spark, key = rows.sparkSession, [quoted(k) for k in contract.key]
    base = [m.intercept - sum(c * a / s for c, a, s in zip(m.coefficients, m.means, m.scales, strict=True)) for m in models]
    met = rows.join(parameters(spark, contract.features, models), "feature")
    sums = met.groupBy(*map(F.col, key)).agg(*(F.sum(F.col("value") * F.col("w")[k]).alias(f"_m{k}") for k in range(len(models))))
    if keys is not None:
        sums = keys.select(*map(F.col, key)).join(sums, list(contract.key), "left")
    total = sum((_calibrated(F.coalesce(F.col(f"_m{k}"), F.lit(0.0)) + b, m) for k, (b, m) in enumerate(zip(base, models, strict=True))), F.lit(0.0))
    return sums.withColumn(score, total / len(models)).select(*map(F.col, key), score, decision(F.col(score), threshold).alias(flag))
