"""Feature effects: mean coefficients over folds, ranked by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.contracts import ModelError


def rank_effects(coefficients: DataFrame) -> DataFrame:
    """coefficients: (fold, ordinal, feature, coefficient). A row a feature: rank, feature, coefficient, absolute_effect, direction."""
    means = coefficients.groupBy("ordinal", "feature").agg(F.avg("coefficient").alias("coefficient"))
    size = F.abs("coefficient")
    place = F.row_number().over(W.orderBy(size.desc(), "ordinal"))  # as many rows as features
    return means.select(place.alias("rank"), "feature", "coefficient", size.alias("absolute_effect"), F.when(F.col("coefficient") >= 0, "higher_fraud_risk").otherwise("lower_fraud_risk").alias("direction"))


def top_effects(effects: DataFrame, top: int = 10) -> DataFrame:
    if not 1 <= top <= 100:
        raise ModelError("top must be between 1 and 100")
    return effects.where(F.col("rank") <= top).orderBy("rank")


def coefficient_table(spark, features: tuple[str, ...], models: list) -> DataFrame:
    rows = [(k, j, f, c) for k, m in enumerate(models) for j, (f, c) in enumerate(zip(features, m.coefficients, strict=True))]
    return spark.createDataFrame(rows, "fold int, ordinal int, feature string, coefficient double")
