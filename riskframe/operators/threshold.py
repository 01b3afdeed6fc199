"""Decision thresholds from score groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.contracts import check_costs
from riskframe.functions import ratio
from riskframe.operators.curves import with_totals


def f1_threshold(groups: DataFrame) -> DataFrame:
    """threshold, f1: the best F1, the lowest threshold on ties; 0.5 without any score.

    2 TP / (2 TP + FP + FN) has integer counts, so equal values of F1 compare equal.
    """
    f1 = with_totals(groups).select("threshold", ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")).alias("f1"))
    best = f1.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("best"))
    return best.select(F.coalesce("best.threshold", F.lit(0.5)).alias("threshold"), F.coalesce("best.f1", F.lit(0.0)).alias("f1"))


def cost_threshold(groups: DataFrame, false_positive_cost: float, false_negative_cost: float) -> DataFrame:
    """threshold, expected_cost: the cheapest; on ties most positives found, then the highest threshold.

    Flagging nothing (threshold 1) is taken only where no score is 1 and it is strictly cheaper.
    """
    check_costs(false_positive_cost, false_negative_cost)
    cost = (F.col("fp") * false_positive_cost + (F.col("p") - F.col("tp")) * false_negative_cost) / (F.col("p") + F.col("n"))
    priced = with_totals(groups).withColumn("cost", cost)
    least = priced.agg(F.min("cost").alias("least"), F.max("threshold").alias("top"), (F.max("p") * false_negative_cost / (F.max("p") + F.max("n"))).alias("nothing"))
    near = priced.join(F.broadcast(least), F.abs(F.col("cost") - F.col("least")) <= 1e-8 + 1e-5 * F.abs(F.col("least")))
    best = near.agg(F.max_by(F.struct("threshold", "cost"), F.struct("tp", "threshold")).alias("b"), F.max("least").alias("least"), F.max("top").alias("top"), F.max("nothing").alias("nothing"))
    none = (F.col("top") < 1) & (F.col("nothing") < F.col("least"))
    return best.select(F.when(none, 1.0).otherwise(F.col("b.threshold")).alias("threshold"), F.when(none, F.col("nothing")).otherwise(F.col("b.cost")).alias("expected_cost"))
