"""Exact quality of scores at a threshold, as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.contracts import check_costs, check_threshold
from riskframe.functions import count_where, number, ratio
from riskframe.operators.curves import score_groups, with_totals
from riskframe.operators.validate import check_scored


def _counts(label: str, score: str, threshold: float) -> list[Column]:
    check_threshold(threshold)
    y, hit = number(label) == 1, number(score) >= threshold
    return [
        count_where(~y & ~hit).alias("true_negatives"), count_where(~y & hit).alias("false_positives"), count_where(y & ~hit).alias("false_negatives"), count_where(y & hit).alias("true_positives"),
    ]


def confusion(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """true_negatives, false_positives, false_negatives, true_positives."""
    return df.agg(*_counts(label, score, threshold))


def ranking_quality(groups: DataFrame) -> DataFrame:
    """roc_auc (ties count half) and average_precision (no interpolation) of score groups."""
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    step = F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    sums = with_totals(groups).agg(F.sum(area).alias("area"), F.sum(step).alias("step"), F.max("p").alias("p"), F.max("n").alias("n"))
    return sums.select(ratio(F.col("area"), F.col("p") * F.col("n")).alias("roc_auc"), ratio(F.col("step"), F.col("p")).alias("average_precision"))


def expected_cost(counts: DataFrame, false_positive_cost: float, false_negative_cost: float) -> DataFrame:
    """expected_cost of a row: what its mistakes cost, divided by all rows."""
    check_costs(false_positive_cost, false_negative_cost)
    cost = F.col("false_positives") * false_positive_cost + F.col("false_negatives") * false_negative_cost
    rows = F.col("true_negatives") + F.col("false_positives") + F.col("false_negatives") + F.col("true_positives")
    return counts.select(ratio(cost, rows).alias("expected_cost"))


def evaluate(df: DataFrame, label: str, score: str, threshold: float, groups: DataFrame | None = None, checked: bool = False) -> DataFrame:
    """threshold, seven qualities and four counts."""
    if not checked:
        check_scored(df, label, score)
    counts = df.agg(*_counts(label, score, threshold), F.avg(F.pow(number(score) - number(label), F.lit(2))).alias("brier_score"))
    ranking = ranking_quality(groups if groups is not None else score_groups(df, label, score))
    tn, fp, fn, tp = (F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives"))
    return counts.join(F.broadcast(ranking)).select(  # both are single rows
        F.lit(float(threshold)).alias("threshold"), "roc_auc", "average_precision", "brier_score", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"), "true_negatives", "false_positives", "false_negatives", "true_positives",
    )
