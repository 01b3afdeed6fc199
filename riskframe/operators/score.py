"""Scoring of tables by column expressions made of a model's numbers: no UDF, the same on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.contracts import FeatureContract, ModelError
from riskframe.functions import decision, logistic
from riskframe.operators import knots
from riskframe.operators.fit import FoldModel, margin
from riskframe.operators.knots import interpolated
from riskframe.operators.validate import bad_rows, check_scorable, match_schema, score_problems


#: Knots of a calibrator up to which they are part of the expression; more come by a join, with the same result.
LITERAL_KNOTS = 1024
_interpolated = interpolated


def fold_probability(features: tuple[str, ...], model: FoldModel) -> Column:
    m, c = margin(features, model), model.calibrator
    if c.method == "sigmoid":
        return logistic(-(c.slope * m + c.intercept))
    if c.method == "isotonic":
        return _interpolated(m, c.boundaries, c.values)
    return logistic(m)


def probability(features: tuple[str, ...], models: list[FoldModel]) -> Column:
    """Mean of the folds' calibrated probabilities."""
    total = fold_probability(features, models[0])
    for model in models[1:]:  # at most ten
        total = total + fold_probability(features, model)
    return total / len(models)


def add_scores(df: DataFrame, features: tuple[str, ...], models: list[FoldModel], threshold: float, score: str = "fraud_probability", flag: str = "is_fraud") -> DataFrame:
    """The two columns beside all others; lazy and without checks, so it also serves streams."""
    if all(len(m.calibrator.boundaries) <= LITERAL_KNOTS for m in models):
        return df.withColumn(score, probability(features, models)).withColumn(flag, decision(F.col(score), threshold))
    out, parts = df, []
    for k, m in enumerate(models):
        if len(m.calibrator.boundaries) <= LITERAL_KNOTS:
            parts.append(fold_probability(features, m))
        else:
            out = knots.joined(out.withColumn(f"_margin_{k}", margin(features, m)), f"_margin_{k}", m.calibrator.boundaries, m.calibrator.values, f"_fold_{k}")
            parts.append(F.col(f"_fold_{k}"))
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    scored = out.withColumn(score, total / len(models))
    return scored.withColumn(flag, decision(F.col(score), threshold)).drop(*(f"_{kind}_{k}" for kind in ("margin", "fold") for k in range(len(models))))


def score_table(df: DataFrame, contract: FeatureContract, models: list[FoldModel], threshold: float, score: str = "fraud_probability", flag: str = "is_fraud", on_invalid: str = "raise") -> DataFrame:
    """A checked batch: all rows, or an error; ``quarantine`` scores valid rows and leaves the others null."""
    if on_invalid == "quarantine":
        scored = add_scores(match_schema(df, contract), contract.features, models, threshold, score, flag)
        return scored.withColumns({c: F.when(~bad_rows(contract), F.col(c)) for c in (score, flag)})
    out = add_scores(check_scorable(df, contract), contract.features, models, threshold, score, flag)
    return out


def check_scores(scored: DataFrame, score: str) -> DataFrame:
    if scored.agg(score_problems(F.col(score))).first()[0]:
        raise ModelError("The model gives scores that are no probabilities")
    return scored


def score_with_pipeline(df: DataFrame, fitted, threshold: float, score: str = "fraud_probability", flag: str = "is_fraud") -> DataFrame:
    """Any fitted MLlib model with a probability vector of two classes."""
    from pyspark.ml.functions import vector_to_array

    scored = fitted.transform(df).withColumn(score, vector_to_array("probability")[1])
    return check_scores(scored.select(*df.columns, score), score).withColumn(flag, decision(F.col(score), threshold))


def score_summary(scored: DataFrame, flag: str = "is_fraud") -> DataFrame:
    return scored.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0)).alias("n_flagged"))
