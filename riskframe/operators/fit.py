"""Standardised, class-balanced logistic regression, with or without calibration folds.

MLlib does the optimisation, of Platt's two numbers Newton's method; parameters come back as plain numbers.  With weights that sum to the
number of rows n, an inverse strength C is MLlib's regParam 1 / (C n).
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.contracts import FeatureContract, ModelError, TrainingConfig
from riskframe.functions import count_where, dot, logistic, number, quoted


@dataclass(frozen=True)
class Calibrator:
    """sigmoid: 1 / (1 + exp(slope * margin + intercept)); isotonic: linear between boundaries."""

    method: str = "none"
    slope: float = 0.0
    intercept: float = 0.0
    boundaries: tuple[float, ...] = ()
    values: tuple[float, ...] = ()


@dataclass(frozen=True)
class FoldModel:
    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float
    calibrator: Calibrator = Calibrator()

    def as_dict(self) -> dict:
        return asdict(self)


def moments(df: DataFrame, features: tuple[str, ...], by: str | None = None) -> dict:
    """{group: (n, means, population variances)} in one pass; group is None without ``by``."""
    grouped = df.groupBy(by) if by else df.groupBy(F.lit(None).cast("int").alias("g"))
    rows = grouped.agg(F.count("*").alias("n"), *(m for f in features for m in (F.avg(number(f)), F.var_pop(number(f))))).collect()
    return {r[0]: (r[1], [*r[2::2]], [*r[3::2]]) for r in rows}


def pooled(parts: list[tuple]) -> tuple:
    """Moments of several groups together, without sums of squares."""
    n, means, variances = parts[0]
    for m, other_means, other_variances in parts[1:]:
        whole = n + m
        variances = [(n * v + m * w + n * m / whole * (b - a) ** 2) / whole for v, w, a, b in zip(variances, other_variances, means, other_means, strict=True)]
        means = [a + (b - a) * m / whole for a, b in zip(means, other_means, strict=True)]
        n = whole
    return n, means, variances


def ones_of(n: int, means: list[float]) -> int:
    """Rows of label 1, from moments whose last column is the target."""
    return round(n * means[-1])


def scales_of(variances: list[float]) -> list[float]:
    """Deviations, 1 for a constant feature."""
    return [math.sqrt(v) if v > 0 else 1.0 for v in variances]


def standardize(df: DataFrame, features: tuple[str, ...], means: list[float], scales: list[float]) -> DataFrame:
    return df.withColumns({f"z_{f}": (number(f) - m) / s for f, m, s in zip(features, means, scales, strict=True)})


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """label, n, weight = rows / (2 rows of the class)."""
    counts = df.groupBy(F.col(quoted(target)).cast("int").alias("label")).agg(F.count("*").alias("n"))
    whole = df.agg(F.count("*").alias("rows"))
    return counts.join(F.broadcast(whole)).select("label", "n", (F.col("rows") / (2 * F.col("n"))).alias("weight"))


def margin(features: tuple[str, ...], model: FoldModel):
    """Linear score of a row on standardised features."""
    return F.lit(model.intercept) + dot([(number(f) - m) / s for f, m, s in zip(features, model.means, model.scales, strict=True)], list(model.coefficients))


def fit_logistic(df: DataFrame, contract: FeatureContract, config: TrainingConfig, known: tuple | None = None) -> FoldModel:
    """``known``: :func:`moments` of the features and the target, if they were counted before."""
    features, y = contract.features, number(contract.target)
    n, means, variances = known or moments(df, (*features, contract.target))[None]
    positive, means = ones_of(n, means), means[:-1]
    scales = scales_of(variances[:-1])
    weight = F.when(y == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive)))
    scaled = standardize(df, features, means, scales).select(*(F.col(quoted(f"z_{f}")).alias(f"z{k}") for k, f in enumerate(features)), y.alias("y"), weight.alias("w"))
    vectors = VectorAssembler(inputCols=[f"z{k}" for k in range(len(features))], outputCol="x").transform(scaled).select("x", "y", "w")
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1 / (config.regularization * n), elasticNetParam=0.0, standardization=False, maxIter=config.max_iterations, tol=1e-9).fit(vectors)
    return FoldModel(tuple(means), tuple(scales), tuple(map(float, fitted.coefficients)), float(fitted.intercept))


#: Newton's steps end when one moves the parameters by less; the error left is about its square
STEP = 1e-7


def platt(scored: DataFrame) -> tuple[float, float]:
    """(slope, intercept) by Platt's targets, of rows (f, y): Newton's method, where a step is one aggregation.

    Margins are standardised meanwhile; a step that does not lower the loss is halved.
    """
    f, y = F.col("f"), F.col("y")
    n, ones, mean, deviation = scored.agg(F.count("*"), count_where(y == 1), F.avg(f), F.stddev_pop(f)).first()
    deviation = deviation or 1.0
    t = F.when(y == 1, (ones + 1) / (ones + 2)).otherwise(1 / (n - ones + 2))
    rows = scored.select(((f - mean) / deviation).alias("x"), t.alias("t"))

    def at(a: float, b: float) -> tuple:
        """Mean loss, its gradient and its second derivatives."""
        z, x = F.lit(a) * F.col("x") + F.lit(b), F.col("x")
        told = rows.select(x, "t", z.alias("z"), logistic(-z).alias("p")).select(x, "t", "z", (F.col("t") - F.col("p")).alias("d"), (F.col("p") * (1 - F.col("p"))).alias("h"))
        loss = F.log1p(F.exp(-F.abs("z"))) + F.greatest(F.col("z"), F.lit(0.0)) - (1 - F.col("t")) * F.col("z")
        return told.agg(F.avg(loss), F.avg(F.col("d") * x), F.avg("d"), F.avg(F.col("h") * x * x), F.avg(F.col("h") * x), F.avg("h")).first()

    a, b = 0.0, math.log((n - ones + 1) / (ones + 1))
    now = at(a, b)
    for _ in range(100):
        _, ga, gb, haa, hab, hbb = now
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        da, db = (hab * gb - hbb * ga) / det, (hab * ga - haa * gb) / det
        if max(abs(da), abs(db)) < STEP:
            a, b = a + da, b + db
            break
        new = at(a + da, b + db)
        while not new[0] <= now[0] + 1e-13 * abs(now[0]) and max(abs(da), abs(db)) >= STEP:
            da, db = da / 2, db / 2
            new = at(a + da, b + db)
        a, b, now = a + da, b + db, new
    else:
        raise ModelError("The calibration did not converge")
    return a / deviation, b - a * mean / deviation


def calibrate(held: DataFrame, contract: FeatureContract, model: FoldModel, method: str) -> Calibrator:
    """A calibrator on rows that the fold's model hasn't seen."""
    scored = held.select(margin(contract.features, model).alias("f"), number(contract.target).alias("y"))
    if method == "isotonic":
        fitted = IsotonicRegression(featuresCol="f", labelCol="y").fit(scored)
        return Calibrator("isotonic", boundaries=tuple(map(float, fitted.boundaries)), values=tuple(map(float, fitted.predictions)))
    kept = scored.persist()
    try:
        return Calibrator("sigmoid", *platt(kept))
    finally:
        kept.unpersist()


def fit_folds(train: DataFrame, contract: FeatureContract, config: TrainingConfig, fitted: list[FoldModel] | None = None) -> list[FoldModel]:
    """One calibrated model a fold (column ``fold``), or one plain model without calibration.

    ``fitted``: models of the same folds and configuration which only get other calibrators.
    """
    if config.calibration_method == "none":
        return [fit_logistic(train, contract, config)]
    # the target is counted along, so no fold needs another pass for its classes
    parts = moments(train, (*contract.features, contract.target), "fold")
    if len(parts) != config.calibration_folds or (fitted and len(fitted) != len(parts)):
        raise ModelError("Some calibration folds are empty")

    def one(place: int, fold: int) -> FoldModel:
        model = fitted[place] if fitted else fit_logistic(train.where(F.col("fold") != fold), contract, config, pooled([parts[k] for k in sorted(parts) if k != fold]))
        calibrator = calibrate(train.where(F.col("fold") == fold), contract, model, config.calibration_method)
        return FoldModel(model.means, model.scales, model.coefficients, model.intercept, calibrator)

    jobs = config.calibration_folds if config.calibration_jobs == -1 else config.calibration_jobs
    with ThreadPoolExecutor(jobs) as pool:
        return list(pool.map(one, range(len(parts)), sorted(parts)))
