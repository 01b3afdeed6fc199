"""Training: split, fit, calibrate, choose a threshold on validation rows, test once."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.contracts import FeatureContract, ModelError, TrainingConfig
from riskframe.functions import quoted
from riskframe.operators import drift
from riskframe.operators.curves import score_groups
from riskframe.operators.explain import coefficient_table, rank_effects, top_effects
from riskframe.operators.fingerprint import fingerprint
from riskframe.operators.fit import FoldModel, fit_folds
from riskframe.operators.metrics import evaluate, expected_cost
from riskframe.operators.score import add_scores, check_scores, score_table
from riskframe.operators.split import assign_folds, row_order, split, split_ranges, split_sizes, with_place
from riskframe.operators.threshold import cost_threshold, f1_threshold
from riskframe.operators.validate import dataset_summary, labelled, validate
from riskframe.sources.staging import discard, keep

VERSION = 2


@dataclass
class RiskModel:
    contract: FeatureContract
    folds: list[FoldModel]
    threshold: float
    card: dict = field(default_factory=dict)
    version: int = VERSION

    def score(self, df: DataFrame, **how) -> DataFrame:
        """Probability and decision beside all columns of a checked table."""
        return score_table(df, self.contract, self.folds, self.threshold, **how)

    def score_lazily(self, df: DataFrame) -> DataFrame:
        """As :meth:`score`, without checks: for streams."""
        return add_scores(df, self.contract.features, self.folds, self.threshold)

    def effects(self, spark, top: int | None = None) -> DataFrame:
        ranked = rank_effects(coefficient_table(spark, self.contract.features, self.folds))
        return ranked if top is None else top_effects(ranked, top)

    def profile(self, spark) -> DataFrame:
        rows = [(r["feature"], k, r["interior_edges"], r["proportions"], r["mean"], r["standard_deviation"]) for k, r in enumerate(self.card["reference_profile"])]
        return spark.createDataFrame(rows, drift.PROFILE)

    @property
    def model_version(self) -> str:
        return self.card["dataset"]["fingerprint"][:12]


def _quality(scored: DataFrame, target: str, threshold: float, config: TrainingConfig, groups: DataFrame | None = None) -> dict:
    row = evaluate(scored, target, "_p", threshold, groups, checked=True)
    cost = expected_cost(row.select("true_negatives", "false_positives", "false_negatives", "true_positives"), config.false_positive_cost, config.false_negative_cost)
    return row.first().asDict() | {"expected_cost_per_transaction": cost.first()[0]}


def assess(parts: DataFrame, contract: FeatureContract, folds: list[FoldModel], config: TrainingConfig) -> tuple[float, dict[str, dict]]:
    """The threshold that validation rows choose, and the quality at it of validation and test rows. parts: with ``split``."""
    target = contract.target
    scored = keep(add_scores(parts, contract.features, folds, 0.5, "_p", "_flag").select("split", F.col(quoted(target)), "_p"))
    check_scores(scored, "_p")
    rows = {name: scored.where(F.col("split") == name) for name in ("validation", "test")}
    groups = {name: score_groups(own, target, "_p") for name, own in rows.items()}
    chosen = f1_threshold(groups["validation"]) if config.threshold_strategy == "f1" else cost_threshold(groups["validation"], config.false_positive_cost, config.false_negative_cost)
    threshold = float(chosen.first().threshold)
    metrics = {name: _quality(own, target, threshold, config, groups[name]) for name, own in rows.items()}
    discard(scored)
    return threshold, metrics


def divided(df: DataFrame, contract: FeatureContract, config: TrainingConfig) -> tuple[DataFrame, DataFrame]:
    """(all rows with ``split``, the training rows; with ``fold`` if the configuration calibrates), kept.

    The given table is read once. Splits and folds are cut in one order, whose positions are written beside the rows.
    """
    order, place = row_order(contract, config), f"_place_{uuid.uuid4().hex[:8]}"
    read = keep(with_place(labelled(df, contract), order, place))
    placed = keep(split(read, contract, config, place))
    discard(read)
    parts, train_rows = placed.drop(place), placed.where("split = 'train'").drop("split")
    parts._kept_at = placed._kept_at
    if config.calibration_method == "none":
        return parts, train_rows.drop(place)
    return parts, keep(assign_folds(train_rows, contract, config.calibration_folds, order, place).drop(place))


def train(df: DataFrame, target: str = "Class", key: tuple[str, ...] = (), config: TrainingConfig | None = None) -> RiskModel:
    config = config or TrainingConfig()
    spark, contract = df.sparkSession, validate(df, target, key)
    parts, train_rows = divided(df, contract, config)
    kept = [parts]
    if config.calibration_method != "none":
        kept.append(train_rows)
    folds = fit_folds(train_rows, contract, config)

    threshold, metrics = assess(parts, contract, folds, config)
    profile = drift.build_profile(train_rows, contract.features, config.bins)
    summary = dataset_summary(parts, target).first()
    ranges = None
    if config.split_strategy == "temporal":
        ranges = {r.split: [r.t_min, r.t_max] for r in split_ranges(parts, target, config.time_column).collect()}
    card = {
        "artifact_version": VERSION, "created_at": datetime.now(UTC).isoformat(), "spark_version": pyspark.__version__, "config": asdict(config),
        "target": target, "key": list(key), "feature_names": list(contract.features), "feature_count": len(contract.features), "threshold": threshold,
        "dataset": {"rows": summary.n_rows, "positives": summary.n_positive, "positive_rate": summary.positive_rate, "fingerprint": fingerprint(parts, contract)},
        "splits": {r.split: r.n for r in split_sizes(parts, target).collect()}, "split_time_ranges": ranges,
        "metrics": metrics,
        "reference_profile": [r.asDict() for r in profile.drop("ordinal").collect()],
    }
    model = RiskModel(contract, folds, threshold, card)
    card["feature_effects"] = [r.asDict() for r in model.effects(spark).collect()]
    discard(*kept)
    return model


def check_model(model: RiskModel) -> RiskModel:
    """The parts of a model fit each other."""
    card, features = model.card, list(model.contract.features)
    if model.version != VERSION or card.get("artifact_version") != VERSION:
        raise ModelError("The artifact has another version")
    if isinstance(model.threshold, bool) or not isinstance(model.threshold, (int, float)) or not 0 <= model.threshold <= 1:
        raise ModelError("The threshold must be a number between 0 and 1")
    if not features or len(set(features)) < len(features) or any(not isinstance(f, str) or not f.strip() for f in features):
        raise ModelError("Feature names must be unique and not empty")
    if card.get("feature_names") != features or card.get("feature_count") != len(features) or not card.get("created_at"):
        raise ModelError("The model card does not describe the model")
    mark = card.get("dataset", {}).get("fingerprint", "")
    if len(mark) != 64 or set(mark) - set("0123456789abcdef"):
        raise ModelError("The fingerprint must have 64 hex digits")
    if not model.folds or any(not len(m.means) == len(m.scales) == len(m.coefficients) == len(features) for m in model.folds):
        raise ModelError("The parameters do not fit the features")
    return model
