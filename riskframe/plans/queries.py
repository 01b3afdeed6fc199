"""The registered queries. T is a labelled table of events, M a scored table of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.contracts import FeatureContract, TrainingConfig
from riskframe.functions import number
from riskframe.operators import curves, drift, explain, fit, metrics, score, split, threshold, validate
from riskframe.operators.fingerprint import fingerprint
from riskframe.plans.train import RiskModel, train
from riskframe.sources import artifact, tables
from riskframe.sources.staging import keep, shared_path
from riskframe.streaming import requests

FEATURES = ("value", "k", "user_id", "hour")
CONTRACT = FeatureContract(FEATURES, "label", ("event_id",))
CONFIG = TrainingConfig(time_column="ts")
DRIFT_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
#: two folds of given parameters for the queries that score without training
FOLDS = [
    fit.FoldModel((250.0, 50.0, 50.0, 11.5), (140.0, 29.0, 29.0, 6.9), (0.31, -0.22, 0.05, 0.4), -1.2, fit.Calibrator("sigmoid", -1.1, 0.2)),
    fit.FoldModel((240.0, 49.0, 51.0, 11.0), (150.0, 28.0, 30.0, 7.0), (0.28, -0.2, 0.07, 0.35), -1.1),
]
K_MODEL = [fit.FoldModel((50.0,), (29.0,), (0.8,), -0.5)]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", F.col("value"), F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("user_id").cast("double").alias("user_id"),
        F.hour("ts").cast("double").alias("hour"), (F.col("event_type") == "error").cast("tinyint").alias("label"),
    )


def scored_items(spark: SparkSession, sf_dir: str, ties: bool = False) -> DataFrame:
    p = F.col("l_quantity") / 50 if ties else F.col("l_extendedprice") / 105000
    return load(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("tinyint").alias("label"), p.alias("score"))


def _rounded(df: DataFrame, places: int = 9, **also: int) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, also.get(c, places)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns))


def validation_report(spark, d):
    return validate.validation_report(event_table(spark, d), [*FEATURES, "label"])


def schema_diff(spark, d):
    return validate.key_differences(load(spark, d, "events"), "props", ("k", "v"))


def dataset_summary(spark, d):
    return _rounded(validate.dataset_summary(event_table(spark, d), "label"))


def split_stratified_rows(spark, d):
    return split.stratified_split(event_table(spark, d), CONTRACT, CONFIG).select("event_id", "split")


def split_stratified_counts(spark, d):
    return split.split_sizes(split.stratified_split(event_table(spark, d), CONTRACT, CONFIG), "label")


def split_temporal_ranges(spark, d):
    return split.split_ranges(split.temporal_split(event_table(spark, d), CONTRACT, CONFIG), "label", "ts")


def capacity_check(spark, d):
    labels = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return split.capacity_report(labels, "toxic", TrainingConfig(test_size=0.05, validation_size=0.05))


def fold_assignment(spark, d):
    return split.assign_folds(event_table(spark, d), CONTRACT, 3, [F.col("ts"), F.col("event_id")]).select("event_id", "fold")


def standardize(spark, d):
    t = event_table(spark, d)
    _, means, variances = fit.moments(t, FEATURES)[None]
    return _rounded(fit.standardize(t, FEATURES, means, fit.scales_of(variances)).select("event_id", *(f"z_{f}" for f in FEATURES)), 6)


def class_weights(spark, d):
    return _rounded(fit.class_weights(event_table(spark, d), "label"))


def _scored_events(spark, d):
    return score.add_scores(event_table(spark, d), FEATURES, FOLDS, 0.25)


def score_fixed_model(spark, d):
    return _scored_events(spark, d).select("event_id", F.round("fraud_probability", 6).alias("fraud_probability"), "is_fraud")


def score_summary(spark, d):
    return score.score_summary(_scored_events(spark, d))


def confusion(spark, d):
    return metrics.confusion(scored_items(spark, d), "label", "score", 0.5)


def evaluate_metrics(spark, d):
    return _rounded(metrics.evaluate(scored_items(spark, d), "label", "score", 0.5))


def evaluate_metrics_ties(spark, d):
    return _rounded(metrics.evaluate(scored_items(spark, d, True), "label", "score", 0.5))


def pr_curve(spark, d):
    return _rounded(curves.pr_curve(curves.score_groups(scored_items(spark, d), "label", "score")))


def roc_curve(spark, d):
    return _rounded(curves.roc_curve(curves.score_groups(scored_items(spark, d), "label", "score")))


def threshold_f1(spark, d):
    return _rounded(threshold.f1_threshold(curves.score_groups(scored_items(spark, d), "label", "score")))


def threshold_cost(spark, d):
    return _rounded(threshold.cost_threshold(curves.score_groups(scored_items(spark, d, True), "label", "score"), 1.0, 3.0))


def expected_cost(spark, d):
    return _rounded(metrics.expected_cost(confusion(spark, d), 1.0, 10.0))


def _halves(spark, d):
    items = load(spark, d, "lineitem")
    early = F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp_ntz")
    return items.where(early), items.where(~early)


def _profile(spark, d, method="selected"):
    return drift.build_profile(_halves(spark, d)[0], DRIFT_FEATURES, 10, method)


def reference_profile(spark, d):
    p = _profile(spark, d)
    return _rounded(p.select("feature", "ordinal", F.size("interior_edges").alias("n_edges"), "mean", "standard_deviation"), 6)


def profile_bins(spark, d):
    return _rounded(drift.profile_bins(_profile(spark, d, "exact")))


def profile_bins_sorted(spark, d):
    return _rounded(drift.profile_bins(_profile(spark, d, "selected")))


def drift_features(spark, d):
    return _rounded(drift.assess_drift(_profile(spark, d), _halves(spark, d)[1].select(*DRIFT_FEATURES))[0])


def drift_summary(spark, d):
    return _rounded(drift.assess_drift(_profile(spark, d), _halves(spark, d)[1].select(*DRIFT_FEATURES))[1])


def profile_validity(spark, d):
    """Whether counts by ship month make valid profiles of each return flag's quantities."""
    share = load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", (F.col("l_quantity") > 25).alias("high")).agg(F.count("*").alias("n"))
    rows = share.groupBy(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("feature")).agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("high", "n"))).alias("bins"))
    # edges of a flag that has one bin only do not fit
    profile = rows.select("feature", F.lit(0).alias("ordinal"), F.array(F.lit(25.0)).alias("interior_edges"), F.transform("bins", lambda b: b["n"] / F.col("all")).alias("proportions"))
    return drift.profile_faults(profile)


def _coefficients(spark, d):
    folds = split.assign_folds(event_table(spark, d), CONTRACT, 3, [F.col("ts"), F.col("event_id")])
    one = folds.groupBy("fold").agg(*(F.corr(number(f), number("label")).alias(f) for f in FEATURES))
    return one.select("fold", F.inline(F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(f).alias("feature"), F.col(f).alias("coefficient")) for k, f in enumerate(FEATURES)))))


def feature_effects(spark, d):
    return _rounded(explain.rank_effects(_coefficients(spark, d)), 9)


def feature_effects_top(spark, d):
    return _rounded(explain.top_effects(explain.rank_effects(_coefficients(spark, d)), 2), 9)


def _bodies(events: DataFrame) -> DataFrame:
    """A request an event: its props, in forms that are valid or not by its type."""
    p = F.col("props")
    body = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"transactions": ['), p, F.lit("]}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"transactions": ['), p, F.lit(", "), p, F.lit("]}")))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"transactions": ['), p, F.lit('], "extra": 1}')))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"transactions": ['), F.replace(p, F.lit('"k"'), F.lit('"q"')), F.lit("]}")))
        .otherwise(F.concat(F.lit('{"transactions": ['), F.replace(p, F.lit(": "), F.lit(': "a')), F.lit("]}")))
    )
    return events.select("event_id", body.alias("body"))


def _answers(spark, d):
    return requests.score_requests(_bodies(load(spark, d, "events")), ("k",), K_MODEL, 0.5, "fixed")


def score_requests(spark, d):
    first = F.col("answer.predictions")[0]
    return requests.accepted(_answers(spark, d)).select(
        "event_id", F.size("answer.predictions").alias("n_predictions"), F.round(first["fraud_probability"], 6).alias("fraud_probability"), first["is_fraud"].alias("is_fraud")
    )


def request_rejects(spark, d):
    return requests.rejected(_answers(spark, d), ["event_id"]).groupBy("reason").agg(F.count("*").alias("n_requests"))


def stream_score_requests(spark, d):
    """The same requests as a file stream, read to its end into a table."""
    schema = load(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/events.parquet*")
    scored = requests.score_requests(_bodies(stream), ("k",), K_MODEL, 0.5, "fixed").select("event_id", "reason", "response")
    out, checkpoint = shared_path(spark), shared_path(spark)
    query = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("event_id long, reason string, response string").parquet(out).groupBy("reason").agg(F.count("*").alias("n_requests"), F.count("response").alias("n_responses"))


def _trained(spark, d, **how) -> RiskModel:
    return train(event_table(spark, d), "label", ("event_id", "ts"), TrainingConfig(time_column="ts", **how))


def _held_out(spark, d, **how):
    t = event_table(spark, d)
    return _trained(spark, d, **how).score(t).select("event_id", "label", "fraud_probability", "is_fraud")


def train_uncalibrated(spark, d):
    return _held_out(spark, d, calibration_method="none")


def train_sigmoid(spark, d):
    return _held_out(spark, d, calibration_method="sigmoid", calibration_jobs=-1)


def train_isotonic(spark, d):
    return _held_out(spark, d, calibration_method="isotonic", split_strategy="temporal", threshold_strategy="cost")


def model_card(spark, d):
    card = _trained(spark, d, calibration_method="none").card
    return spark.createDataFrame([(artifact.dump_card(card), card["feature_count"], card["threshold"], card["dataset"]["rows"])], "card string, feature_count int, threshold double, n_rows long")


def dataset_fingerprint(spark, d):
    t = event_table(spark, d)
    return t.agg(F.count("*").alias("n_rows")).withColumn("fingerprint", F.lit(fingerprint(t, CONTRACT)))


def artifact_roundtrip(spark, d):
    path = artifact.save(_trained(spark, d, calibration_method="none"), spark, shared_path(spark))
    return artifact.load(spark, path).score(event_table(spark, d)).select("event_id", "fraud_probability", "is_fraud")


def manifest_check(spark, d):
    path = artifact.save(_trained(spark, d, calibration_method="none"), spark, shared_path(spark))
    manifest = spark.read.schema("path string, sha256 string, length long").json(f"{path}/manifest")
    found = artifact.file_digests(spark, path).where("path NOT LIKE 'manifest/%'")
    return found.agg(F.count("*").alias("n_files")).join(F.broadcast(artifact.manifest_differences(found, manifest).agg(F.count("*").alias("n_differences"))))


def csv_roundtrip(spark, d):
    orders, path = load(spark, d, "orders"), shared_path(spark)
    tables.write_csv(orders, path)
    return tables.read_csv(spark, path, orders.schema)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, split by time, fitted without calibration, scored: the test rows."""
    t = event_table(spark, sf_dir)
    parts = keep(split.split(validate.labelled(t.withColumn("time", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts"), FeatureContract((*FEATURES, "time"), "label", ("event_id",))), CONTRACT, TrainingConfig(split_strategy="temporal", time_column="time")))
    model = fit.fit_logistic(parts.where("split = 'train'"), CONTRACT, CONFIG)
    return score.add_scores(parts.where("split = 'test'"), FEATURES, [model], 0.5).select("event_id", "label", "fraud_probability", "is_fraud")


_NAMES = (
    "validation_report schema_diff dataset_summary split_stratified_rows split_stratified_counts split_temporal_ranges capacity_check fold_assignment standardize class_weights "
    "score_fixed_model score_summary confusion evaluate_metrics evaluate_metrics_ties pr_curve roc_curve threshold_f1 threshold_cost expected_cost reference_profile profile_bins "
    "profile_bins_sorted drift_features drift_summary profile_validity feature_effects feature_effects_top score_requests request_rejects stream_score_requests train_uncalibrated "
    "train_sigmoid train_isotonic model_card dataset_fingerprint artifact_roundtrip manifest_check csv_roundtrip"
).split()
QUERIES = {name: globals()[name] for name in _NAMES}
