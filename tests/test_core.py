"""Golden values and bad inputs of the toolkit's operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.contracts import DataError, DriftError, FeatureContract, ModelError, RiskError, SchemaError, TrainingConfig
from riskframe.operators import drift, fit, metrics, score, split, threshold, validate
from riskframe.operators.curves import score_groups
from riskframe.operators.fingerprint import fingerprint
from riskframe.operators.prefix import ranked, running
from riskframe.plans.train import train
from riskframe.sources import artifact, generate, staging, tables
from riskframe.streaming import requests


def scored(spark, y, p):
    return spark.createDataFrame(list(zip(y, map(float, p), strict=True)), "label int, score double")


def test_f1_threshold(spark):
    groups = score_groups(scored(spark, [0, 0, 0, 1, 1], [0.05, 0.2, 0.4, 0.45, 0.9]), "label", "score")
    assert threshold.f1_threshold(groups).first().threshold == 0.45


def test_metrics(spark):
    r = metrics.evaluate(scored(spark, [0, 0, 1, 1], [0.1, 0.8, 0.6, 0.9]), "label", "score", 0.5).first()
    assert r.precision == pytest.approx(2 / 3) and r.recall == 1 and r.f1 == pytest.approx(0.8) and r.brier_score == pytest.approx(0.205) and r.balanced_accuracy == 0.75
    assert (r.true_negatives, r.false_positives, r.false_negatives, r.true_positives) == (1, 1, 0, 2) and r.roc_auc == 0.75


def test_cost_threshold(spark):
    df = scored(spark, [0, 0, 0, 1], [0.1, 0.4, 0.8, 0.7])
    groups = score_groups(df, "label", "score")
    best = threshold.cost_threshold(groups, 1.0, 10.0).first()
    assert best.threshold == 0.7 and best.expected_cost == 0.25
    assert threshold.cost_threshold(groups, 10.0, 1.0).first().threshold == 1.0
    assert metrics.expected_cost(metrics.confusion(df, "label", "score", 0.7), 1.0, 10.0).first()[0] == 0.25


@pytest.mark.parametrize(("y", "p"), [([0, 0], [math.nan, 0.1]), ([0, 1], [0.1, 1.2]), ([], []), ([0, 2], [0.1, 0.2])])
def test_bad_scores(spark, y, p):
    with pytest.raises(DataError):
        metrics.evaluate(scored(spark, y, p), "label", "score", 0.5)


def test_bad_thresholds_and_costs(spark):
    with pytest.raises(ModelError):
        metrics.confusion(scored(spark, [1], [0.5]), "label", "score", 1.5)
    with pytest.raises(ModelError):
        threshold.cost_threshold(score_groups(scored(spark, [1], [0.5]), "label", "score"), 0.0, 1.0)


@pytest.mark.parametrize(
    ("schema", "rows", "says"),
    [
        ("x double, Class int", [], "empty"), ("x double", [(1.0,)], "Target column"), ("Class int", [(1,)], "at least one feature"), ("x string, Class int", [("a", 1)], "must be numeric"),
        ("x double, Class int", [(math.nan, 1)], "missing values"), ("x double, Class int", [(1.0, None)], "Target column contains"), ("x double, Class int", [(math.inf, 1)], "infinite values"),
        ("x double, Class int", [(1.0, 0)], "exactly the labels"), ("x double, Class string", [(1.0, "a")], "must be numeric"), ("x boolean, Class int", [(True, 1)], "must be numeric"),
    ],
)
def test_bad_tables(spark, schema, rows, says):
    with pytest.raises(DataError, match=says):
        validate.validate(spark.createDataFrame(rows, schema), "Class")


def test_names(spark):
    with pytest.raises(DataError, match="Duplicate"):
        validate.validate(spark.createDataFrame([(1.0, 2.0, 1)], T.StructType([T.StructField(n, T.DoubleType() if n == "x" else T.IntegerType()) for n in ("x", "x", "Class")])), "Class")
    with pytest.raises(DataError, match="must not be empty"):
        validate.validate(spark.createDataFrame([(1.0, 1)], T.StructType([T.StructField("", T.DoubleType()), T.StructField("Class", T.IntegerType())])), "Class")
    ok = validate.validate(spark.createDataFrame([(1.0, True), (2.0, False)], "`a.b` double, Class boolean"), "Class")
    assert ok.features == ("a.b",)


def test_capacity_and_folds(spark):
    counts = lambda a, b: {0: a, 1: b}
    with pytest.raises(DataError, match="at least 6"):
        split.check_capacity(counts(15, 5), TrainingConfig())
    with pytest.raises(DataError, match="too small"):
        split.check_capacity(counts(114, 6), TrainingConfig(test_size=0.05, validation_size=0.05))
    rows = spark.range(100).withColumn("Class", (F.col("id") >= 90).cast("int")).withColumn("Time", F.col("id").cast("double"))
    contract = FeatureContract(("Time",), "Class", ("id",))
    with pytest.raises(DataError, match="both classes"):
        split.split(rows, contract, TrainingConfig(split_strategy="temporal"))
    with pytest.raises(DataError, match="folds"):
        split.assign_folds(rows.where("id < 95"), contract, 10, [F.col("id")])
    parts = split.split(rows, contract, TrainingConfig()).groupBy("split").agg(F.count("*").alias("n"), F.sum("Class").alias("p")).collect()
    assert {r.split: (r.n, r.p) for r in parts} == {"train": (60, 6), "validation": (20, 2), "test": (20, 2)}
    again = split.split(rows.repartition(7), contract, TrainingConfig()).where("split = 'test'").select("id").collect()
    assert sorted(again) == sorted(split.split(rows, contract, TrainingConfig()).where("split = 'test'").select("id").collect())


@pytest.mark.parametrize("bad", [{"test_size": 0.01}, {"test_size": 0.4, "validation_size": 0.3}, {"max_iterations": 9}, {"regularization": 0.0}, {"threshold_strategy": "x"}, {"false_positive_cost": math.inf}, {"calibration_method": "x"}, {"calibration_folds": 1}, {"calibration_jobs": 0}, {"split_strategy": "x"}, {"time_column": " "}])
def test_bad_configs(bad):
    with pytest.raises(ModelError):
        TrainingConfig(**bad)


def test_running_sums(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("v", F.col("id") % 7)
    got = running(df.repartition(5), ["g"], [F.col("id").desc()], {"s": "v"}).toPandas().sort_values("id", ascending=False)
    assert (got["s"] == got.groupby("g")["v"].cumsum()).all()
    assert ranked(df, [], [F.col("id")]).where(F.col("rank") != F.col("id") + 1).isEmpty()


def test_drift_golden(spark):
    df = spark.range(1000).select((1 + F.col("id") * (99 / 999)).alias("amount"), (F.col("id") % 10).cast("int").alias("velocity"))
    detail, summary = drift.assess_drift(drift.build_profile(df, ["amount", "velocity"]), df)
    assert [r.feature for r in detail.collect()] == ["amount", "velocity"] and summary.first()[1:] == (0.0, 0.0, "stable")
    two = df.select("amount", (F.col("amount") + F.lit(0)).alias("shifted"))
    moved = two.withColumn("shifted", F.col("shifted") + 500)
    top = drift.assess_drift(drift.build_profile(two, ["amount", "shifted"]), moved)[0].collect()
    assert (top[0].feature, top[0].status, top[1].status) == ("shifted", "drifted", "stable")
    profile = spark.createDataFrame([("x", 0, [0.5], [0.5, 0.5], 0.5, 0.5)], drift.PROFILE)
    current = spark.range(100).select((F.col("id") >= 68).cast("double").alias("x"))
    assert drift.assess_drift(profile, current)[1].first().status == "warning"
    with pytest.raises(DriftError, match="overflow"):
        drift.build_profile(spark.range(20).select(F.when(F.col("id") % 2 == 0, 1e308).otherwise(-1e308).alias("x")), ["x"])
    for method in ("selected", "approx"):
        assert drift.build_profile(df, ["amount"], 4, method).first().interior_edges == pytest.approx([25.75, 50.5, 75.25], abs=0.2)


@pytest.mark.parametrize("row", [("", 0, [0.5], [0.5, 0.5]), ("x", 0, None, [1.0]), ("x", 0, [math.nan], [0.5, 0.5]), ("x", 0, [1.0, 1.0], [0.3, 0.3, 0.4]), ("x", 0, [0.5], [1.0]), ("x", 0, [0.5], [-0.5, 1.5]), ("x", 0, [0.5], [0.4, 0.4])])
def test_bad_profiles(spark, row):
    profile = spark.createDataFrame([(*row, 0.0, 1.0)], drift.PROFILE)
    with pytest.raises(DriftError):
        drift.assess_drift(profile, spark.createDataFrame([(1.0,)], "x double"))


def test_gradient_is_zero(spark):
    df = generate.transactions(spark, 600, 0.2).select("id", "V1", "V2", "V3", "Class")
    contract = FeatureContract(("V1", "V2", "V3"), "Class", ("id",))
    model, rows = fit.fit_logistic(df, contract, TrainingConfig(regularization=0.7)), df.toPandas()
    y = rows["Class"].to_numpy()
    w = [len(y) / (2 * (y == c).sum()) for c in y]
    z = (rows[["V1", "V2", "V3"]].to_numpy() - model.means) / model.scales
    p = 1 / (1 + math.e ** -(z @ model.coefficients + model.intercept))
    slope = [c + 0.7 * sum(w * (p - y) * z[:, k]) for k, c in enumerate(model.coefficients)] + [0.7 * sum(w * (p - y))]
    assert max(map(abs, slope)) < 1e-3


@pytest.mark.parametrize("how", [{"calibration_method": "none"}, {"calibration_method": "sigmoid"}, {"calibration_method": "isotonic", "split_strategy": "temporal", "threshold_strategy": "cost", "calibration_jobs": -1}])
def test_train_store_score(spark, tmp_path, how):
    df = generate.transactions(spark, 1500, 0.08)
    model = train(df, key=("id",), config=TrainingConfig(**how))
    assert model.card["metrics"]["test"]["roc_auc"] > 0.7 and sum(model.card["splits"].values()) == 1500
    assert [e["rank"] for e in model.card["feature_effects"]] == list(range(1, 31)) and len(model.effects(spark, 3).collect()) == 3
    out = model.score(df.select(*reversed(df.columns)))
    p = {r.id: r.fraud_probability for r in out.collect()}
    path = artifact.save(model, spark, str(tmp_path / "model"))
    loaded = artifact.load(spark, path)
    assert {r.id: r.fraud_probability for r in loaded.score(df).collect()} == p and loaded.model_version == model.model_version
    with pytest.raises(RiskError, match="exists"):
        artifact.save(model, spark, path)
    body = df.where("id < 3").select("id", F.to_json(F.struct(F.array(F.struct(*model.contract.features)).alias("transactions"))).alias("body"))
    answered = requests.score_requests(body, model.contract.features, model.folds, model.threshold, model.model_version).collect()
    assert all(r.reason is None and r.answer.predictions[0].fraud_probability == pytest.approx(p[r.id]) for r in answered)
    features = df.drop("id", "Class")
    for bad in (features.drop("V1"), features.withColumn("extra", F.lit(1)), features.withColumn("V1", F.lit("x")), features.withColumn("V1", F.lit(math.nan)), features.limit(0)):
        with pytest.raises(SchemaError):
            model.score(bad)
    part = next((tmp_path / "model" / "params").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ModelError, match="manifest"):
        artifact.load(spark, path)


def test_tampered_cards(spark, tmp_path):
    model = train(generate.transactions(spark, 600, 0.1), key=("id",), config=TrainingConfig(calibration_method="none"))
    for change in ({"feature_count": 1}, {"feature_names": ["x"]}, {"artifact_version": 1}, {"created_at": ""}, {"dataset": {"fingerprint": "xyz"}}, {"threshold": math.nan}):
        kept = dict(model.card)
        model.card.update(change)
        with pytest.raises(ModelError):
            artifact.save(model, spark, str(tmp_path / "m"))
        model.card.clear()
        model.card.update(kept)
    assert not (tmp_path / "m").exists()
    with pytest.raises(ModelError, match="No manifest"):
        artifact.load(spark, str(tmp_path))


def test_generated_rows_and_fingerprint(spark):
    a, b = generate.transactions(spark, 500, 0.05, 7), generate.transactions(spark, 500, 0.05, 7).repartition(3)
    contract = FeatureContract(tuple(c for c in a.columns if c not in ("id", "Class")), "Class", ("id",))
    assert fingerprint(a, contract) == fingerprint(b, contract) != fingerprint(a.where("id > 0"), contract)
    assert a.columns[1] == "Time" and len(contract.features) == 30
    with pytest.raises(DataError):
        generate.transactions(spark, 100)


def test_generated_rows_are_checked_without_shuffling_them(spark, tmp_path):
    from riskframe.plans import checks

    spark.range(20_000).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    a, b = (generate.transactions(spark, 500, 0.05, 7, k) for k in (1, 5))
    assert (a.rdd.getNumPartitions(), b.rdd.getNumPartitions()) == (1, 5) and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    made, real = [], generate.transactions
    try:
        generate.transactions = lambda *how: made.append(real(*how)) or made[-1]
        row = checks.generated_table(spark, str(tmp_path)).first()
    finally:
        generate.transactions = real
    assert row.n_rows == row.n_ids == 20_000 and row.repeatable
    assert len({df.rdd.getNumPartitions() for df in made}) == 2 and not any("Exchange" in df._jdf.queryExecution().executedPlan().toString() for df in made)


def test_csv(spark, tmp_path):
    (tmp_path / "twice.csv").write_text("amount,amount,Class\n1,2,0\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "bom.csv").write_text("﻿x,Class\n1.5,0\n2,1\n", encoding="utf-8")
    for name, says in (("twice.csv", "unique"), ("none.csv", "empty"), ("absent.csv", "No such")):
        with pytest.raises(DataError, match=says):
            tables.read_labelled(spark, str(tmp_path / name))
    df, contract = tables.read_labelled(spark, str(tmp_path / "bom.csv"))
    assert contract.features == ("x",) and df.count() == 2
    out = str(tmp_path / "out")
    tables.write_csv(df, out)
    with pytest.raises(RiskError, match="exists"):
        tables.write_csv(df.limit(1), out)
    tables.write_csv(df.limit(1), out, overwrite=True)
    assert tables.read_csv(spark, out).count() == 1
    with pytest.raises(Exception, match="."):
        tables.write_csv(df.withColumn("bad", F.raise_error(F.lit("stop"))), out, overwrite=True)
    assert tables.read_csv(spark, out).count() == 1 and not [p for p in tmp_path.iterdir() if p.name.startswith("._")]


def test_requests(spark):
    good = '{"transactions": [{"a": 1, "b": 2.5}, {"b": 0, "a": 3}]}'
    bodies = [
        good, '{"transactions": []}', '{"transactions": [{"a": 1}]}', '{"transactions": [{"a": "1", "b": 2}]}', '{"transactions": [{"a": true, "b": 2}]}', '{"transactions": [{"a": Infinity, "b": 2}]}',
        '{"transactions": [{"a": 1e400, "b": 2}]}', '{"transactions": [{"a": null, "b": 2}]}', '{"transactions": [{"a": 1, "b": 2}], "x": 1}', "{}", "no json", None,
        '{"transactions": [' + ",".join(['{"a": 1, "b": 2}'] * 1001) + "]}", '{"transactions": [{"a": 1, "b": 2}], "pad": "' + "x" * 2_097_152 + '"}', '{"transactions": [{"a": 1, "b": 2, "c": 3}]}', '{"transactions": [null]}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    model = [fit.FoldModel((0.0, 0.0), (1.0, 1.0), (1.0, -1.0), 0.0)]
    got = {r.id: r for r in requests.score_requests(df, ("a", "b"), model, 0.5, "v").collect()}
    assert [k for k in got if got[k].reason is None] == [0] and all(got[k].response is None for k in got if k)
    assert [round(p.fraud_probability, 6) for p in got[0].answer.predictions] == [round(1 / (1 + math.e**1.5), 6), round(1 / (1 + math.e**-3), 6)]
    assert got[8].reason == "unknown field" and got[13].reason == "body is too large" and got[12].reason == "number of transactions" and got[14].reason == got[2].reason == "feature schema mismatch"
    ids = spark.createDataFrame([("audit-request_123",), ("unsafe id value",), ("abc\n",), ("",), (None,), ("x" * 129,)], "id string")
    safe = [r[0] for r in ids.select(requests.correlation_id(F.col("id"), F.lit("body"))).collect()]
    assert safe[0] == "audit-request_123" and len({*safe[1:]}) == 1 and len(safe[1]) == 32


def test_long_boundaries_are_searched_in_two_steps(spark):
    boundaries = tuple(float(k * k) for k in range(300))
    values = tuple(k / 300 for k in range(300))
    rows = [(x,) for x in (-5.0, 0.0, 0.5, 1.0, 143.9, 144.0, 9999.0, 89401.0, 1e9)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(score._interpolated(F.col("x"), boundaries, values)).collect()]
    assert got == pytest.approx([float(np.interp(x, boundaries, values)) for (x,) in rows])


def test_tables_are_kept_and_discarded(spark):
    kept = staging.keep(spark.range(10))
    other = staging.again(kept)
    assert kept.join(other, "id").count() == 10 and staging.exists(spark, kept._kept_at)
    staging.discard(kept)
    assert not staging.exists(spark, kept._kept_at)
