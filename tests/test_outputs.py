import math
import random
import time

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from riskframe.contracts import FeatureContract, ModelError, RiskError, SchemaError, TrainingConfig
from riskframe.operators import cutoffs, drift, fingerprint, fit, knots, observed, score, split, wide
from riskframe.plans import outputs, proofs
from riskframe.sources import staging, versions
from riskframe.streaming import drift as windows
from riskframe.streaming import sinks

AB = FeatureContract(("a", "b"), None, ("id",))
MODEL = [fit.FoldModel((0.0, 1.0), (1.0, 2.0), (1.0, -1.0), 0.1), fit.FoldModel((0.5, 0.0), (1.0, 1.0), (0.3, 0.2), 0.0, fit.Calibrator("sigmoid", -1.2, 0.1))]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(k, rng.gauss(0, 1), rng.gauss(1, 2)) for k in range(500)], "id long, a double, b double").repartition(3)


def test_scores_are_published_by_one_job(spark, table):
    path, tracker = staging.shared_path(spark), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("published", "")
    report = observed.publish_scores(table, AB, MODEL, 0.5, path)
    jobs = tracker.getJobIdsForGroup("published")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # the jobs of one write: without its query stages there is none that counts or checks
    assert len(jobs) <= 2
    plain = score.score_table(table, AB, MODEL, 0.5)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(map(tuple, plain.collect()))
    assert report.n_rows == 500 and report.n_flagged == plain.where("is_fraud = 1").count() and report.features == {"a": (0, 0, 0), "b": (0, 0, 0)}


def test_faults_are_told_before_publication(spark, table):
    path = staging.shared_path(spark)
    observed.publish_scores(table, AB, MODEL, 0.5, path)
    cases = [
        (table.withColumn("a", F.when(F.col("id") < 3, None).otherwise(F.col("a"))), MODEL, SchemaError, "3 rows"), (table.where("false"), MODEL, SchemaError, "empty"),
        (table, [fit.FoldModel((0.0, 0.0), (1.0, 1.0), (float("nan"), 0.0), 0.0)], ModelError, "probabilities"), (table.drop("b"), MODEL, SchemaError, "missing"),
    ]
    for df, model, error, words in cases:
        with pytest.raises(error, match=words):
            observed.publish_scores(df, AB, model, 0.5, path, overwrite=True)
        assert spark.read.parquet(path).count() == 500
    target = staging.shared_path(spark)
    observed.publish_scores(table, AB, MODEL, 0.5, target, publisher=lambda s, p, write, overwrite: versions.publish_version(s, p, write, overwrite=True))
    assert versions.read_current(spark, target).count() == 500


def test_readers_see_old_or_new_when_a_write_is_killed(spark, monkeypatch):
    target = staging.shared_path(spark)
    versions.publish_version(spark, target, spark.range(3).write.parquet)
    old = versions.current(spark, target)
    with monkeypatch.context() as m:
        m.setattr(versions, "write_small", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            versions.publish_version(spark, target, spark.range(5).write.parquet)
    assert versions.current(spark, target) == old and versions.read_current(spark, target).count() == 3
    for n in (6, 7, 8):
        versions.publish_version(spark, target, spark.range(n).write.parquet)
        time.sleep(0.02)
    assert versions.read_current(spark, target).count() == 8 and len(versions.clean(spark, target, 2)) == 2
    assert versions.read_current(spark, target).count() == 8 and len(versions.versions(spark, target)) == 2
    with pytest.raises(RiskError):
        versions.read_current(spark, staging.shared_path(spark))


def test_batches_are_written_once(spark, monkeypatch):
    ledger = sinks.Ledger(spark, staging.shared_path(spark))
    write = sinks.writer(ledger, ["id"])
    batch = spark.createDataFrame([(1, None, None, "x"), (2, "bad", "e", None), (3, None, None, "y")], "id long, reason string, error string, response string")
    with monkeypatch.context() as m:
        m.setattr(sinks.Ledger, "enter", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            write(batch, 4)
    assert ledger.read("accepted") is None and ledger.batches() == {}
    for _ in range(3):
        write(batch, 4)
    write(batch.where("id = 1").withColumn("id", F.lit(9).cast("long")), 5)
    assert ledger.batches() == {4: {"accepted": 2, "rejected": 1}, 5: {"accepted": 1, "rejected": 0}}
    assert sorted(r.id for r in ledger.read("accepted").collect()) == [1, 3, 9] and [tuple(r)[:3] for r in ledger.read("rejected").select("id", "reason", "error").collect()] == [(2, "bad", "e")]
    with pytest.raises(RiskError):
        ledger.enter(4, {})


def test_cutoffs_and_splits_have_no_shuffle_and_equal_ranks(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["a", "b", None]), rng.gauss(0, 1), f"key{rng.randrange(40)}", rng.randrange(5) == 0) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, s string, x double, key string, y boolean").withColumn("y", F.col("y").cast("int"))
    contract, config = FeatureContract(("x",), "y", ("key", "s", "id")), TrainingConfig()
    out = split.stratified_split(df, contract, config)
    assert "Exchange" not in _plan(out) and "Window" not in _plan(out)
    order = split.shuffle_order(contract, config.random_state)
    for label in (0, 1):
        own = [r.id for r in df.where(F.col("y") == label).orderBy(*order).collect()]
        n_test = round(len(own) * 0.2)
        n_validation = round((len(own) - n_test) * 0.25)
        told = {r.id: r.split for r in out.where(F.col("y") == label).collect()}
        assert [told[i] for i in own] == ["test"] * n_test + ["validation"] * n_validation + ["train"] * (len(own) - n_test - n_validation)
    folds = split.assign_folds(df, contract, 3, [F.col("x"), F.col("id")])
    assert "Exchange" not in _plan(folds)
    places = cutoffs.all_positions(df, [F.col("s"), F.col("key"), F.col("x"), F.col("id")])
    for n in (0, 1, 233, 700):
        cut = cutoffs.cutoffs(df, F.lit(0), places, {0: [n]})[0, n]
        assert {r.id for r in df.where(cut.holds(places)).collect()} == {r.id for r in df.orderBy("s", "key", "x", "id").limit(n).collect()}


def test_rows_that_are_equal_in_the_whole_order_are_ranked(spark):
    df = spark.createDataFrame([(1, float(k % 2), k % 2) for k in range(400)], "k int, x double, y int")
    out = split.stratified_split(df, FeatureContract(("x",), "y", ("k",)), TrainingConfig())
    assert {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()} == {(y, s): n for y in (0, 1) for s, n in (("test", 40), ("validation", 40), ("train", 120))}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "decimal(20,4)", "float", "binary", "smallint"])
def test_positions_sort_as_their_columns(spark, kind):
    rng = random.Random(5)
    numbers = [rng.randrange(-(10**9), 10**9) for _ in range(200)] + [0, 1, -1]
    source = spark.createDataFrame([(n,) for n in numbers], "n long")
    made = {"timestamp": F.timestamp_micros(F.col("n") * 1_000_003), "timestamp_ntz": F.timestamp_micros(F.col("n") * 1_000_003).cast("timestamp_ntz"), "date": F.date_from_unix_date((F.col("n") % 90_000).cast("int")), "binary": F.encode(F.col("n").cast("string"), "UTF-8"), "smallint": F.col("n") % 30_000, "float": F.col("n") / 1e3}
    df = source.select(made.get(kind, F.col("n") / 10_000).cast(kind).alias("c")).union(spark.createDataFrame([(None,)], f"c {kind}"))
    places = cutoffs.positions(F.col("c"), df.schema["c"].dataType)
    by_place = [tuple(r) for r in df.orderBy(*places).select("c").collect()]
    assert [r[0] for r in by_place] == [r[0] for r in df.orderBy("c").collect()]


def test_many_knots_equal_mllib(spark):
    n = 100_000
    rng = np.random.default_rng(4)
    x = np.sort(rng.normal(0, 1, n))
    y = np.linspace(0, 1, n)
    rows = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "f double, y double").repartition(4)
    fitted = IsotonicRegression(featuresCol="f", labelCol="y").fit(rows)
    boundaries, values = tuple(map(float, fitted.boundaries)), tuple(map(float, fitted.predictions))
    assert len(boundaries) == n
    tried = spark.createDataFrame([(float(v),) for v in [*rng.normal(0, 1.5, 3000), *x[:50], x[0] - 1, x[-1] + 1, x[512], x[511], x[1024]]], "f double")
    got = knots.joined(fitted.transform(tried), "f", boundaries, values, "own").select("prediction", "own").collect()
    assert len(got) == 3055 and max(abs(r.prediction - r.own) for r in got) < 1e-12


def test_joined_scores_equal_literal_scores(spark, table, monkeypatch):
    boundaries = tuple(float(k) / 50 for k in range(-200, 200))
    model = [MODEL[0], fit.FoldModel((0.5, 0.0), (1.0, 1.0), (0.3, 0.2), 0.0, fit.Calibrator("isotonic", boundaries=boundaries, values=tuple((k / 400) ** 2 for k in range(400))))]
    literal = score.add_scores(table, ("a", "b"), model, 0.3)
    want = sorted(map(tuple, literal.collect()))
    monkeypatch.setattr(score, "LITERAL_KNOTS", 100)
    joined = score.add_scores(table, ("a", "b"), model, 0.3)
    assert joined.columns == literal.columns and sorted(map(tuple, joined.collect())) == want


def test_wide_models_in_long_form(spark):
    n, rng = 5000, random.Random(6)
    names = tuple(f"f{k}" for k in range(n))
    draw = lambda a, b: tuple(rng.uniform(a, b) for _ in range(n))
    models = [fit.FoldModel(draw(-0.1, 0.1), draw(0.5, 2), draw(-1, 1), 0.2), fit.FoldModel(draw(-0.1, 0.1), draw(0.5, 2), draw(-1, 1), -0.2, fit.Calibrator("sigmoid", -0.8, 0.3))]
    contract = FeatureContract(names, None, ("id",))
    present = {i: {rng.randrange(n): rng.gauss(0, 1) for _ in range(40)} for i in range(60)}
    rows = spark.createDataFrame([(i, names[k], v) for i, own in present.items() for k, v in own.items()], "id long, feature string, value double")
    keys = spark.createDataFrame([(i,) for i in range(62)], "id long")
    got = {r.id: r.fraud_probability for r in wide.score_long(rows, contract, models, 0.5, keys).collect()}

    def plain(own: dict) -> float:
        out = 0.0
        for m in models:
            x = m.intercept + sum(c * (own.get(k, 0.0) - a) / s for k, (c, a, s) in enumerate(zip(m.coefficients, m.means, m.scales, strict=True)))
            out += 1 / (1 + math.exp(-x)) if m.calibrator.method == "none" else 1 / (1 + math.exp(m.calibrator.slope * x + m.calibrator.intercept))
        return out / 2

    assert got == pytest.approx({i: plain(present.get(i, {})) for i in range(62)}, abs=1e-9)
    with pytest.raises(SchemaError, match="unexpected"):
        wide.score_long(rows.union(spark.createDataFrame([(1, "other", 1.0)], rows.schema)), contract, models, 0.5)
    with pytest.raises(SchemaError, match="twice"):
        wide.score_long(rows.union(rows.limit(1)), contract, models, 0.5)
    with pytest.raises(SchemaError, match="missing or infinite"):
        wide.score_long(rows.withColumn("value", F.when(F.col("id") == 3, None).otherwise(F.col("value"))), contract, models, 0.5)


def test_long_form_of_a_wide_table_equals_the_literal_form(spark, table):
    rows = wide.long_rows(table, ("id",), ("a", "b"))
    got = {r.id: (round(r.fraud_probability, 12), r.is_fraud) for r in wide.score_long(rows, AB, MODEL, 0.5, table).collect()}
    want = {r.id: (round(r.fraud_probability, 12), r.is_fraud) for r in score.add_scores(table, ("a", "b"), MODEL, 0.5).collect()}
    assert got == want


def test_drift_of_windows_as_files_arrive(spark):
    rng = random.Random(3)
    profile = drift.build_profile(spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(2000)], "v double"), ("v",))
    path, out, checkpoint = (staging.shared_path(spark) for _ in range(3))
    stream = lambda: spark.readStream.schema("t timestamp, v double").parquet(path)
    rows = []
    for hour in range(6):
        own = [(hour * 3600 + rng.randrange(3600), rng.gauss(hour / 2, 1) if k else None) for k in range(300)]
        rows += own
        spark.createDataFrame(own, "s long, v double").select(F.timestamp_seconds("s").alias("t"), "v").coalesce(1).write.mode("append").parquet(path)
        windows.start(stream(), profile, "t", "1 hour", "10 minutes", out, checkpoint, once=True).awaitTermination()
    told = windows.window_drift(profile, spark.read.schema(windows.COUNTS).parquet(out)).orderBy("window_start").collect()
    batch = windows.window_drift(profile, windows.window_counts(spark.createDataFrame(rows, "s long, v double").select(F.timestamp_seconds("s").alias("t"), "v"), profile, "t", "1 hour")).orderBy("window_start").collect()
    assert len(batch) == 6 and 4 <= len(told) <= 5 and [tuple(r) for r in told] == [tuple(r) for r in batch[: len(told)]]
    assert all(r.n_bad == 1 and r.n_rows == 300 for r in told) and told[0].status == "stable" and told[-1].status == "drifted"


def test_trees_tell_changed_ranges(spark):
    rows = spark.range(2000).select((F.col("id") * 3 - 900).alias("id"), (F.col("id") * 1.5).alias("a"), F.lit(2.0).alias("b"))
    make = lambda df: fingerprint.tree(fingerprint.leaves(df, AB, "id", 50))
    old = make(rows)
    assert fingerprint.changed_parts(old, make(rows.repartition(7))).count() == 0
    new = rows.where("id <> 3 AND id < 4900").withColumn("a", F.when(F.col("id") == 600, 0.0).otherwise(F.col("a"))).union(rows.where("id = 9").withColumn("id", F.lit(100_000).cast("long")))
    told = {(r.node, r.change) for r in fingerprint.changed_parts(old, make(new)).collect()}
    assert told == {(0, "changed"), (12, "changed"), (2000, "added")} | {(n, "removed") for n in range(98, 102)}
    assert sorted(map(tuple, fingerprint.updated(old, new, AB, "id", 50, [n for n, _ in told]).collect())) == sorted(map(tuple, make(new).collect()))
    assert make(rows.where("false")).count() == 0 and fingerprint.changed_parts(make(rows.where("false")), old).count() == old.where("level = 0").count()


def test_a_batch_of_many_requests_has_several_files(spark, monkeypatch):
    monkeypatch.setattr(outputs, "FILE_ROWS", 100)
    row = outputs.stream_ledger(spark, "/root/testdata/sf0.001").first()
    files, n = outputs._request_files(spark, "/root/testdata/sf0.001")[0], row.n_accepted + row.n_rejected
    assert row.n_batches == 4 and n == files.count() and len(files.inputFiles()) == 4 * (n // 400 + 1)


def test_thousands_of_changed_ranges_update_a_tree(spark):
    rows = spark.range(30_000).select("id", (F.col("id") * 1.5).alias("a"), F.lit(2.0).alias("b"))
    make = lambda df: fingerprint.tree(fingerprint.leaves(df, AB, "id", 5))
    old, new = make(rows), rows.withColumn("a", F.when(F.col("id") % 10 == 3, 0.0).otherwise(F.col("a")))
    told, want = fingerprint.changed_parts(old, make(new)), sorted(map(tuple, make(new).collect()))
    assert told.count() == 3000 and len(fingerprint._spans(told)) <= fingerprint.SPANS
    for parts in (told, [r.node for r in told.collect()]):
        assert sorted(map(tuple, fingerprint.updated(old, new, AB, "id", 5, parts).collect())) == want
    assert sorted(map(tuple, fingerprint.updated(old, rows, AB, "id", 5, []).collect())) == sorted(map(tuple, old.collect()))


def test_a_constant_calibrator_is_no_optimum(spark, monkeypatch):
    monkeypatch.setattr(fit, "calibrate", lambda held, contract, model, method: fit.Calibrator("isotonic", boundaries=(-1e9, 1e9), values=(held.agg(F.avg("label")).first()[0],) * 2))
    told = proofs.isotonic_optimal(spark, "/root/testdata/sf0.001").collect()
    assert all(r.block_gap == 0 and r.first_part_gap > 0 and not r.several_blocks for r in told)
