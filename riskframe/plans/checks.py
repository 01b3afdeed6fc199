"""Registered queries whose answers SQL can state: faults, guards, round trips and the optimality of fits.

A fault query makes broken versions of the given tables and tells what each operator says to them.  A fit
query states what holds at an optimum (gradients of zero, means that agree), computed from the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.contracts import DataError, FeatureContract, RiskError, TrainingConfig
from riskframe.functions import count_where, logistic, number
from riskframe.operators import drift, explain, fit, score, split, validate
from riskframe.operators.fingerprint import fingerprint
from riskframe.plans import queries as Q
from riskframe.plans.train import VERSION, RiskModel, check_model, divided, train
from riskframe.sources import artifact, generate, tables
from riskframe.sources.staging import is_free, keep, shared_path
from riskframe.streaming import requests

SMALL = FeatureContract(("value", "k"), "label", ("event_id",))
UNCALIBRATED = TrainingConfig(time_column="ts", calibration_method="none")


def _told(spark: SparkSession, cases: dict[str, Callable]) -> DataFrame:
    """(case, error): what each case raises, null where it passes."""
    rows = []
    for name, run in cases.items():
        try:
            run()
            rows.append((name, None))
        except RiskError as e:
            rows.append((name, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "case string, error string")


def _values(cases: dict[str, str | None]) -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return 'SELECT * FROM (VALUES ' + ", ".join(f"({text(k)}, {text(v)})" for k, v in cases.items()) + ') AS x("case", error)'


def _small(spark, d) -> DataFrame:
    return Q.event_table(spark, d).select("event_id", "value", "k", "label")


def validation_faults(spark, d):
    """Labelled tables that break one rule each."""
    t, infinite = _small(spark, d), F.lit(float("inf"))
    high = F.col("value") > 20
    made = {
        "valid": t, "empty": t.where("false"), "one class": t.withColumn("label", F.lit(0)), "missing label": t.withColumn("label", F.when(high, F.col("label"))),
        "other label": t.withColumn("label", F.lit(2) * F.col("label")), "text label": t.withColumn("label", F.col("label").cast("string")), "no target": t.drop("label"),
        "no features": t.select("event_id", "label"), "text feature": t.withColumn("k", F.lit("x")), "null feature": t.withColumn("value", F.when(high, F.col("value"))),
        "nan feature": t.withColumn("k", F.when(high, F.lit(float("nan"))).otherwise(F.col("k"))), "infinite feature": t.withColumn("k", F.when(high, infinite).otherwise(F.col("k"))),
        "two names alike": t.select("*", F.col("value").alias("value")), "names alike but for case": t.select("*", F.col("value").alias("VALUE")), "blank name": t.select("*", F.col("value").alias(" ")),
    }
    return _told(spark, {name: lambda df=df: validate.validate(df, "label", ("event_id",)) for name, df in made.items()})


VALIDATION_FAULTS = {
    "valid": None, "empty": "DataError: The table is empty", "one class": "DataError: The target must have exactly the labels 0 and 1, found [0.0]", "missing label": "DataError: Target column contains missing values",
    "other label": "DataError: The target must have exactly the labels 0 and 1, found [0.0, 2.0]", "text label": "DataError: Target column 'label' must be numeric", "no target": "DataError: Target column 'label' is absent",
    "no features": "DataError: The table needs at least one feature", "text feature": "DataError: Features must be numeric: ['k']", "null feature": "DataError: Features have missing values: ['value']",
    "nan feature": "DataError: Features have missing values: ['k']", "infinite feature": "DataError: Features have infinite values: ['k']", "two names alike": "DataError: Duplicate column names: ['value']",
    "names alike but for case": "DataError: Columns that differ only by case need spark.sql.caseSensitive: ['VALUE', 'value']", "blank name": "DataError: Feature names must not be empty",
}


def scoring_faults(spark, d):
    """Tables to score, scored tables, and windows that break one rule each."""
    t = _small(spark, d)
    scored = score.add_scores(t, SMALL.features, [fit.FoldModel((0.0, 0.0), (1.0, 1.0), (0.0, 0.0), 0.0)], 0.5).select("label", "fraud_probability")
    p = F.col("fraud_probability")
    to_score = {
        "scorable": t, "other order": t.select("k", "label", "value"), "missing features": t.drop("value", "k"), "unexpected features": t.select("*", F.lit(1).alias("z"), F.lit(1).alias("a")), "text to score": t.withColumn("k", F.lit("x")),
        "nothing to score": t.where("false"), "gaps to score": t.withColumn("k", F.when(F.col("event_id") > 0, F.col("k"))),
    }
    checked = {
        "scored": scored, "nothing scored": scored.where("false"), "label 2": scored.withColumn("label", F.lit(2)), "above 1": scored.withColumn("fraud_probability", p + 1), "not a number": scored.withColumn("fraud_probability", p * float("nan")),
    }
    windows = t.withColumn("split", F.when(F.col("event_id") % 2 == 0, "train").otherwise("test"))
    one = windows.withColumn("label", F.when(F.col("split") == "test", 0).otherwise(F.col("label")))
    cases = {n: lambda df=df: validate.check_scorable(df, SMALL) for n, df in to_score.items()} | {n: lambda df=df: validate.check_scored(df, "label", "fraud_probability") for n, df in checked.items()}
    cases |= {
        "both classes a window": lambda: split.check_classes(windows, "label"), "one class in a window": lambda: split.check_classes(one, "label"),
        "few of a class": lambda: split.check_capacity({0: t.count(), 1: 5}, TrainingConfig()), "scores out of range": lambda: score.check_scores(checked["above 1"], "fraud_probability"),
    }
    return _told(spark, cases)


SCORING_FAULTS = {
    "scorable": None, "other order": None, "missing features": "SchemaError: Feature schema mismatch: missing=['k', 'value'], unexpected=[]", "unexpected features": "SchemaError: Feature schema mismatch: missing=[], unexpected=['a', 'z']",
    "text to score": "SchemaError: Features must be numeric: ['k']", "nothing to score": "SchemaError: The table is empty", "gaps to score": "SchemaError: 1 rows have missing or infinite values",
    "scored": None, "nothing scored": "DataError: No scored rows", "label 2": "DataError: Labels must be 0 or 1", "above 1": "DataError: Probabilities must be finite and between 0 and 1", "not a number": "DataError: Probabilities must be finite and between 0 and 1",
    "both classes a window": None, "one class in a window": "DataError: Each temporal window must hold both classes: ['test'] do not", "few of a class": "DataError: Each class needs at least 6 rows, the smaller has 5",
    "scores out of range": "ModelError: The model gives scores that are no probabilities",
}


def model_faults(spark, d):
    """Configurations and models that break one rule each; the model is fitted on all events."""
    t = Q.event_table(spark, d)
    fold = fit.fit_logistic(t, Q.CONTRACT, Q.CONFIG)
    card = {"artifact_version": VERSION, "created_at": "now", "feature_names": list(Q.FEATURES), "feature_count": len(Q.FEATURES), "dataset": {"fingerprint": fingerprint(t, Q.CONTRACT)}}

    def model(threshold=0.5, version=VERSION, folds=(fold,), **other):
        return lambda: check_model(RiskModel(Q.CONTRACT, list(folds), threshold, card | other, version))

    short = fit.FoldModel(fold.means[:1], fold.scales, fold.coefficients, fold.intercept)
    config = lambda **how: lambda: TrainingConfig(**how)
    return _told(spark, {
        "sound model": model(), "threshold above 1": model(1.5), "threshold true": model(True), "other version": model(version=VERSION - 1), "no folds": model(folds=()), "short parameters": model(folds=(short,)),
        "card of other features": model(feature_names=["a"]), "card without a date": model(created_at=""), "no fingerprint": model(dataset={"fingerprint": "xyz"}),
        "test size": config(test_size=0.5), "sizes together": config(test_size=0.4, validation_size=0.25), "iterations": config(max_iterations=99), "regularisation": config(regularization=0.0), "strategy": config(threshold_strategy="best"),
        "cost": config(false_positive_cost=0.0), "calibration folds": config(calibration_folds=1), "jobs": config(calibration_jobs=0), "time column": config(time_column=" "), "bins": config(bins=51), "limits": config(test_size=0.05, validation_size=0.4, bins=50, calibration_folds=10),
    })


MODEL_FAULTS = {
    "sound model": None, "threshold above 1": "ModelError: The threshold must be a number between 0 and 1", "threshold true": "ModelError: The threshold must be a number between 0 and 1", "other version": "ModelError: The artifact has another version",
    "no folds": "ModelError: The parameters do not fit the features", "short parameters": "ModelError: The parameters do not fit the features", "card of other features": "ModelError: The model card does not describe the model",
    "card without a date": "ModelError: The model card does not describe the model", "no fingerprint": "ModelError: The fingerprint must have 64 hex digits",
    "test size": "ModelError: test_size must be between 0.05 and 0.4", "sizes together": "ModelError: test_size and validation_size together must not exceed 0.6", "iterations": "ModelError: max_iterations must be at least 100",
    "regularisation": "ModelError: regularization must be positive", "strategy": "ModelError: threshold_strategy must be one of ('f1', 'cost')", "cost": "ModelError: Costs must be finite and positive", "calibration folds": "ModelError: calibration_folds must be between 2 and 10",
    "jobs": "ModelError: calibration_jobs must be -1 or at least 1", "time column": "ModelError: time_column must not be blank", "bins": "ModelError: bins must be between 2 and 50", "limits": None,
}


def drift_faults(spark, d):
    """Profiles and tables that drift refuses: every fault of a profile, other features, values too large."""
    early, late = Q._halves(spark, d)
    names = Q.DRIFT_FEATURES[:2]
    profile = keep(drift.build_profile(early, names))
    edges, shares = F.col("interior_edges"), F.col("proportions")
    broken = {
        "no name": profile.withColumn("feature", F.lit(" ")), "infinite edge": profile.withColumn("interior_edges", F.transform(edges, lambda e: e * float("inf"))), "falling edges": profile.withColumn("interior_edges", F.reverse(edges)),
        "too few shares": profile.withColumn("proportions", F.slice(shares, 1, 3)), "negative share": profile.withColumn("proportions", F.transform(shares, lambda x: -x)), "shares above 1": profile.withColumn("proportions", F.transform(shares, lambda x: 2 * x)),
        "no rows": profile.where("false"), "valid": profile,
    }
    own = late.select(*names)
    cases = {n: lambda p=p: drift.assess_drift(p, own) for n, p in broken.items()}
    big = early.select((F.col(names[0]) * 3e306).alias("x"))
    return _told(spark, cases | {
        "missing": lambda: drift.assess_drift(profile, own.drop(names[0])), "unexpected": lambda: drift.assess_drift(profile, late.select(*names, "l_tax")), "ignored": lambda: drift.assess_drift(profile, late.select(*names, "l_tax"), ("l_tax",)),
        "nothing to compare": lambda: drift.assess_drift(profile, own.where("false")), "one bin": lambda: drift.build_profile(early, names, 1), "no features": lambda: drift.build_profile(early, ()), "too large": lambda: drift.build_profile(big, ("x",)),
    })


DRIFT_FAULTS = {
    "no name": "DriftError: The reference profile is malformed:  : feature name is empty", "infinite edge": "DriftError: The reference profile is malformed: l_quantity: edges must be finite",
    "falling edges": "DriftError: The reference profile is malformed: l_quantity: edges must increase", "too few shares": "DriftError: The reference profile is malformed: l_quantity: proportions do not fit the edges",
    "negative share": "DriftError: The reference profile is malformed: l_quantity: proportions must be finite and not negative", "shares above 1": "DriftError: The reference profile is malformed: l_quantity: proportions must sum to 1",
    "no rows": "DriftError: The reference profile is empty", "valid": None, "missing": "DriftError: Feature schema mismatch: missing=['l_quantity'], unexpected=[]", "unexpected": "DriftError: Feature schema mismatch: missing=[], unexpected=['l_tax']",
    "ignored": None, "nothing to compare": "DriftError: The table is empty", "one bin": "DriftError: bins must be between 2 and 50", "no features": "DriftError: A profile needs at least one feature", "too large": "DriftError: The profile of 'x' overflows: values are too large",
}


def drift_ignoring(spark, d):
    """Drift with columns beside the features, which are ignored, in another order."""
    late = Q._halves(spark, d)[1].select("l_orderkey", *reversed(Q.DRIFT_FEATURES), "l_returnflag")
    return Q._rounded(drift.assess_drift(Q._profile(spark, d), late, ("l_orderkey", "l_returnflag"))[0])


def labelled_rows(spark, d):
    """The labelled projection: key, features as doubles in contract order, the label as tinyint."""
    shuffled = Q.event_table(spark, d).select("label", *reversed(Q.FEATURES), "ts", "event_id")
    return validate.labelled(shuffled, Q.CONTRACT)


def numeric_columns(spark, d):
    """Which columns of every table are numeric."""
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    rows = []
    for name in names:
        df = Q.load(spark, d, name)
        wrong = set(validate.not_numeric(df, df.columns))
        rows += [(name, c, c not in wrong) for c in df.columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, is_numeric boolean")


NUMERIC = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') OR column_type LIKE 'DECIMAL%' AS is_numeric FROM (DESCRIBE {t})"
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def csv_headers(spark, d):
    """CSV tables of orders in two files: equal headers, another order, another name, a name twice, none."""
    orders = Q.load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    half = F.col("o_orderkey") % 2 == 0

    def written(second: DataFrame | None) -> str:
        path = shared_path(spark)
        orders.where(half).coalesce(1).write.option("header", True).csv(path)
        if second is not None:
            second.where(half if second.columns == ["k,k"] else "true").coalesce(1).write.mode("append").option("header", True).option("sep", "|").option("quote", "").csv(path)
        return path

    def read(path: str) -> None:
        tables.read_labelled(spark, path, "o_custkey", ("o_orderkey",), orders.schema)

    rest = orders.where(~half)
    twice = shared_path(spark)
    orders.select(F.concat_ws(",", "o_orderkey", "o_custkey").alias("k,k")).coalesce(1).write.option("header", True).option("sep", "|").option("quote", "").csv(twice)
    told = []
    for name, path in (
        ("equal", written(rest.select(F.concat_ws(",", *orders.columns).alias(",".join(orders.columns))))), ("other order", written(rest.select(F.concat_ws(",", *reversed(orders.columns)).alias(",".join(reversed(orders.columns)))))),
        ("name twice", twice), ("no such table", shared_path(spark)),
    ):
        try:
            read(path)
            told.append((name, None))
        except DataError as e:
            told.append((name, "labels" if "labels" in str(e) else "unique" if "unique" in str(e) else "absent" if "No such" in str(e) else "unreadable"))
    return spark.createDataFrame(told, "case string, problem string")


def report_roundtrip(spark, d):
    """A summary saved as a JSON report and read again."""
    path, report = shared_path(spark), Q.dataset_summary(spark, d)
    tables.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


def overwrite_guard(spark, d):
    """Outputs appear whole: a taken name is refused, a failed write leaves the old rows, overwriting replaces them."""
    first, second, path = Q.load(spark, d, "region"), Q.load(spark, d, "nation"), shared_path(spark)
    steps = [("free before", str(is_free(spark, path)).lower(), 0)]
    held = lambda: spark.read.parquet(path).count()
    tables.write_parquet(first, path)
    steps.append(("written", "", held()))
    try:
        tables.write_parquet(second, path)
    except RiskError:
        steps.append(("refused", str(is_free(spark, path)).lower(), held()))
    try:
        tables.write_parquet(second.select(F.raise_error(F.lit("stop")).alias("n")), path, True)
    except Exception as e:  # noqa: BLE001 - Spark's own error of a write that failed
        steps.append(("failed", "stop" if "stop" in str(e) else str(e), held()))
    tables.write_parquet(second, path, True)
    steps.append(("replaced", "", held()))
    return spark.createDataFrame(steps, "step string, told string, n_rows long")


#: rows of a partition that :func:`generated_table` makes
ROWS_A_PART = 100_000


def generated_table(spark, d):
    """A generated table with a row an order: ids, times and labels as promised, the same however it is cut.

    It is made in two numbers of partitions, which grow with it; only ids are shuffled, to count those that differ.
    """
    n = Q.load(spark, d, "orders").count()
    parts = n // ROWS_A_PART + 3
    t, again = (generate.transactions(spark, n, 0.1, 7, k) for k in (parts, 2 * parts + 1))
    n_ids = t.select("id").distinct().count()
    mark = lambda df: df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0]
    step = generate.DAY2 / n
    return t.agg(
        F.count("*").alias("n_rows"), F.lit(n_ids).cast("long").alias("n_ids"), count_where((F.col("Time") < F.col("id") * step) | (F.col("Time") >= (F.col("id") + 1) * step + 1e-6)).alias("n_late"),
        count_where(~F.col("Class").isin(0, 1)).alias("n_other_labels"), (F.abs(F.avg("Class") - 0.1) < 0.03).alias("rate_holds"), F.lit(len(t.columns)).alias("n_columns"),
    ).withColumn("repeatable", F.lit(mark(t) == mark(again)))


def fingerprint_properties(spark, d):
    """The fingerprint ignores the order of rows and columns of the table, and sees values, labels and repeats."""
    t = Q.event_table(spark, d)
    own = fingerprint(t, Q.CONTRACT)
    made = {
        "other order": t.orderBy(F.col("event_id").desc()).repartition(5), "other columns' order": t.select(*reversed(t.columns)), "one value": t.withColumn("value", F.when(F.col("event_id") == 0, F.col("value") + 1).otherwise(F.col("value"))),
        "one label": t.withColumn("label", F.when(F.col("event_id") == 0, 1 - F.col("label")).otherwise(F.col("label"))), "a row twice": t.union(t.where("event_id = 0")), "a row less": t.where("event_id <> 0"),
    }
    return spark.createDataFrame([(n, fingerprint(df, Q.CONTRACT) == own, len(own)) for n, df in made.items()], "case string, same boolean, n_digits int")


def _parts(spark, d) -> DataFrame:
    """Training rows in three folds."""
    return divided(Q.event_table(spark, d), Q.CONTRACT, Q.CONFIG)[1]


def _zero(value: Column, places: int) -> Column:
    return F.round(F.abs(value), places)


def fit_optimal(spark, d):
    """The gradient of the regularised, class-weighted likelihood of a fitted model: zero for every coefficient."""
    rows = keep(_parts(spark, d))
    model = fit.fit_logistic(rows, Q.CONTRACT, UNCALIBRATED)
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    weight = F.when(F.col("label") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones)))
    slope = weight * (logistic(fit.margin(Q.FEATURES, model)) - F.col("label")) / n
    terms = [("(intercept)", F.sum(slope))] + [
        (f, F.sum(slope * (number(f) - m) / s) + b / (UNCALIBRATED.regularization * n)) for f, m, s, b in zip(Q.FEATURES, model.means, model.scales, model.coefficients, strict=True)
    ]
    one = rows.agg(*(_zero(g, 4).alias(f"g{k}") for k, (_, g) in enumerate(terms)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(f).alias("term"), F.col(f"g{k}").alias("gradient")) for k, (f, _) in enumerate(terms)))))


def _near(a, b) -> bool:
    """Equal parameters, but for the order in which sums of tasks meet, which a cluster leaves open."""
    if isinstance(a, (dict, list, tuple)):
        return len(a) == len(b) and all(_near(x, y) for x, y in zip(*((v.values() if isinstance(v, dict) else v) for v in (a, b)), strict=True))
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) if isinstance(a, float) else a == b


def _by_fold(values: list[Column]) -> Column:
    """Of each row the value that belongs to its fold."""
    out = F.lit(None).cast("double")
    for k, value in enumerate(values, 1):
        out = F.when(F.col("fold") == k, value).otherwise(out)
    return out


def calibration_optimal(spark, d):
    """Calibrators of three folds on the rows their models have not seen: Platt's gradients and the isotonic mean error
    are zero, isotonic values rise, and folds fitted side by side equal folds fitted one after the other."""
    rows, out, y = _parts(spark, d), [], F.col("label")
    config = lambda method, jobs: TrainingConfig(time_column="ts", calibration_method=method, calibration_jobs=jobs)
    sigmoid = fit.fit_folds(rows, Q.CONTRACT, config("sigmoid", -1))
    serial = fit.fit_folds(rows, Q.CONTRACT, config("sigmoid", 1))
    isotonic = fit.fit_folds(rows, Q.CONTRACT, config("isotonic", -1), sigmoid)
    same = all(_near(a.as_dict(), b.as_dict()) for a, b in zip(sigmoid, serial, strict=True))
    counts = rows.groupBy("fold").agg(F.sum(y), F.sum(1 - y)).orderBy("fold").collect()
    platt = _by_fold([F.when(y == 1, (ones + 1) / (ones + 2)).otherwise(1 / (zeros + 2)) for _, ones, zeros in counts])
    for method, folds, target, places in (("sigmoid", sigmoid, platt, 4), ("isotonic", isotonic, y, 3)):
        m, p = (_by_fold([of(Q.FEATURES, model) for model in folds]) for of in (fit.margin, score.fold_probability))
        # all folds in one pass, each row by the model that has not seen it
        gaps = rows.select("fold", m.alias("m"), (p - target).alias("gap")).groupBy("fold").agg(_zero(F.avg("gap"), places), _zero(F.avg(F.col("gap") * F.col("m")), places))
        for k, mean, slope in gaps.orderBy("fold").collect():
            c = folds[k - 1].calibrator
            rises = all(a <= b for v in (c.boundaries, c.values) for a, b in zip(v, v[1:], strict=False))
            out.append((k, method, mean, slope if method == "sigmoid" else 0.0, rises, same))
    return spark.createDataFrame(out, "fold int, method string, mean_gap double, slope_gap double, rising boolean, parallel_agrees boolean")


def model_effects(spark, d):
    """Effects of a fitted model's folds: a row a feature, with the mean of its named coefficients."""
    rows = _parts(spark, d)
    folds = fit.fit_folds(rows, Q.CONTRACT, TrainingConfig(time_column="ts", calibration_jobs=-1))
    effects = RiskModel(Q.CONTRACT, folds, 0.5).effects(spark)
    named = explain.coefficient_table(spark, Q.FEATURES, folds).groupBy("feature", "ordinal").agg(F.count("*").alias("n_folds"), F.avg("coefficient").alias("mean"))
    both = effects.join(named, "feature")
    return both.select("feature", "ordinal", "n_folds", (F.abs(F.col("mean") - F.col("coefficient")) < 1e-12).alias("agrees"), (F.col("rank").between(1, len(Q.FEATURES))).alias("ranked"))


def card_splits(spark, d):
    """What a trained model's stored card says of its table and splits."""
    card = json.loads(artifact.dump_card(train(Q.event_table(spark, d).drop("ts"), "label", ("event_id",), UNCALIBRATED).card))
    data, parts = card["dataset"], card["splits"]
    row = (data["rows"], data["positives"], round(data["positive_rate"], 9), parts["train"], parts["validation"], parts["test"], card["feature_count"], len(card["reference_profile"]), len(card["feature_effects"]))
    return spark.createDataFrame([row], "n_rows long, n_positive long, positive_rate double, n_train long, n_validation long, n_test long, n_features int, n_profiled int, n_effects int")


def artifact_agrees(spark, d):
    """A stored and loaded model scores every event as the model before, its files as its manifest lists them; a changed file is refused."""
    t = Q.event_table(spark, d)
    model = train(t.drop("ts"), "label", ("event_id",), UNCALIBRATED)
    path = artifact.save(model, spark, shared_path(spark))
    own, stored = (keep(m.score(t.drop("ts")).select("event_id", F.col("fraud_probability").alias(n), F.col("is_fraud").alias(f"{n}_flag"))) for m, n in ((model, "a"), (artifact.load(spark, path), "b")))
    manifest = spark.read.schema("path string, sha256 string, length long").json(f"{path}/manifest")
    found = artifact.file_digests(spark, path).where("path NOT LIKE 'manifest/%'")
    n_files, n_problems = found.count(), artifact.manifest_differences(found, manifest).count()
    spark.createDataFrame([("{}",)], "value string").coalesce(1).write.mode("append").text(f"{path}/card")
    try:
        artifact.load(spark, path)
        refused = False
    except RiskError:
        refused = True
    compared = own.join(stored, "event_id").agg(F.count("*").alias("n_rows"), count_where((F.col("a") != F.col("b")) | (F.col("a_flag") != F.col("b_flag"))).alias("n_different"))
    return compared.select("*", F.lit(n_files).alias("n_files"), F.lit(n_problems).alias("n_problems"), F.lit(refused).alias("change_refused"))


def pipeline_scores(spark, d):
    """Scores of a fitted MLlib pipeline: every row, a probability each, the flag by the threshold."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    t = Q.event_table(spark, d).drop("ts")
    stages = [VectorAssembler(inputCols=list(Q.FEATURES), outputCol="x"), LogisticRegression(featuresCol="x", labelCol="label", maxIter=20)]
    scored = score.score_with_pipeline(t, Pipeline(stages=stages).fit(t), 0.3)
    p, flag = F.col("fraud_probability"), F.col("is_fraud")
    return scored.agg(F.count("*").alias("n_rows"), count_where((p >= 0) & (p <= 1)).alias("n_probabilities"), count_where((p >= 0.3) != (flag == 1)).alias("n_wrong_flags"), F.round(F.avg(p) - F.avg("label"), 3).alias("mean_gap"))


def _batches(spark, d) -> DataFrame:
    """Requests of up to 1,000 and up to 1,001 events, and such that are filled up to the limit of bytes or one more."""
    e = Q.load(spark, d, "events")
    made = []
    for kind, size, width in (("1000", 1000, 0), ("1001", 1001, 0), ("limit", 1000, requests.MOST_BYTES), ("above", 1000, requests.MOST_BYTES + 1)):
        rows = e.groupBy(F.floor(F.col("event_id") / size).alias("batch")).agg(F.concat_ws(", ", F.array_sort(F.collect_list("props"))).alias("props"), F.count("*").alias("n"))
        body = F.concat(F.lit('{"transactions": ['), F.col("props"), F.lit("]}"))
        made.append(rows.select(F.lit(kind).alias("kind"), "batch", "n", (F.rpad(body, width, " ") if width else body).alias("body")))
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return out


def request_limits(spark, d):
    """How requests at and above the limits of rows and bytes fare."""
    scored = requests.score_requests(_batches(spark, d), ("k",), Q.K_MODEL, 0.5, "fixed")
    return scored.groupBy("kind", "reason").agg(F.count("*").alias("n_requests"), F.sum(F.coalesce(F.size("answer.predictions"), F.lit(0))).cast("long").alias("n_predictions"))


def request_errors(spark, d):
    """The place, kind and message of every rejected request's error."""
    told = requests.rejected(Q._answers(spark, d), ["event_id"])
    return told.select("event_id", "reason", F.concat_ws(".", "error.location").alias("location"), F.col("error.type").alias("type"), F.col("error.message").alias("message"))


def correlation_ids(spark, d):
    """The caller's id where it is safe, else a digest of the event's number."""
    e = Q.load(spark, d, "events")
    given = F.when(F.col("event_type") == "click", F.concat_ws("-", "event_type", "user_id")).when(F.col("event_type") == "view", F.concat_ws(" ", "event_type", "user_id")).when(F.col("event_type") == "signup", F.repeat("event_type", 30))
    return e.select("event_id", requests.correlation_id(given, F.col("event_id")).alias("correlation_id"))


def text_functions(spark, d):
    """The string, hash and date functions the operators use, on customers and orders."""
    c = Q.load(spark, d, "customer").join(Q.load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    digest = F.sha2(F.concat_ws("\x00", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string")), 256)
    return c.select(
        "o_orderkey", F.substring(digest, 1, 12).alias("prefix"), digest.rlike("^[0-9a-f]{64}$").alias("is_digest"), F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("name"),
        F.col("c_name").rlike(requests.ID_PATTERN).alias("is_safe_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.hour("o_orderdate").alias("hour"),
    )


_SPLIT_SIZES = """WITH c AS (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, count(*) AS n FROM events GROUP BY 1),
a AS (SELECT label, n, round_even(n * 0.2, 0) AS test FROM c), v AS (SELECT *, round_even((n - test) * (0.2 / (1 - 0.2)), 0) AS validation FROM a)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) FILTER (label = 1) AS BIGINT) AS n_positive, round(sum(n) FILTER (label = 1) / sum(n), 9) AS positive_rate, CAST(sum(n - test - validation) AS BIGINT) AS n_train,
    CAST(sum(validation) AS BIGINT) AS n_validation, CAST(sum(test) AS BIGINT) AS n_test, 4 AS n_features, 4 AS n_profiled, 4 AS n_effects FROM v"""
_LIMITS = " UNION ALL ".join(
    f"""SELECT '{kind}' AS kind, CASE WHEN '{kind}' = 'above' THEN 'body is too large' WHEN n > 1000 THEN 'number of transactions' END AS reason,
    count(*) AS n_requests, CAST(sum(CASE WHEN '{kind}' = 'above' OR n > 1000 THEN 0 ELSE n END) AS BIGINT) AS n_predictions FROM (SELECT event_id // {size} AS batch, count(*) AS n FROM events GROUP BY 1) GROUP BY 2"""
    for kind, size in (("1000", 1000), ("1001", 1001), ("limit", 1000), ("above", 1000))
)

CHECKS = {f.__name__: f for f in (
    validation_faults, scoring_faults, model_faults, drift_faults, drift_ignoring, labelled_rows, numeric_columns, csv_headers, report_roundtrip, overwrite_guard, generated_table, fingerprint_properties, fit_optimal,
    calibration_optimal, model_effects, card_splits, artifact_agrees, pipeline_scores, request_limits, request_errors, correlation_ids, text_functions,
)}


def check_sql(known: dict[str, str], events: str) -> dict[str, str]:
    """SQL of the checks; ``known``: of the other queries, ``events``: the labelled table of events as a CTE."""
    features = ", ".join(Q.FEATURES)
    reasons = {"unknown field": ("body", "extra_forbidden", "the body has a field that is not known"), "feature schema mismatch": ("body.transactions.0", "schema_mismatch", "the features do not match the model"), "body is not valid": ("body", "invalid_json", "the body is no valid request")}
    pick = lambda k: "CASE reason " + " ".join(f"WHEN '{r}' THEN '{v[k]}'" for r, v in reasons.items()) + " END"
    return {
        "validation_faults": _values(VALIDATION_FAULTS), "scoring_faults": _values(SCORING_FAULTS), "model_faults": _values(MODEL_FAULTS), "drift_faults": _values(DRIFT_FAULTS), "drift_ignoring": known["drift_features"],
        "labelled_rows": f"WITH {events} SELECT event_id, {features}, CAST(label AS TINYINT) AS label FROM t", "numeric_columns": NUMERIC,
        "csv_headers": "SELECT * FROM (VALUES ('equal', 'labels'), ('other order', 'unreadable'), ('name twice', 'unique'), ('no such table', 'absent')) AS x(\"case\", problem)",
        "report_roundtrip": known["dataset_summary"],
        "overwrite_guard": """WITH n AS (SELECT (SELECT count(*) FROM region) AS a, (SELECT count(*) FROM nation) AS b)
            SELECT s.step, s.told, CASE s.k WHEN 0 THEN 0 WHEN 1 THEN a ELSE b END AS n_rows FROM n, (VALUES ('free before', 'true', 0), ('written', '', 1), ('refused', 'false', 1), ('failed', 'stop', 1), ('replaced', '', 2)) AS s(step, told, k)""",
        "generated_table": "SELECT count(*) AS n_rows, count(*) AS n_ids, CAST(0 AS BIGINT) AS n_late, CAST(0 AS BIGINT) AS n_other_labels, true AS rate_holds, 32 AS n_columns, true AS repeatable FROM orders",
        "fingerprint_properties": """SELECT "case", same, 64 AS n_digits FROM (VALUES ('other order', true), ('other columns'' order', true), ('one value', false), ('one label', false), ('a row twice', false), ('a row less', false)) AS x("case", same)""",
        "fit_optimal": "SELECT term, CAST(0 AS DOUBLE) AS gradient FROM (VALUES ('(intercept)'), " + ", ".join(f"('{f}')" for f in Q.FEATURES) + ") AS x(term)",
        "calibration_optimal": "SELECT CAST(k AS INTEGER) AS fold, method, CAST(0 AS DOUBLE) AS mean_gap, CAST(0 AS DOUBLE) AS slope_gap, true AS rising, true AS parallel_agrees FROM range(1, 4) AS f(k), (VALUES ('sigmoid'), ('isotonic')) AS x(method)",
        "model_effects": "SELECT feature, ordinal, CAST(3 AS BIGINT) AS n_folds, true AS agrees, true AS ranked FROM (VALUES " + ", ".join(f"('{f}', {k})" for k, f in enumerate(Q.FEATURES)) + ") AS x(feature, ordinal)",
        "card_splits": _SPLIT_SIZES, "artifact_agrees": "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different, 2 AS n_files, 0 AS n_problems, true AS change_refused FROM events",
        "pipeline_scores": "SELECT count(*) AS n_rows, count(*) AS n_probabilities, CAST(0 AS BIGINT) AS n_wrong_flags, CAST(0 AS DOUBLE) AS mean_gap FROM events", "request_limits": _LIMITS,
        "request_errors": f"""WITH r AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'unknown field' WHEN 'signup' THEN 'feature schema mismatch' ELSE 'body is not valid' END AS reason FROM events WHERE event_type NOT IN ('click', 'view'))
            SELECT event_id, reason, {pick(0)} AS location, {pick(1)} AS type, {pick(2)} AS message FROM r""",
        "correlation_ids": "SELECT event_id, CASE WHEN event_type = 'click' THEN event_type || '-' || user_id ELSE md5(CAST(event_id AS VARCHAR)) END AS correlation_id FROM events",
        "text_functions": """SELECT o_orderkey, substr(sha256(c_name || chr(0) || c_mktsegment || chr(0) || c_nationkey), 1, 12) AS prefix, true AS is_digest, c_name AS name, regexp_full_match(c_name, '[A-Za-z0-9._-]{1,128}') AS is_safe_id,
            strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at, CAST(hour(o_orderdate) AS INTEGER) AS hour FROM customer JOIN orders ON c_custkey = o_custkey""",
    }
