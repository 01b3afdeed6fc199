"""Registered queries of outputs: scores published in one scan, versions by pointer, stream tables by ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.contracts import FeatureContract, RiskError
from riskframe.functions import local_table
from riskframe.operators import drift, fit, observed, wide
from riskframe.operators import fingerprint as prints
from riskframe.plans import queries as Q
from riskframe.sources import versions
from riskframe.sources.staging import keep, shared_path
from riskframe.streaming import drift as windows
from riskframe.streaming import sinks

SCORED = ["event_id", "fraud_probability", "is_fraud"]


def _publish(t: DataFrame, path: str, **how) -> observed.ScoreReport:
    return observed.publish_scores(t, Q.CONTRACT, Q.FOLDS, 0.25, path, columns=SCORED, **how)


def _scorable(spark, d) -> DataFrame:
    return Q.event_table(spark, d).drop("ts")


def score_published(spark, d):
    """Scores of all events as the one job that checks and counts them wrote them."""
    path = shared_path(spark)
    _publish(_scorable(spark, d), path)
    return spark.read.parquet(path).select("event_id", F.round("fraud_probability", 6).alias("fraud_probability"), "is_fraud")


def score_published_report(spark, d):
    """What that job saw: rows, flagged rows, and faults by feature, in long form."""
    return _publish(_scorable(spark, d), shared_path(spark)).table(spark)


def score_refused(spark, d):
    """A batch with infinite and missing values over a table that was published before: the error, and what is there after it."""
    path, t = shared_path(spark), _scorable(spark, d)
    _publish(t, path)
    bad = t.withColumn("value", F.when(F.col("event_id") % 100 == 3, F.lit(float("inf"))).when(F.col("event_id") % 100 == 5, None).otherwise(F.col("value")))
    told = "published"
    try:
        _publish(bad, path, overwrite=True)
    except RiskError as e:
        told = f"{type(e).__name__}: {e}"
    return spark.read.parquet(path).agg(F.count("*").alias("n_rows"), F.sum(F.col("is_fraud").cast("long")).alias("n_flagged")).withColumn("error", F.lit(told))


def versioned_output(spark, d):
    """What a reader finds at each step of an output that is published by pointer: two versions, a write that fails, a clean-up."""
    target, region, nation = shared_path(spark), Q.load(spark, d, "region"), Q.load(spark, d, "nation")
    steps, n = [], lambda: versions.read_current(spark, target).count() if versions.current(spark, target) else 0
    steps.append(("before", "", n()))
    versions.publish_version(spark, target, region.write.parquet)
    steps.append(("first", "", n()))
    held = versions.read_current(spark, target)

    def half(to: str) -> None:
        nation.write.parquet(to)
        steps.append(("while the second is written", "", n()))
        raise RiskError("stopped")

    try:
        versions.publish_version(spark, target, half)
    except RiskError as e:
        steps.append(("after it failed", str(e), n()))
    versions.publish_version(spark, target, nation.write.parquet)
    steps.append(("second", "", n()))
    steps.append(("first, as its reader sees it", "", held.count()))
    try:
        versions.publish_version(spark, target, region.write.parquet, overwrite=False)
    except RiskError as e:
        steps.append(("refused", str(e).split(":")[0], n()))
    steps.append(("versions that went", str(len(versions.clean(spark, target, 1))), n()))
    return local_table(spark, steps, "step string, told string, n_rows long")


def _written(ledger: sinks.Ledger) -> DataFrame:
    accepted = ledger.read("accepted").select("event_id", F.lit("accepted").alias("outcome"), F.lit(None).cast("string").alias("reason"), F.size("answer.predictions").alias("n_predictions"))
    rejected = ledger.read("rejected").select("event_id", F.lit("rejected").alias("outcome"), "reason", F.lit(0).alias("n_predictions"))
    return accepted.union(rejected)


#: requests of a file of the streams
FILE_ROWS = 100_000


def _request_files(spark, d) -> tuple[DataFrame, DataFrame]:
    """Requests in four times as many files as a batch takes, and their stream: four batches, whose files grow in number, not in size."""
    events = Q.load(spark, d, "events")
    each = events.count() // (4 * FILE_ROWS) + 1
    files = keep(Q._bodies(events).repartition(4 * each, "event_id"))
    return files, spark.readStream.schema(files.schema).option("maxFilesPerTrigger", each).parquet(files._kept_at)


def stream_tables(spark, d):
    """Requests as a stream of four batches of files, one of whose batches is cut off half written; the stream is then replayed
    from its start.  The rows of both tables, each of which must be there once."""
    (files, stream), base = _request_files(spark, d), shared_path(spark)
    ledger = sinks.Ledger(spark, base)
    # a batch that was killed after its first table: not in the ledger, so not read, and written anew
    files.limit(3).write.parquet(ledger.folder("accepted", 1))
    for _ in range(2):
        sinks.start(stream, ("k",), Q.K_MODEL, 0.5, "fixed", base, shared_path(spark), ["event_id"], once=True).awaitTermination()
    return _written(ledger)


def stream_ledger(spark, d):
    """Batches and rows of the ledger after a replay."""
    (files, stream), base = _request_files(spark, d), shared_path(spark)
    for _ in range(2):
        sinks.start(stream, ("k",), Q.K_MODEL, 0.5, "fixed", base, shared_path(spark), ["event_id"], once=True).awaitTermination()
    held = sinks.Ledger(spark, base).batches()
    return local_table(spark, [(len(held), sum(c["accepted"] for c in held.values()), sum(c["rejected"] for c in held.values()))], "n_batches long, n_accepted long, n_rejected long")


WIDTH, DELAY = 90, 1


def stream_drift(spark, d):
    """Line items as a stream of ship dates: the drift of every closed window of 90 days against the early half's profile."""
    early, items = Q._halves(spark, d)[0], keep(Q.load(spark, d, "lineitem").select("l_shipdate", *Q.DRIFT_FEATURES).repartition(4))
    profile = drift.build_profile(early, Q.DRIFT_FEATURES)
    stream = spark.readStream.schema(items.schema).parquet(items._kept_at)
    path = shared_path(spark)
    windows.start(stream, profile, "l_shipdate", f"{WIDTH} days", f"{DELAY} days", path, shared_path(spark), once=True).awaitTermination()
    told = windows.window_drift(profile, spark.read.schema(windows.COUNTS).parquet(path))
    return told.select(F.unix_date(F.col("window_start").cast("date")).alias("first_day"), "feature", "ordinal", "n_rows", "n_bad", F.round("psi", 9).alias("psi"), "status")


#: features of a wide table, and its model: a formula that SQL can follow
BUCKETS, BASE = 5000, -1.0
WIDE = FeatureContract(tuple(f"w{k}" for k in range(BUCKETS)), None, ("doc_id",))
WIDE_MODEL = [fit.FoldModel((0.0,) * BUCKETS, tuple(1.0 + k % 3 for k in range(BUCKETS)), tuple((k * 7919 % 2001 - 1000) / 20000 for k in range(BUCKETS)), BASE)]


def score_sparse(spark, d):
    """Documents as sparse rows of 5,000 features, counts of words by a digest, scored in long form."""
    docs = Q.load(spark, d, "documents")
    words = docs.select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    bucket = F.conv(F.substring(F.md5("word"), 1, 6), 16, 10).cast("int") % BUCKETS
    rows = words.groupBy("doc_id", F.concat(F.lit("w"), bucket.cast("string")).alias("feature")).agg(F.count("*").cast("double").alias("value"))
    scored = wide.score_long(rows, WIDE, WIDE_MODEL, 0.5, docs.select("doc_id"), checked=True)
    return scored.select("doc_id", F.round("fraud_probability", 6).alias("fraud_probability"))


RANGE = 100


def fingerprint_changes(spark, d):
    """Key ranges in which the events differ from a version with some values changed, the last events gone and others added,
    found from two trees; and whether the tree that was brought up to date by these ranges is that of the new table."""
    t = _scorable(spark, d)
    last = t.agg(F.max("event_id")).first()[0]
    changed = t.withColumn("value", F.when(F.col("event_id") % 997 == 5, F.col("value") + 1).otherwise(F.col("value"))).where(F.col("event_id") <= last - 250)
    new = changed.union(t.where(F.col("event_id") < 150).withColumn("event_id", F.col("event_id") + last + 1000))
    old_tree, new_tree = (prints.tree(prints.leaves(x, Q.CONTRACT, "event_id", RANGE)) for x in (t, new))
    told = keep(prints.changed_parts(old_tree, new_tree))
    again = prints.updated(old_tree, new, Q.CONTRACT, "event_id", RANGE, told)
    same = again.exceptAll(new_tree).count() == 0 and new_tree.exceptAll(again).count() == 0
    return told.select((F.col("node") * RANGE).alias("first_key"), "change", F.lit(same).alias("update_agrees"))


OUTPUTS = {f.__name__: f for f in (fingerprint_changes, stream_drift, score_sparse, score_published, score_published_report, score_refused, versioned_output, stream_tables, stream_ledger)}


def output_sql(known: dict[str, str], events: str, profile: str, values: str) -> dict[str, str]:
    """``profile``: CTEs up to bins (feature, ordinal, bin, expected) and e (feature, edges); ``values``: feature and value by ship date."""
    scored = known["score_fixed_model"].replace("round(p, 6) AS fraud_probability", "p")
    reason = "CASE event_type WHEN 'error' THEN 'unknown field' WHEN 'signup' THEN 'feature schema mismatch' WHEN 'click' THEN NULL WHEN 'view' THEN NULL ELSE 'body is not valid' END"
    faults = " UNION ALL ".join(f"SELECT '{kind}', '{f}', count(*) FILTER ({test.format(f)}) FROM t" for f in Q.FEATURES for kind, test in (("null", "{} IS NULL"), ("nan", "isnan({})"), ("infinite", "isinf({})")))
    seconds = WIDTH * 86_400
    return {
        "fingerprint_changes": f"""WITH l AS (SELECT max(event_id) AS last FROM events), o AS (SELECT event_id, event_id AS src, 0 AS plus FROM events),
            n AS (SELECT event_id, event_id AS src, CASE WHEN event_id % 997 = 5 THEN 1 ELSE 0 END AS plus FROM events, l WHERE event_id <= last - 250 UNION ALL SELECT event_id + last + 1000, event_id, CASE WHEN false THEN 1 ELSE 0 END FROM events, l WHERE event_id < 150),
            a AS (SELECT event_id // {RANGE} AS node, list((event_id, src, plus) ORDER BY event_id) AS rows FROM o GROUP BY 1), b AS (SELECT event_id // {RANGE} AS node, list((event_id, src, plus) ORDER BY event_id) AS rows FROM n GROUP BY 1)
            SELECT coalesce(a.node, b.node) * {RANGE} AS first_key, CASE WHEN a.node IS NULL THEN 'added' WHEN b.node IS NULL THEN 'removed' ELSE 'changed' END AS change, true AS update_agrees
            FROM a FULL JOIN b ON a.node = b.node WHERE a.node IS NULL OR b.node IS NULL OR a.rows <> b.rows""",
        "stream_drift": f"""WITH {profile}, k AS (SELECT feature, value, CAST(epoch(l_shipdate) AS BIGINT) // {seconds} AS w FROM ({values})),
            closed AS (SELECT w FROM k GROUP BY w HAVING (w + 1) * {seconds} <= (SELECT max(CAST(epoch(l_shipdate) AS BIGINT)) FROM lineitem) - {DELAY * 86_400}),
            o AS (SELECT w, k.feature, len(list_filter(edges, lambda x: x <= value)) AS bin, count(*) AS n FROM k JOIN e ON k.feature = e.feature GROUP BY ALL), z AS (SELECT w, feature, sum(n) AS rows FROM o GROUP BY w, feature),
            y AS (SELECT closed.w, bins.feature, ordinal, rows, expected, coalesce(n, 0) / rows AS actual FROM closed JOIN bins ON true JOIN z ON z.w = closed.w AND z.feature = bins.feature LEFT JOIN o ON o.w = closed.w AND o.feature = bins.feature AND o.bin = bins.bin),
            p AS (SELECT w, feature, CAST(ordinal AS INTEGER) AS ordinal, CAST(rows AS BIGINT) AS n_rows, greatest(0, sum((actual - expected) * ln((actual + 1e-6) / (expected + 1e-6)))) AS psi FROM y GROUP BY ALL)
            SELECT CAST(w * {WIDTH} AS INTEGER) AS first_day, feature, ordinal, n_rows, CAST(0 AS BIGINT) AS n_bad, round(psi, 9) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'warning' ELSE 'drifted' END AS status FROM p""",
        "score_sparse": f"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), b AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 6) AS INTEGER) % {BUCKETS} AS k, count(*) AS value FROM w GROUP BY ALL),
            m AS (SELECT doc_id, sum(value * (k * 7919 % 2001 - 1000) / 20000.0 / (1 + k % 3)) AS x FROM b GROUP BY doc_id)
            SELECT doc_id, round(1 / (1 + exp(-(coalesce(x, 0) + {BASE}))), 6) AS fraud_probability FROM documents LEFT JOIN m USING (doc_id)""",
        "score_published": known["score_fixed_model"],
        "score_published_report": f"WITH {events}, s AS ({scored}), r AS (SELECT 'rows' AS metric, CAST(NULL AS VARCHAR) AS column_name, count(*) AS n FROM t UNION ALL SELECT 'flagged', NULL, count(*) FILTER (is_fraud = 1) FROM s UNION ALL {faults}) SELECT * FROM r",
        "score_refused": f"WITH s AS ({scored}) SELECT count(*) AS n_rows, count(*) FILTER (is_fraud = 1) AS n_flagged, 'SchemaError: ' || count(*) FILTER (event_id % 100 IN (3, 5)) || ' rows have missing or infinite values' AS error FROM s",
        "versioned_output": """WITH n AS (SELECT (SELECT count(*) FROM region) AS a, (SELECT count(*) FROM nation) AS b)
            SELECT s.step, s.told, CASE s.k WHEN 0 THEN 0 WHEN 1 THEN a ELSE b END AS n_rows FROM n, (VALUES ('before', '', 0), ('first', '', 1), ('while the second is written', '', 1), ('after it failed', 'stopped', 1), ('second', '', 2),
            ('first, as its reader sees it', '', 1), ('refused', 'Output exists', 2), ('versions that went', '1', 2)) AS s(step, told, k)""",
        "stream_tables": f"SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'accepted' ELSE 'rejected' END AS outcome, {reason} AS reason, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS n_predictions FROM events",
        "stream_ledger": "SELECT CAST(4 AS BIGINT) AS n_batches, count(*) FILTER (event_type IN ('click', 'view')) AS n_accepted, count(*) FILTER (event_type NOT IN ('click', 'view')) AS n_rejected FROM events",
    }
