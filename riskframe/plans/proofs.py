"""Registered queries that prove what training does: the chosen threshold and metrics, isotonic optimality, strict cards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.contracts import TrainingConfig
from riskframe.functions import local_table
from riskframe.operators import fit, score, split, validate
from riskframe.operators.prefix import running
from riskframe.plans import queries as Q
from riskframe.plans.checks import UNCALIBRATED, _parts, _told, _values
from riskframe.plans.train import assess, train
from riskframe.sources import artifact

_METRICS = ("roc_auc", "average_precision", "brier_score", "precision", "recall", "f1", "balanced_accuracy", "true_negatives", "false_positives", "false_negatives", "true_positives", "expected_cost_per_transaction")


def _assessed(spark, d, config: TrainingConfig):
    """The assessment of training, on its own splits, with folds of given parameters so that SQL can follow."""
    parts = split.stratified_split(validate.labelled(Q.event_table(spark, d), Q.CONTRACT), Q.CONTRACT, config)
    threshold, metrics = assess(parts, Q.CONTRACT, Q.FOLDS, config)
    whole = ("true_negatives", "false_positives", "false_negatives", "true_positives")
    rows = [(name, round(threshold, 9), *(m[k] if k in whole else round(m[k], 9) for k in _METRICS)) for name, m in metrics.items()]
    kinds = ", ".join(f"{k} {'long' if k in whole else 'double'}" for k in _METRICS)
    return local_table(spark, rows, f"split string, threshold double, {kinds}")


def model_assessment(spark, d):
    return _assessed(spark, d, TrainingConfig(time_column="ts"))


def model_assessment_cost(spark, d):
    return _assessed(spark, d, TrainingConfig(time_column="ts", threshold_strategy="cost", false_positive_cost=1.0, false_negative_cost=5.0))


def isotonic_optimal(spark, d):
    """What holds for the best rising fit and for no other: in each block of equal predictions the errors sum to
    zero, and no first part of a block, by margin, has a lower mean than the block; blocks rise."""
    rows, out = _parts(spark, d), []
    folds = fit.fit_folds(rows, Q.CONTRACT, TrainingConfig(time_column="ts", calibration_method="isotonic", calibration_jobs=-1))
    for k, model in enumerate(folds, 1):
        held = rows.where(F.col("fold") == k)
        m, p, y = fit.margin(Q.FEATURES, model), score.fold_probability(Q.FEATURES, model), F.col("label").cast("long")
        scored = held.select(m.alias("m"), F.round(p, 12).alias("p"), y.alias("y")).groupBy("m", "p").agg(F.sum("y").alias("ones"), F.count("*").alias("n"))
        # sums up to each margin, from which a block's first parts follow
        upto = running(scored, ["p"], [F.col("m")], {"ones_upto": "ones", "n_upto": "n"})
        lower = F.col("p") * F.col("n_upto") - F.col("ones_upto")
        blocks = upto.groupBy("p").agg(F.max("ones_upto").alias("ones"), F.max("n_upto").alias("n"), F.max(lower).alias("lower"), F.min("m").alias("first"), F.max("m").alias("last"))
        after = F.lead("first").over(W.orderBy("p"))  # a row a block of the model
        told = blocks.withColumn("next", after).agg(
            F.round(F.max(F.abs(F.col("ones") - F.col("p") * F.col("n"))), 4), F.round(F.max(F.greatest("lower", F.lit(0.0))), 4), F.sum("n"), (F.count("*") > 1), F.min(F.coalesce(F.col("last") < F.col("next"), F.lit(True)))
        ).first()
        out.append((k, *told))
    return local_table(spark, out, "fold int, block_gap double, first_part_gap double, n_rows long, several_blocks boolean, rising boolean")


def card_strict(spark, d):
    """What reading a trained model's card says to it and to broken versions of it."""
    text = artifact.dump_card(train(Q.event_table(spark, d).drop("ts"), "label", ("event_id",), UNCALIBRATED).card)
    number = '"positive_rate": '
    at = text.index(number) + len(number)
    end = min(text.index(c, at) for c in ",}" if c in text[at:])
    made = {"sound": text, "not a number": text[:at] + "NaN" + text[end:], "infinite": text[:at] + "Infinity" + text[end:], "minus infinite": text[:at] + "-Infinity" + text[end:], "a list": f"[{text}]"}
    return _told(spark, {name: lambda t=t: artifact._strict(t) for name, t in made.items()} | {"dumping infinity": lambda: artifact.dump_card({"x": float("inf")}), "dumping nothing odd": lambda: artifact.dump_card({"x": 1.5})})


CARD_STRICT = {
    "sound": None, "not a number": "ModelError: The card has a number that is none: NaN", "infinite": "ModelError: The card has a number that is none: Infinity", "minus infinite": "ModelError: The card has a number that is none: -Infinity",
    "a list": "ModelError: The card must be an object", "dumping infinity": "ModelError: The card has a number that is none: Out of range float values are not JSON compliant: inf", "dumping nothing odd": None,
}

PROOFS = {f.__name__: f for f in (model_assessment, model_assessment_cost, isotonic_optimal, card_strict)}


def proof_sql(shuffled: str, probability: str) -> dict[str, str]:
    """``shuffled``: CTEs up to s (event_id, label, split); ``probability``: of a row of t."""

    def assessed(best: str, fp_cost: float, fn_cost: float) -> str:
        return f"""WITH {shuffled}, m AS (SELECT s.split, s.label, {probability} AS score FROM t JOIN s USING (event_id) WHERE s.split <> 'train'),
g AS (SELECT split, score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM m GROUP BY split, score),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY split) AS p, sum(neg) OVER (PARTITION BY split) AS n FROM g WINDOW w AS (PARTITION BY split ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
v AS (SELECT * FROM c WHERE split = 'validation'), b AS ({best}),
q AS (SELECT split, count(*) FILTER (label = 0 AND score < b.threshold) AS true_negatives, count(*) FILTER (label = 0 AND score >= b.threshold) AS false_positives,
    count(*) FILTER (label = 1 AND score < b.threshold) AS false_negatives, count(*) FILTER (label = 1 AND score >= b.threshold) AS true_positives, avg(pow(score - label, 2)) AS brier_score FROM m, b GROUP BY split),
a AS (SELECT split, sum(neg * (tp - pos / 2)) / (max(p) * max(n)) AS roc_auc, sum(pos * (tp / (tp + fp))) / max(p) AS average_precision FROM c GROUP BY split)
SELECT q.split, round(b.threshold, 9) AS threshold, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision, round(brier_score, 9) AS brier_score,
    round(true_positives / (true_positives + false_positives), 9) AS precision, round(true_positives / (true_positives + false_negatives), 9) AS recall, round(2 * true_positives / (2 * true_positives + false_positives + false_negatives), 9) AS f1,
    round((true_positives / (true_positives + false_negatives) + true_negatives / (true_negatives + false_positives)) / 2, 9) AS balanced_accuracy, true_negatives, false_positives, false_negatives, true_positives,
    round((false_positives * {fp_cost} + false_negatives * {fn_cost}) / (true_negatives + false_positives + false_negatives + true_positives), 9) AS expected_cost_per_transaction FROM q JOIN a USING (split), b"""

    f1 = "SELECT threshold FROM v ORDER BY 2 * tp / (tp + fp + p) DESC, threshold LIMIT 1"
    cost = """SELECT CASE WHEN top < 1 AND nothing < least THEN 1.0 ELSE threshold END AS threshold FROM (SELECT *, (fp * 1.0 + (p - tp) * 5.0) / (p + n) AS cost, min((fp * 1.0 + (p - tp) * 5.0) / (p + n)) OVER () AS least, max(threshold) OVER () AS top,
        p * 5.0 / (p + n) AS nothing FROM v) WHERE abs(cost - least) <= 1e-8 + 1e-5 * abs(least) ORDER BY tp DESC, threshold DESC LIMIT 1"""
    return {
        "model_assessment": assessed(f1, 1.0, 10.0), "model_assessment_cost": assessed(cost, 1.0, 5.0), "card_strict": _values(CARD_STRICT),
        "isotonic_optimal": f"""WITH {shuffled}, ranks AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42#' || event_id), event_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS size FROM s WHERE split = 'train'),
            f AS (SELECT CASE WHEN place < (size % 3) * (size // 3 + 1) THEN place // (size // 3 + 1) ELSE size % 3 + (place - (size % 3) * (size // 3 + 1)) // (size // 3) END + 1 AS fold FROM ranks)
            SELECT CAST(fold AS INTEGER) AS fold, CAST(0 AS DOUBLE) AS block_gap, CAST(0 AS DOUBLE) AS first_part_gap, count(*) AS n_rows, true AS several_blocks, true AS rising FROM f GROUP BY fold""",
    }
