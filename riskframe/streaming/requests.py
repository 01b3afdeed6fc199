"""JSON scoring requests: the same stateless expressions on static and streaming DataFrames.

A request is a row with a ``body`` such as {"transactions": [{feature: number, ...}, ...]}.  It is
scored whole or rejected whole; the answer keeps the order of its transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import dot, logistic
from riskframe.operators.fit import FoldModel
from riskframe.operators.score import _interpolated

# Fixed values of the request format.
MOST_BYTES, MOST_ROWS, ID_PATTERN = 2_097_152, 1000, r"\A[A-Za-z0-9._-]{1,128}\z"
_SHAPE = "transactions array<map<string,double>>, _broken string"


# Fixed values of the answers: the type and the message of each reason.
ERRORS = {
    "body is missing": ("missing", "a body is needed"), "body is too large": ("too_large", "the body has more bytes than are taken"), "body is not valid": ("invalid_json", "the body is no valid request"),
    "transactions are missing": ("missing", "transactions are needed"), "unknown field": ("extra_forbidden", "the body has a field that is not known"), "number of transactions": ("size", "a request has 1 to 1000 transactions"),
    "feature schema mismatch": ("schema_mismatch", "the features do not match the model"), "values must be finite": ("finite_number", "a value must be a finite number"),
}


def _error(reason: Column, rows: Column, wanted: Column) -> Column:
    """(location, type, message) of a rejected request: the first transaction, and feature, that is wrong."""
    wrong = lambda m: F.array_sort(F.map_keys(m)) != wanted
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    place = lambda test: (F.array_position(F.transform(rows, test), True) - 1).cast("int")
    row = F.when(reason == "feature schema mismatch", place(wrong)).when(reason == "values must be finite", place(lambda m: F.exists(F.map_values(m), bad)))
    named = F.when(reason == "values must be finite", F.array_min(F.map_keys(F.map_filter(F.try_element_at(rows, row + 1), lambda _, x: bad(x)))))
    inside = reason.isin("transactions are missing", "number of transactions", "feature schema mismatch", "values must be finite")
    parts = F.array(F.lit("body"), F.when(inside, F.lit("transactions")), row.cast("string"), named)
    kind, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (a, b) in ERRORS.items():
        kind, message = F.when(reason == name, a).otherwise(kind), F.when(reason == name, b).otherwise(message)
    return F.when(reason.isNotNull(), F.struct(F.array_compact(parts).alias("location"), kind.alias("type"), message.alias("message")))


def parse(requests: DataFrame, features: tuple[str, ...], body: str = "body") -> DataFrame:
    """Adds ``transactions``, ``reason`` and ``error`` (null where the request can be scored)."""
    text = F.col(body)
    parsed = F.from_json(text, _SHAPE, {"allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    df = requests.withColumn("_small", F.octet_length(text) <= MOST_BYTES).withColumn("_parsed", F.when(F.col("_small"), parsed))
    rows, wanted = F.col("_parsed.transactions"), F.array(*map(F.lit, sorted(features)))
    keys = F.when(F.col("_small"), F.json_object_keys(text))
    finite = F.forall(rows, lambda m: F.forall(F.map_values(m), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    reason = (
        F.when(text.isNull(), "body is missing").when(~F.col("_small"), "body is too large")
        .when(keys.isNull() | F.col("_parsed._broken").isNotNull(), "body is not valid")
        .when(~F.array_contains(keys, "transactions") | rows.isNull(), "transactions are missing")
        .when(F.size(keys) > 1, "unknown field")
        .when((F.size(rows) < 1) | (F.size(rows) > MOST_ROWS), "number of transactions")
        .when(F.exists(rows, lambda m: m.isNull()), "body is not valid")
        .when(F.exists(rows, lambda m: F.array_sort(F.map_keys(m)) != wanted), "feature schema mismatch")
        .when(~finite, "values must be finite")
    )
    return df.withColumn("reason", reason).withColumn("error", _error(F.col("reason"), rows, wanted)).withColumn("transactions", F.when(F.col("reason").isNull(), rows)).drop("_small", "_parsed")


def _row_probability(row: Column, features: tuple[str, ...], models: list[FoldModel]) -> Column:
    total = F.lit(0.0)
    for m in models:
        x = F.lit(m.intercept) + dot([(F.element_at(row, f) - a) / s for f, a, s in zip(features, m.means, m.scales, strict=True)], list(m.coefficients))
        c = m.calibrator
        total = total + (logistic(-(c.slope * x + c.intercept)) if c.method == "sigmoid" else _interpolated(x, c.boundaries, c.values) if c.method == "isotonic" else logistic(x))
    return total / len(models)


def correlation_id(given: Column, fallback: Column) -> Column:
    """The caller's id if it is safe, else one derived from ``fallback``, so that replays agree."""
    return F.when(given.rlike(ID_PATTERN), given).otherwise(F.md5(F.coalesce(fallback.cast("string"), F.lit(""))))


def score_requests(requests: DataFrame, features: tuple[str, ...], models: list[FoldModel], threshold: float, version: str, body: str = "body") -> DataFrame:
    """All columns but the body, with ``reason`` and ``error`` (of rejected requests), ``answer`` and ``response`` (JSON; of the others)."""
    parsed = parse(requests, features, body)

    def one(m: Column) -> Column:
        p = _row_probability(m, features, models)
        return F.struct(p.alias("fraud_probability"), (p >= threshold).alias("is_fraud"))

    answer = F.struct(F.lit(version).alias("model_version"), F.lit(float(threshold)).alias("threshold"), F.transform("transactions", one).alias("predictions"))
    kept = [c for c in requests.columns if c != body]
    return parsed.select(*kept, "reason", "error", F.when(F.col("reason").isNull(), answer).alias("answer")).withColumn("response", F.to_json("answer"))


def accepted(scored: DataFrame) -> DataFrame:
    return scored.where("reason IS NULL").drop("reason", "error")


def rejected(scored: DataFrame, ids: list[str]) -> DataFrame:
    """Who and why, never what was sent: reason, and error with its location, type and message."""
    return scored.where("reason IS NOT NULL").select(*ids, "reason", "error")
