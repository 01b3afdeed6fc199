"""Drift of streams: event-time windows that hold counts by bin, compared with a reference profile as tables are.

The state of a window is features times bins; a window's counts are final, and told, once the watermark has
passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskframe.contracts import DriftError
from riskframe.functions import is_finite, quoted
from riskframe.operators import drift
from riskframe.operators.drift import EPSILON, bin_of, status_of

COUNTS = "window_start timestamp, feature string, ordinal int, bin int, n long"


def checked_profile(profile: DataFrame) -> list:
    """The rows of a valid profile."""
    rows = profile.orderBy("ordinal").collect()
    if not rows:
        raise DriftError("The reference profile is empty")
    bad = [r for r in drift.profile_faults(profile.orderBy("ordinal")).collect() if r.fault]
    if bad:
        raise DriftError(f"The reference profile is malformed: {bad[0].feature}: {bad[0].fault}")
    return rows


def window_counts(df: DataFrame, profile: DataFrame, time: str, width: str, delay: str | None = None) -> DataFrame:
    """COUNTS of a table or, with ``delay`` as its watermark, of a stream; bin -1 has missing and infinite values."""
    rows = checked_profile(profile)
    known = F.create_map(*(x for r in rows for x in (F.lit(r.feature), F.array(*map(F.lit, r.interior_edges)).cast("array<double>"))))
    timed = df.withColumn("_time", F.col(quoted(time)).cast("timestamp"))
    timed = timed.withWatermark("_time", delay) if delay else timed
    pairs = F.array(*(F.struct(F.lit(r.ordinal).alias("ordinal"), F.lit(r.feature).alias("feature"), F.col(quoted(r.feature)).cast("double").alias("value")) for r in rows))
    values = timed.select("_time", F.inline(pairs))
    placed = F.when(is_finite(F.col("value")), bin_of(F.col("value"), F.element_at(known, F.col("feature")))).otherwise(-1)
    counted = values.groupBy(F.window("_time", width).alias("w"), "feature", "ordinal", placed.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "feature", "ordinal", "bin", "n")


def window_drift(profile: DataFrame, counts: DataFrame) -> DataFrame:
    """window_start, feature, ordinal, n_rows, n_bad, psi, status: each window compared with the profile.

    Bad values take no part in the index, and are counted; a window of bad values only has no index.
    """
    expected = drift.profile_bins(profile).select("feature", "bin", "expected")
    totals = counts.groupBy("window_start", "feature", "ordinal").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("bin") < 0, F.col("n")).otherwise(0)).alias("n_bad"))
    all_bins = totals.join(expected, "feature")
    own = counts.where("bin >= 0").select("window_start", "feature", "bin", "n")
    met = all_bins.join(own, ["window_start", "feature", "bin"], "left")
    good = F.col("n_rows") - F.col("n_bad")
    actual = F.try_divide(F.coalesce("n", F.lit(0)), good)
    term = (actual - F.col("expected")) * F.ln((actual + EPSILON) / (F.col("expected") + EPSILON))
    psi = F.when(F.max(good) > 0, F.greatest(F.lit(0.0), F.sum(term)))
    out = met.groupBy("window_start", "feature", "ordinal", "n_rows", "n_bad").agg(psi.alias("psi"))
    return out.withColumn("status", F.when(F.col("psi").isNotNull(), status_of(F.col("psi"))))


def start(stream: DataFrame, profile: DataFrame, time: str, width: str, delay: str, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends the counts of closed windows to a table at ``path``; read it with COUNTS and :func:`window_drift`."""
    out = window_counts(stream, profile, time, width, delay).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
