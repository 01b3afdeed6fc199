"""Curves of scored tables: one row a distinct score, with running counts of positives and negatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import number, ratio
from riskframe.operators.prefix import running


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (threshold, pos, neg) of equal thresholds in a batch as one: what a task sends is bounded by its distinct scores."""
    for batch in batches:
        scores, at = np.unique(np.asarray(batch["threshold"], np.float64), return_inverse=True)
        counts = [np.bincount(at, np.asarray(batch[c], np.float64), len(scores)).astype(np.int64) for c in ("pos", "neg")]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (scores, *counts)], ["threshold", "pos", "neg"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for a task whose rows come sorted by falling threshold, also across batches."""
    held: pa.RecordBatch | None = None
    for batch in _counted(batches):
        batch = batch.take(pa.array(np.arange(batch.num_rows)[::-1]))
        if held is not None and batch.num_rows and held["threshold"][held.num_rows - 1] == batch["threshold"][0]:
            first = [pa.array([held[c][held.num_rows - 1].as_py() + batch[c][0].as_py()]) for c in ("pos", "neg")]
            batch = pa.RecordBatch.from_arrays([batch["threshold"], *(pa.concat_arrays([f, batch[c][1:]]) for f, c in zip(first, ("pos", "neg"), strict=True))], ["threshold", "pos", "neg"])
            held = held.slice(0, held.num_rows - 1)
        if held is not None and held.num_rows:
            yield held
        held = batch
    if held is not None:
        yield held


def score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, pos, neg, tp, fp: rows at each score, and at or above it. Written once: metrics read it often.

    Rows of equal scores are counted before the one shuffle, so a score that many rows share sends few.
    """
    y, kinds = number(label), "threshold double, pos long, neg long"
    rows = df.where(number(score).isNotNull()).select((number(score) + 0.0).alias("threshold"), F.coalesce((y == 1).cast("long"), F.lit(0)).alias("pos"), F.coalesce((y == 0).cast("long"), F.lit(0)).alias("neg"))
    return running(rows.mapInArrow(_counted, kinds), [], [F.col("threshold").desc()], {"tp": "pos", "fp": "neg"}, merge=_merged)


def with_totals(groups: DataFrame) -> DataFrame:
    totals = groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return groups.join(F.broadcast(totals))  # one row


def pr_curve(groups: DataFrame) -> DataFrame:
    """threshold, precision, recall."""
    return with_totals(groups).select("threshold", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("p")).alias("recall"))


def roc_curve(groups: DataFrame) -> DataFrame:
    """threshold, fpr, tpr, at every distinct score."""
    return with_totals(groups).select("threshold", ratio(F.col("fp"), F.col("n")).alias("fpr"), ratio(F.col("tp"), F.col("p")).alias("tpr"))
