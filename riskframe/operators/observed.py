"""A batch scored, checked, counted and written in one scan, by metrics that the write job observes.

The counts ride along with the rows that are written: values that are missing or infinite by column, scores
that are no probabilities, flagged rows.  The output is published only after they were looked at, so a
batch with a fault costs one scan and leaves what was there before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from riskframe.contracts import FeatureContract, ModelError, SchemaError
from riskframe.functions import count_where, is_infinite, local_table, number
from riskframe.operators.fit import FoldModel
from riskframe.operators.score import add_scores
from riskframe.operators.validate import bad_rows, match_schema, score_problems
from riskframe.sources.staging import publish


@dataclass(frozen=True)
class ScoreReport:
    """What a score job saw: rows, flagged ones, and of each feature how many values are null, NaN or infinite."""

    n_rows: int
    n_flagged: int
    features: dict[str, tuple[int, int, int]]

    def table(self, spark) -> DataFrame:
        """metric, column_name, n: in long form; whole-table metrics have no column."""
        rows = [("rows", None, self.n_rows), ("flagged", None, self.n_flagged)]
        rows += [(kind, f, n) for f, own in self.features.items() for kind, n in zip(("null", "nan", "infinite"), own, strict=True)]
        return local_table(spark, rows, "metric string, column_name string, n long")


def score_metrics(contract: FeatureContract, score: str, flag: str) -> dict[str, Column]:
    """The observed counts by name."""
    out = {"rows": F.count(F.lit(1)), "bad_rows": count_where(bad_rows(contract)), "bad_scores": score_problems(F.col(score)), "flagged": F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0))}
    for k, f in enumerate(contract.features):
        value = number(f)
        out |= {f"null_{k}": count_where(value.isNull()), f"nan_{k}": count_where(F.coalesce(F.isnan(value), F.lit(False))), f"inf_{k}": count_where(is_infinite(value))}
    return out


def publish_scores(df: DataFrame, contract: FeatureContract, models: list[FoldModel], threshold: float, path: str, overwrite: bool = False, score: str = "fraud_probability", flag: str = "is_fraud", columns: list[str] | None = None, publisher=publish) -> ScoreReport:
    """Scores ``df`` into a table at ``path`` (``columns``, or all) and tells what the job saw.

    One job that scans once: nothing is counted or checked by another.  A table that is empty, has bad values or
    gets scores that are no probabilities raises before anything appears at ``path``.
    """
    match_schema(df, contract)
    seen = Observation()
    metrics = score_metrics(contract, score, flag)
    watched = add_scores(df, contract.features, models, threshold, score, flag).observe(seen, *(c.alias(n) for n, c in metrics.items()))
    report: list[ScoreReport] = []

    def write(to: str) -> None:
        (watched.select(*columns) if columns else watched).write.parquet(to)
        told = seen.get
        if not told["rows"]:
            raise SchemaError("The table is empty")
        if told["bad_rows"]:
            raise SchemaError(f"{told['bad_rows']} rows have missing or infinite values")
        if told["bad_scores"]:
            raise ModelError("The model gives scores that are no probabilities")
        own = {f: (told[f"null_{k}"], told[f"nan_{k}"], told[f"inf_{k}"]) for k, f in enumerate(contract.features)}
        report.append(ScoreReport(told["rows"], told["flagged"], own))

    publisher(df.sparkSession, path, write, overwrite)
    return report[0]
