"""Scored requests as two tables, one of answers and one of rejections, that replays of a stream write once.

Each micro-batch writes a folder a table, named by the batch, and is entered in a ledger when both are
complete.  A batch that the stream replays after a failure overwrites what it left unfinished, or does nothing
if the ledger has it.  Readers read the batches of the ledger only, so they never see half of one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskframe.functions import count_where
from riskframe.operators.fit import FoldModel
from riskframe.sources.staging import _path
from riskframe.sources.versions import _read_text, write_small
from riskframe.streaming.requests import score_requests

TABLES = ("accepted", "rejected")


class Ledger:
    """Which batches of a stream are written, and how many rows each has: one small object a batch."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _entry(self, batch: int) -> str:
        return f"{self.base}/ledger/{batch:020d}"

    def has(self, batch: int) -> bool:
        p, fs = _path(self.spark, self._entry(batch))
        return fs.exists(p)

    def enter(self, batch: int, counts: dict[str, int]) -> None:
        p, fs = _path(self.spark, f"{self.base}/ledger")
        fs.mkdirs(p)
        write_small(self.spark, self._entry(batch), json.dumps(counts, sort_keys=True), overwrite=False)

    def batches(self) -> dict[int, dict[str, int]]:
        p, fs = _path(self.spark, f"{self.base}/ledger")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        return {int(n): json.loads(_read_text(self.spark, f"{self.base}/ledger/{n}")) for n in names if n.isdigit()}

    def folder(self, table: str, batch: int) -> str:
        return f"{self.base}/{table}/batch={batch}"

    def read(self, table: str) -> DataFrame | None:
        """All entered batches of a table that have rows there; None if none has."""
        folders = [self.folder(table, b) for b, counts in self.batches().items() if counts[table]]
        return self.spark.read.parquet(*folders) if folders else None


def writer(ledger: Ledger, ids: list[str]) -> Callable[[DataFrame, int], None]:
    """The handler of a micro-batch of :func:`score_requests`; rejected rows keep ``ids``, reason and error."""

    def write(batch: DataFrame, number: int) -> None:
        if ledger.has(number):
            return
        seen = Observation()
        held = batch.observe(seen, count_where(F.col("reason").isNull()).alias("accepted"), count_where(F.col("reason").isNotNull()).alias("rejected")).persist()
        try:
            held.where("reason IS NULL").drop("reason", "error").write.mode("overwrite").parquet(ledger.folder("accepted", number))
            held.where("reason IS NOT NULL").select(*ids, "reason", "error").write.mode("overwrite").parquet(ledger.folder("rejected", number))
            ledger.enter(number, dict(seen.get))
        finally:
            held.unpersist()

    return write


def start(requests: DataFrame, features: tuple[str, ...], models: list[FoldModel], threshold: float, version: str, base: str, checkpoint: str, ids: list[str], body: str = "body", once: bool = False) -> StreamingQuery:
    """Scores a stream of requests into the two tables below ``base``; ``once`` stops at the end of what there is."""
    scored = score_requests(requests, features, models, threshold, version, body)
    out = scored.writeStream.foreachBatch(writer(Ledger(requests.sparkSession, base), ids)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
