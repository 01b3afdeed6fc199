"""Tables in the shared folder, and outputs that appear whole or not at all.

``spark.checkpoint.dir`` names the shared folder; a folder of this machine is used only where that
setting is absent, as in a local session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskframe.contracts import RiskError

_local: dict[str, str] = {}


def shared_path(spark: SparkSession) -> str:
    """A new folder name (not created) below the shared folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RiskError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="riskframe-")
        base = "file://" + _local[app]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Spark's settings while a table is kept: a query that has ended gives its shuffle files back, and batches
#: that go to Python stay small beside an executor's heap.
WHILE_KEPT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def keep(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: one layout for all later uses, and no lineage before it.

    Once the table is written nothing needs the shuffles that led to it, so they are given back.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    before = {name: spark.conf.get(name) for name in WHILE_KEPT}
    try:
        for name, value in WHILE_KEPT.items():
            spark.conf.set(name, value)
        df.write.option("compression", compression).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    kept = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])).parquet(path)
    kept._kept_at = path
    return kept


def again(kept: DataFrame) -> DataFrame:
    """A kept table as a new DataFrame, for joins with itself."""
    return kept.sparkSession.read.schema(kept.schema).parquet(kept._kept_at)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`keep` which no lazy result needs any more."""
    for df in tables:
        path, fs = _path(df.sparkSession, df._kept_at)
        fs.delete(path, True)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def is_free(spark: SparkSession, path: str) -> bool:
    """Absent, or a folder without entries."""
    p, fs = _path(spark, path)
    return not fs.exists(p) or (fs.getFileStatus(p).isDirectory() and len(fs.listStatus(p)) == 0)


def publish(spark: SparkSession, target: str, write: Callable[[str], None], overwrite: bool = False) -> None:
    """``write`` fills a sibling folder, which then takes the target's name; a failure leaves the old output."""
    p, fs = _path(spark, target)
    if not overwrite and not is_free(spark, target):
        raise RiskError(f"Output exists: {target}")
    parent = p.getParent().toString()
    staged, old = (f"{parent}/._{kind}_{uuid.uuid4().hex}" for kind in ("staging", "old"))
    try:
        write(staged)
        if fs.exists(p):
            fs.rename(p, _path(spark, old)[0])
        if not fs.rename(_path(spark, staged)[0], p):
            if fs.exists(_path(spark, old)[0]):
                fs.rename(_path(spark, old)[0], p)
            raise RiskError(f"Cannot publish {target}")
    finally:
        for left in (staged, old):
            fs.delete(_path(spark, left)[0], True)
