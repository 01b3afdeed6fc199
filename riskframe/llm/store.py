"""Tables and files that a job keeps in the folder which the cluster shares (see riskframe.sources.staging)."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from riskframe.contracts import RiskError
from riskframe.sources.staging import again, discard, keep
from riskframe.sources.staging import shared_path as shared_dir

__all__ = ["again", "discard", "filesystem", "keep", "shared_dir", "table", "workers_folder"]
#: Schemes of Hadoop's stores, and what Arrow calls them; these can be opened by workers.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gcs", "abfs": "abfs", "abfss": "abfss"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _arrow_uri(folder: str) -> str:
    scheme, found, rest = folder.partition("://")
    if not found:
        return folder
    if scheme not in SCHEMES:
        raise RiskError(f"Workers can't open {scheme}:// folders; spark.checkpoint.dir may use {sorted(SCHEMES)}")
    return f"{SCHEMES[scheme]}://{rest}"


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder as a worker opens it, and the path in it."""
    return pafs.FileSystem.from_uri(_arrow_uri(folder))


def workers_folder(spark: SparkSession) -> str:
    """A new shared folder that workers read and write files in; fails here, before any job, where they can't."""
    folder = shared_dir(spark)
    _arrow_uri(folder)
    return folder
