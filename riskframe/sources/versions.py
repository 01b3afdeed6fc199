"""Tables published by pointer: whole versions in folders of their own, and one small object that names the current one.

On object stores a rename copies every file and readers see it half done.  Here a version's folder never
moves: once it is complete, the pointer is replaced, and a reader who follows it sees the old version
or the new one, at any moment and after any failure.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from riskframe.contracts import RiskError
from riskframe.sources.staging import _path

POINTER, FOLDER = "_current", "versions"


def _read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    """A small object that appears whole: written beside its place, then put there by one atomic step."""
    p, fs = _path(spark, path)
    staged = _path(spark, f"{p.getParent().toString()}/._{p.getName()}_{uuid.uuid4().hex}")[0]
    stream = fs.create(staged, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()) if p.toUri().getScheme() else spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    kinds = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    kinds[0] = rename.OVERWRITE if overwrite else rename.NONE
    try:
        context.rename(staged, p, kinds)
    except Py4JJavaError as e:
        fs.delete(staged, False)
        raise RiskError(f"Cannot put {path}: {str(e.java_exception)[:200]}") from e


def current(spark: SparkSession, target: str) -> str | None:
    """The folder of the current version; None before the first."""
    name = _read_text(spark, f"{target}/{POINTER}")
    return None if name is None else f"{target}/{FOLDER}/{name}"


def publish_version(spark: SparkSession, target: str, write: Callable[[str], None], overwrite: bool = True) -> str:
    """``write`` fills the folder of a new version, which then becomes the current one; a failure changes nothing.

    Returns the folder.  ``overwrite=False`` refuses where there is a version.
    """
    if not overwrite and current(spark, target) is not None:
        raise RiskError(f"Output exists: {target}")
    name = uuid.uuid4().hex
    folder = f"{target}/{FOLDER}/{name}"
    try:
        write(folder)
        write_small(spark, f"{target}/{POINTER}", name, overwrite=True)
    except BaseException:
        p, fs = _path(spark, folder)
        fs.delete(p, True)
        raise
    return folder


def read_current(spark: SparkSession, target: str) -> DataFrame:
    folder = current(spark, target)
    if folder is None:
        raise RiskError(f"Nothing is published at {target}")
    return spark.read.parquet(folder)


def versions(spark: SparkSession, target: str) -> list[str]:
    """Names of all version folders, the oldest first, the current one last."""
    p, fs = _path(spark, f"{target}/{FOLDER}")
    found = sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []
    now = (current(spark, target) or "").rpartition("/")[2]
    return [n for _, n in found if n != now] + [n for _, n in found if n == now]


def clean(spark: SparkSession, target: str, keep: int = 2) -> list[str]:
    """Deletes all but the newest ``keep`` versions, never the current one; returns the names that went.

    Call it when no writer is at work and the readers of older versions have ended.
    """
    if keep < 1:
        raise RiskError("The current version stays")
    gone = versions(spark, target)[:-keep]
    for name in gone:
        p, fs = _path(spark, f"{target}/{FOLDER}/{name}")
        fs.delete(p, True)
    return gone
