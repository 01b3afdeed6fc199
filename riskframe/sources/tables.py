"""Reading and writing CSV tables, and reports as JSON."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskframe.contracts import DataError, FeatureContract, check_names
from riskframe.operators.validate import validate
from riskframe.sources.staging import exists, publish


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV table with a header. Names must be unique in the files themselves: Spark would rename them.

    Every file is opened here and its header must agree with the first one's, or the schema, in names and order
    (``enforceSchema`` is off), so faults are told before rows are used and no file is read into the wrong columns.
    """
    if not exists(spark, path):
        raise DataError(f"No such table: {path}")
    try:
        for r in spark.read.text(path).head(1):
            names = next(csv.reader([r.value.lstrip("\ufeff")]))
            if len(set(names)) < len(names):
                raise DataError(f"CSV columns must be unique: {sorted({n for n in names if names.count(n) > 1})}")
        reader = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    except PySparkException as e:
        raise DataError(f"Cannot read {path}: {str(e)[:200]}") from e
    if not df.columns:
        raise DataError(f"The table is empty: {path}")
    _check_headers(reader.schema(df.schema).csv(path), path)
    return df


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], ["opened"])
        return


def _check_headers(df: DataFrame, path: str) -> None:
    """Opens every file by a task of its own, which checks the header and stops after the first rows."""
    spark = df.sparkSession
    settings = {"spark.sql.files.openCostInBytes": "1g", "spark.sql.files.minPartitionNum": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.csv.parser.columnPruning.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df.mapInArrow(_first_rows, "opened int").write.format("noop").mode("overwrite").save()
    except (PySparkException, Py4JJavaError) as e:
        text = str(e)
        if "header" not in text.lower():
            return  # a cell, which its own reader tells
        raise DataError(f"Cannot read {path}: {text[:200]}") from e
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_labelled(spark: SparkSession, path: str, target: str = "Class", key: tuple[str, ...] = (), schema: T.StructType | str | None = None) -> tuple[DataFrame, FeatureContract]:
    df = read_csv(spark, path, schema)
    check_names(df.columns)
    try:
        return df, validate(df, target, key)
    except (PySparkException, Py4JJavaError) as e:  # headers and cells are read now
        raise DataError(f"Cannot read {path}: {str(e)[:200]}") from e


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    publish(df.sparkSession, path, lambda to: df.write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(to), overwrite)


def write_parquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    publish(df.sparkSession, path, df.write.parquet, overwrite)


def write_report(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A small report as JSON lines in one file."""
    publish(df.sparkSession, path, lambda to: df.coalesce(1).write.json(to), overwrite)
