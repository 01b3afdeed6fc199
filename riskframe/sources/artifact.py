"""Stored models: parameter tables, a card, and a manifest of digests. Loading runs no stored code."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.contracts import FeatureContract, ModelError
from riskframe.operators.fit import Calibrator, FoldModel
from riskframe.plans.train import RiskModel, check_model
from riskframe.sources.staging import exists, publish

PARAMS = "fold int, means array<double>, scales array<double>, coefficients array<double>, intercept double, method string, slope double, offset double, boundaries array<double>, values array<double>"


def _strict(text: str) -> dict:
    def refuse(name: str) -> None:
        raise ModelError(f"The card has a number that is none: {name}")

    found = json.loads(text, parse_constant=refuse)
    if not isinstance(found, dict):
        raise ModelError("The card must be an object")
    return found


def dump_card(card: dict) -> str:
    try:
        return json.dumps(card, allow_nan=False, sort_keys=True)
    except ValueError as e:
        raise ModelError(f"The card has a number that is none: {e}") from e


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path (below ``path``), sha256 and length of every data file."""
    name = F.regexp_extract("path", r"([^/]+/part-[^/]+)$", 1)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select(name.alias("path"), F.sha2("content", 256).alias("sha256"), "length")


def manifest_differences(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, problem: files that changed, are missing, or are not listed."""
    a, b = found.select("path", F.col("sha256").alias("now")), manifest.select("path", "sha256")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when(F.col("now") != F.col("sha256"), "changed")
    return a.join(b, "path", "full").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def save(model: RiskModel, spark: SparkSession, path: str, overwrite: bool = False) -> str:
    """Checked, then written beside ``path``, the manifest last, then renamed."""
    check_model(model)
    card = dump_card(model.card)
    rows = [(k, [*m.means], [*m.scales], [*m.coefficients], m.intercept, (c := m.calibrator).method, c.slope, c.intercept, [*c.boundaries], [*c.values]) for k, m in enumerate(model.folds)]

    def write(to: str) -> None:
        spark.createDataFrame(rows, PARAMS).coalesce(1).write.parquet(f"{to}/params")
        spark.createDataFrame([(card,)], "value string").coalesce(1).write.text(f"{to}/card")
        listed = file_digests(spark, to).coalesce(1)
        listed.withColumn("artifact_version", F.lit(model.version)).withColumn("hash_algorithm", F.lit("sha256")).write.json(f"{to}/manifest")

    publish(spark, path, write, overwrite)
    return path


def load(spark: SparkSession, path: str) -> RiskModel:
    if not exists(spark, f"{path}/manifest"):
        raise ModelError(f"No manifest in {path}")
    try:
        manifest = spark.read.schema("path string, sha256 string, length long, artifact_version int, hash_algorithm string").json(f"{path}/manifest")
        found = file_digests(spark, path).where("path NOT LIKE 'manifest/%'")
        if wrong := manifest_differences(found, manifest).collect():
            raise ModelError(f"The artifact's files do not match its manifest: {[(r.path, r.problem) for r in wrong]}")
        card = _strict("\n".join(r.value for r in spark.read.text(f"{path}/card").collect()))
        rows = spark.read.schema(PARAMS).parquet(f"{path}/params").orderBy("fold").collect()
        version = manifest.first().artifact_version
    except (PySparkException, Py4JJavaError, json.JSONDecodeError) as e:  # a file system may notice a changed file itself
        raise ModelError(f"The files of {path} cannot be read or do not match its manifest: {str(e)[:200]}") from e
    folds = [FoldModel(tuple(r.means), tuple(r.scales), tuple(r.coefficients), r.intercept, Calibrator(r.method, r.slope, r.offset, tuple(r.boundaries), tuple(r["values"]))) for r in rows]
    contract = FeatureContract(tuple(card.get("feature_names", ())), card.get("target"), tuple(card.get("key", ())))
    return check_model(RiskModel(contract, folds, card.get("threshold"), card, version))
