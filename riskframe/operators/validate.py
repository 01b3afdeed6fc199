"""Checks of labelled tables, tables to score, and scored tables, each in one aggregation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.contracts import DataError, FeatureContract, RiskError, SchemaError, check_names, name_differences
from riskframe.functions import CHAINED, count_where, is_infinite, is_missing, number, quoted


def not_numeric(df: DataFrame, names: list[str] | tuple[str, ...]) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [n for n in names if not isinstance(types[n], T.NumericType)]


class Counts(NamedTuple):
    column_name: str
    n_null: int
    n_nan: int
    n_inf: int


def tells_case(df: DataFrame) -> bool:
    return str(df.sparkSession.conf.get("spark.sql.caseSensitive")).lower() == "true"


def _counts(columns: list[str] | tuple[str, ...]) -> list[Column]:
    out = []
    for k, name in enumerate(columns):
        value = number(name)
        out += [count_where(value.isNull()).alias(f"null_{k}"), count_where(F.coalesce(F.isnan(value), F.lit(False))).alias(f"nan_{k}"), count_where(is_infinite(value)).alias(f"inf_{k}")]
    return out


def validation_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_rows, n_null, n_nan, n_inf: one pass over all columns, then one row each."""
    one = df.agg(F.count("*").alias("n_rows"), *_counts(columns))
    rows = F.array(*(F.struct(F.lit(name).alias("column_name"), F.col("n_rows"), *(F.col(f"{kind}_{k}").alias(f"n_{kind}") for kind in ("null", "nan", "inf"))) for k, name in enumerate(columns)))
    return one.select(F.inline(rows))


def validate(df: DataFrame, target: str, key: tuple[str, ...] = ()) -> FeatureContract:
    """The contract of a labelled table; raises the first failure. Key columns are no features."""
    names = df.columns
    check_names([n for n in names if n.strip()], case_sensitive=tells_case(df))
    if target not in names:
        raise DataError(f"Target column {target!r} is absent")
    features = [n for n in names if n != target and n not in key]
    if not features:
        raise DataError("The table needs at least one feature")
    check_names(features)
    if wrong := not_numeric(df, features):
        raise DataError(f"Features must be numeric: {wrong}")
    kind = df.schema[target].dataType
    label_known = isinstance(kind, (T.NumericType, T.BooleanType))
    checked = [*features, target] if label_known else features
    # one pass: counts a column, and of the labels
    y = number(target) if label_known else F.lit(None).cast("double")
    labels = [F.count("*"), count_where(F.col(quoted(target)).isNull()), count_where(y == 0), count_where(y == 1), count_where(~y.isin(0.0, 1.0))]
    found = df.agg(*(c.alias(f"label_{k}") for k, c in enumerate(labels)), *_counts(checked)).first()
    rows, unlabelled, zeros, ones, others = found[: len(labels)]
    if not rows:
        raise DataError("The table is empty")
    report = [Counts(n, *found[len(labels) + 3 * k : len(labels) + 3 * k + 3]) for k, n in enumerate(checked)]
    own = [r for r in report if r.column_name != target]
    if missing := [r.column_name for r in own if r.n_null or r.n_nan]:
        raise DataError(f"Features have missing values: {missing}")
    if infinite := [r.column_name for r in own if r.n_inf]:
        raise DataError(f"Features have infinite values: {infinite}")
    if not label_known and not unlabelled:
        raise DataError(f"Target column {target!r} must be numeric")
    if not label_known or any(r.n_null or r.n_nan for r in report if r.column_name == target):
        raise DataError("Target column contains missing values")
    if others or not zeros or not ones:
        some = [r[0] for r in df.select(y.alias("y")).distinct().orderBy("y").limit(20).collect()]
        raise DataError(f"The target must have exactly the labels 0 and 1, found {some}")
    return FeatureContract(tuple(features), target, key)


def labelled(df: DataFrame, contract: FeatureContract) -> DataFrame:
    """Key, features as double in contract order, and the label as tinyint."""
    return df.select(*(F.col(quoted(k)) for k in contract.key), *(number(f).alias(f) for f in contract.features), F.col(quoted(contract.target)).cast("tinyint").alias(contract.target))


def match_schema(df: DataFrame, contract: FeatureContract, error: type[RiskError] = SchemaError) -> DataFrame:
    """The contract's features in order; target and key may ride along. No job."""
    names = [n for n in df.columns if n != contract.target and n not in contract.key]
    check_names(df.columns, error, tells_case(df))
    missing, unexpected = name_differences(contract.features, names)
    if missing or unexpected:
        raise error(f"Feature schema mismatch: missing={missing}, unexpected={unexpected}")
    if wrong := not_numeric(df, contract.features):
        raise error(f"Features must be numeric: {wrong}")
    return df


def bad_rows(contract: FeatureContract) -> Column:
    """Whether a row has a feature that is missing or infinite."""
    if len(contract.features) > CHAINED:
        return F.exists(F.array(*(number(f) for f in contract.features)), lambda x: is_missing(x) | is_infinite(x))
    out = F.lit(False)
    for f in contract.features:
        out = out | is_missing(number(f)) | is_infinite(number(f))
    return out


def check_scorable(df: DataFrame, contract: FeatureContract, error: type[RiskError] = SchemaError) -> DataFrame:
    match_schema(df, contract, error)
    rows, bad = df.agg(F.count("*"), count_where(bad_rows(contract))).first()
    if not rows:
        raise error("The table is empty")
    if bad:
        raise error(f"{bad} rows have missing or infinite values")
    return df


def score_problems(score: Column) -> Column:
    return count_where(is_missing(score) | (score < 0) | (score > 1))


def check_scored(df: DataFrame, label: str, score: str) -> None:
    """Labels exactly 0 and 1 (either may be absent), scores finite and within 0 and 1, at least one row."""
    y = number(label)
    rows, other, wrong = df.agg(F.count("*"), count_where(is_missing(y) | ~y.isin(0.0, 1.0)), score_problems(number(score))).first()
    if not rows:
        raise DataError("No scored rows")
    if other:
        raise DataError("Labels must be 0 or 1")
    if wrong:
        raise DataError("Probabilities must be finite and between 0 and 1")


def dataset_summary(df: DataFrame, target: str) -> DataFrame:
    y = number(target)
    return df.agg(
        F.count("*").alias("n_rows"), count_where(y == 1).alias("n_positive"), F.avg(y).alias("positive_rate"), F.least(count_where(y == 1), count_where(y == 0)).alias("n_minority")
    )


def key_differences(df: DataFrame, json: str, expected: tuple[str, ...]) -> DataFrame:
    """Rows whose JSON objects lack an expected key or have another: (side, feature, n_rows)."""
    keys = F.coalesce(F.json_object_keys(F.col(json)), F.array().cast("array<string>"))
    wanted = F.array(*map(F.lit, expected))
    missing = df.select(F.lit("missing").alias("side"), F.explode(F.array_except(wanted, keys)).alias("feature"))
    unexpected = df.select(F.lit("unexpected").alias("side"), F.explode(F.array_except(keys, wanted)).alias("feature"))
    return missing.union(unexpected).groupBy("side", "feature").agg(F.count("*").alias("n_rows"))
