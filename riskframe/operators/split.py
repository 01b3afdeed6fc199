"""Splits into train, validation and test rows, and calibration folds. All are exact and repeatable.

Rows carry a ``split`` column, so the parts are disjoint and complete.  Order needs a unique key: of rows
that are equal in all of it, any may come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.contracts import DataError, FeatureContract, TrainingConfig
from riskframe.functions import quoted
from riskframe.operators.cutoffs import TiedError, all_positions, cutoffs
from riskframe.operators.prefix import ranked


def _need_key(contract: FeatureContract) -> list[Column]:
    if not contract.key:
        raise DataError("Splitting needs key columns: rows have no order of their own")
    return [F.col(quoted(k)) for k in contract.key]


def class_counts(df: DataFrame, target: str) -> dict[int, int]:
    return {int(r[0]): r[1] for r in df.groupBy(F.col(quoted(target)).cast("int")).count().collect()}


def check_capacity(counts: dict[int, int], config: TrainingConfig) -> None:
    minority = min(counts.get(0, 0), counts.get(1, 0))
    if minority < 6:
        raise DataError(f"Each class needs at least 6 rows, the smaller has {minority}")
    if minority * config.test_size < 1 or minority * config.validation_size < 1:
        raise DataError("The smaller class is too small for the requested test and validation sizes")


def capacity_report(df: DataFrame, target: str, config: TrainingConfig) -> DataFrame:
    """label, n, enough: whether each class can fill the splits."""
    n = F.col("n")
    enough = (n >= 6) & (n * config.test_size >= 1) & (n * config.validation_size >= 1)
    return df.groupBy(F.col(quoted(target)).cast("int").alias("label")).agg(F.count("*").alias("n")).withColumn("enough", enough)


def shuffle_order(contract: FeatureContract, seed: int) -> list[Column]:
    """A repeatable shuffle: the digest of the seed and the key, then the key."""
    key = _need_key(contract)
    return [F.md5(F.concat_ws("#", F.lit(str(seed)), *(k.cast("string") for k in key))), *key]


def row_order(contract: FeatureContract, config: TrainingConfig) -> list[Column]:
    """The order that training splits by, and cuts its folds in: by time, or shuffled."""
    if config.split_strategy == "temporal":
        return [F.col(quoted(config.time_column)), *_need_key(contract)]
    return shuffle_order(contract, config.random_state)


def with_place(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the first position of ``order``: where it is written, what is ``placed`` by it makes no digest again."""
    return df.withColumn(name, all_positions(df, order)[0])


def _parted(df: DataFrame, group: Column | None, order: list[Column], sizes: dict[int, list[int]], names: list[str] | None, column: str, placed: str | None = None) -> DataFrame:
    """Adds ``column``: which of consecutive parts a row is in, by its place in ``order`` within its group.

    sizes: of each group, the numbers of rows of its parts; names: of the parts, numbers from 1 without; placed:
    a column with the order's first position (:func:`with_place`), which is made here without.  The
    cutoffs between parts are found by selection and rows are told by a filter; where rows that are
    equal in the whole order lie on both sides of a cutoff, rows are ranked instead.
    """
    own, last = F.lit(0) if group is None else group, max(map(len, sizes.values()))
    label = lambda k: F.lit(names[k] if names else k + 1)
    ends = {g: [sum(parts[: k + 1]) for k in range(len(parts) - 1)] for g, parts in sizes.items()}
    try:
        places, ready = all_positions(df, order), df
        if placed:
            places[0] = F.col(placed)
        cuts = cutoffs(df, own, places, ends)
        if not placed:  # made once a row for all cutoffs
            ready, places[0] = df.withColumn("_place", places[0]), F.col("_place")
        before = {(g, n): cut.holds(places) for (g, n), cut in cuts.items()}
    except TiedError:
        ordered = [f"_order_{k}" for k in range(len(order))]
        keyed = df.withColumns(dict(zip(ordered, order, strict=True))).withColumn("_group", own)
        ready = ranked(keyed, ["_group"], [F.col(c) for c in ordered], "_rank").drop("_group", *ordered)
        before = {(g, n): F.col("_rank") <= n for g, ns in ends.items() for n in ns}
    part = F.lit(None).cast("string" if names else "int")
    for g, ns in ends.items():
        inside = label(last - 1) if len(ns) == last - 1 else label(len(ns))
        for k in reversed(range(len(ns))):
            inside = F.when(before[g, ns[k]], label(k)).otherwise(inside)
        part = inside if group is None else F.when(own == g, inside).otherwise(part)
    return ready.withColumn(column, part).drop("_rank", "_place")


def stratified_split(df: DataFrame, contract: FeatureContract, config: TrainingConfig, placed: str | None = None) -> DataFrame:
    """Test rows first, then validation rows from what is left, in each class."""
    sizes = {}
    for label, n in class_counts(df, contract.target).items():
        n_test = round(n * config.test_size)
        n_validation = round((n - n_test) * (config.validation_size / (1 - config.test_size)))
        sizes[label] = [n_test, n_validation, n - n_test - n_validation]
    if not sizes:
        return df.withColumn("split", F.lit("train"))
    return _parted(df, F.col(quoted(contract.target)).cast("int"), shuffle_order(contract, config.random_state), sizes, ["test", "validation", "train"], "split", placed)


def temporal_split(df: DataFrame, contract: FeatureContract, config: TrainingConfig, placed: str | None = None) -> DataFrame:
    """The oldest rows train, the next validate, the newest test; ties by key."""
    if config.time_column not in df.columns:
        raise DataError(f"Time column {config.time_column!r} is absent")
    n = df.count()
    n_test, n_validation = max(1, round(n * config.test_size)), max(1, round(n * config.validation_size))
    n_train = n - n_test - n_validation
    if n_train < 1:
        raise DataError("The temporal split leaves no training rows")
    order = [F.col(quoted(config.time_column)), *_need_key(contract)]
    return _parted(df, None, order, {0: [n_train, n_validation, n_test]}, ["train", "validation", "test"], "split", placed)


def check_classes(df: DataFrame, target: str) -> None:
    """Every split holds both classes."""
    y = F.col(quoted(target)).cast("int")
    poor = [r.split for r in df.groupBy("split").agg(F.min(y).alias("a"), F.max(y).alias("b")).collect() if (r.a, r.b) != (0, 1)]
    if poor:
        raise DataError(f"Each temporal window must hold both classes: {sorted(poor)} do not")


def split(df: DataFrame, contract: FeatureContract, config: TrainingConfig, placed: str | None = None) -> DataFrame:
    check_capacity(class_counts(df, contract.target), config)
    if config.split_strategy == "stratified":
        return stratified_split(df, contract, config, placed)
    out = temporal_split(df, contract, config, placed)
    check_classes(out, contract.target)
    return out


def split_sizes(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col(quoted(target)).cast("long")).alias("n_positive"))


def split_ranges(df: DataFrame, target: str, time: str) -> DataFrame:
    """split, n, n_positive, t_min, t_max."""
    t = F.col(quoted(time))
    return df.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col(quoted(target)).cast("long")).alias("n_positive"), F.min(t).alias("t_min"), F.max(t).alias("t_max"))


def assign_folds(df: DataFrame, contract: FeatureContract, folds: int, order: list[Column], placed: str | None = None) -> DataFrame:
    """Adds ``fold`` from 1: consecutive blocks of each class in ``order``, the first ones a row longer."""
    counts = class_counts(df, contract.target)
    if min(counts.get(0, 0), counts.get(1, 0)) < folds:
        raise DataError(f"A class has fewer rows than the {folds} calibration folds")
    sizes = {label: [n // folds + (k < n % folds) for k in range(folds)] for label, n in counts.items()}
    return _parted(df, F.col(quoted(contract.target)).cast("int"), order, sizes, None, "fold", placed)
