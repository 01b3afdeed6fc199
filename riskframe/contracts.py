"""Errors, the feature contract of a table, and the training configuration."""

from __future__ import annotations

import math
from dataclasses import dataclass


class RiskError(ValueError):
    """Base of all errors raised here."""


class DataError(RiskError):
    """A table breaks the labelled-table contract."""


class SchemaError(RiskError):
    """A table to score or compare does not have the contract's features."""


class ModelError(RiskError):
    """A configuration, a fit or a stored model is not usable."""


class DriftError(RiskError):
    """A reference profile or a table compared with it is not usable."""


@dataclass(frozen=True)
class FeatureContract:
    """Ordered features of a table, its target, and the columns that identify a row."""

    features: tuple[str, ...]
    target: str | None = None
    key: tuple[str, ...] = ()


def check_names(names: list[str], error: type[RiskError] = DataError, case_sensitive: bool = True) -> None:
    """Column names are unique and not empty.

    Names that differ only by case are different columns, which a session tells apart if
    ``spark.sql.caseSensitive`` is true; where it isn't, they are an error here instead of one of analysis.
    """
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise error(f"Duplicate column names: {twice}")
    if not case_sensitive:
        low = [n.lower() for n in names]
        if alike := sorted(n for n in names if low.count(n.lower()) > 1):
            raise error(f"Columns that differ only by case need spark.sql.caseSensitive: {alike}")
    if any(not n.strip() for n in names):
        raise error("Feature names must not be empty")


def name_differences(expected: tuple[str, ...], found: list[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected), sorted."""
    return sorted(set(expected) - set(found)), sorted(set(found) - set(expected))


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ModelError(f"{name} must be between {low} and {high}")


@dataclass(frozen=True)
class TrainingConfig:
    test_size: float = 0.2
    validation_size: float = 0.2
    random_state: int = 42
    max_iterations: int = 1000
    regularization: float = 1.0
    threshold_strategy: str = "f1"
    false_positive_cost: float = 1.0
    false_negative_cost: float = 10.0
    calibration_method: str = "sigmoid"
    calibration_folds: int = 3
    calibration_jobs: int = 1
    split_strategy: str = "stratified"
    time_column: str = "Time"
    bins: int = 10

    def __post_init__(self) -> None:
        _within("test_size", self.test_size, 0.05, 0.4)
        _within("validation_size", self.validation_size, 0.05, 0.4)
        if self.test_size + self.validation_size > 0.6 + 1e-12:
            raise ModelError("test_size and validation_size together must not exceed 0.6")
        if self.max_iterations < 100:
            raise ModelError("max_iterations must be at least 100")
        if not (math.isfinite(self.regularization) and self.regularization > 0):
            raise ModelError("regularization must be positive")
        for name, choices in (("threshold_strategy", ("f1", "cost")), ("calibration_method", ("none", "sigmoid", "isotonic")), ("split_strategy", ("stratified", "temporal"))):
            if getattr(self, name) not in choices:
                raise ModelError(f"{name} must be one of {choices}")
        check_costs(self.false_positive_cost, self.false_negative_cost)
        _within("calibration_folds", self.calibration_folds, 2, 10)
        if self.calibration_jobs != -1 and self.calibration_jobs < 1:
            raise ModelError("calibration_jobs must be -1 or at least 1")
        if not self.time_column.strip():
            raise ModelError("time_column must not be blank")
        _within("bins", self.bins, 2, 50)


def check_costs(false_positive: float, false_negative: float) -> None:
    if not all(math.isfinite(c) and c > 0 for c in (false_positive, false_negative)):
        raise ModelError("Costs must be finite and positive")


def check_threshold(threshold: float) -> None:
    if isinstance(threshold, bool) or not (isinstance(threshold, (int, float)) and 0 <= threshold <= 1):
        raise ModelError("The threshold must be a number between 0 and 1")
