"""Calibrators: the optimum, models that are not fitted twice, margins that are not made for each knot."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.contracts import FeatureContract, TrainingConfig
from riskframe.operators import fit, knots


@pytest.mark.parametrize("kind", ["mixed", "apart", "constant", "large", "one label"])
def test_platt_is_the_optimum(spark, kind):
    rng = np.random.default_rng(7)
    y = (rng.random(400) < (0 if kind == "one label" else 0.3)).astype(int)
    f = {"apart": 4.0 * y - 2, "constant": np.full(400, 3.0), "large": 1e6 * (rng.normal(size=400) + y)}.get(kind, rng.normal(size=400) + y)
    slope, intercept = fit.platt(spark.createDataFrame([(float(a), int(b)) for a, b in zip(f, y, strict=True)], "f double, y int"))
    ones = y.sum()
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (400 - ones + 2))
    gap = 1 / (1 + np.exp(slope * f + intercept)) - t
    assert abs(gap.mean()) < 1e-9 and abs((gap * (f - f.mean())).mean()) < 1e-9 * max(1.0, f.std())


def test_other_calibrators_of_fitted_models(spark):
    rows = spark.range(600).select("id", (F.rand(3) * 9 + F.col("id") % 2).alias("a"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3 + 1).cast("int").alias("fold")).localCheckpoint()
    contract = FeatureContract(("a",), "y", ("id",))
    config = lambda method: TrainingConfig(calibration_method=method)
    sigmoid, isotonic = (fit.fit_folds(rows, contract, config(method)) for method in ("sigmoid", "isotonic"))
    again = fit.fit_folds(rows, contract, config("isotonic"), sigmoid)
    assert [m.coefficients for m in again] == [m.coefficients for m in sigmoid]
    for a, b in zip(again, isotonic, strict=True):
        assert a.calibrator.values == pytest.approx(b.calibrator.values) and a.calibrator.boundaries == pytest.approx(b.calibrator.boundaries)


@pytest.mark.parametrize("n", [3, 400])
def test_a_margin_is_made_once_for_all_knots(spark, n):
    b = tuple(float(k) for k in range(n))
    df = spark.range(40).select((F.col("id") * 11.7 - 3).alias("a"))
    out = df.select((F.col("a") * 0.71828).alias("x"), knots.interpolated(F.col("a") * 0.71828, b, tuple(v * v for v in b)).alias("p"))
    assert out._jdf.queryExecution().analyzed().toString().splitlines()[0].count("0.71828") == 2
    for r in out.collect():
        assert r.p == pytest.approx(np.interp(r.x, b, [v * v for v in b]))
