"""Reference profiles of features, and drift against them by the population stability index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.contracts import DriftError, FeatureContract
from riskframe.functions import count_where, is_finite, local_table, number, quoted
from riskframe.operators.selection import order_statistics, sketch
from riskframe.operators.validate import bad_rows, check_scorable, match_schema

# Limits of the index, and the guard inside its logarithm.
WARNING, DRIFTED, EPSILON = 0.10, 0.25, 1e-6
PROFILE = "feature string, ordinal int, interior_edges array<double>, proportions array<double>, mean double, standard_deviation double"


def long_form(df: DataFrame, features: tuple[str, ...] | list[str]) -> DataFrame:
    """ordinal, feature, value: one row a feature and row."""
    pairs = F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(f).alias("feature"), number(f).alias("value")) for k, f in enumerate(features)))
    return df.select(F.inline(pairs))


def _quantile_ranks(n: int, bins: int) -> list[tuple[float, int, int]]:
    """Of each interior quantile: its place among n sorted values, and the ranks beside it."""
    places = [(n - 1) * q / bins for q in range(1, bins)]
    return [(h, math.floor(h), math.ceil(h)) for h in places]


def _selected(df: DataFrame, features: tuple[str, ...], bins: int, sketched: dict[str, tuple[int, bytearray]]) -> tuple[dict[str, list[float]], dict[str, list[int]]]:
    """Edges of each feature, and rows of each bin, from the values at the ranks beside the quantiles.

    No value lies between two such neighbours, so how many are below an edge follows from their counts.
    """
    ranks = {f: sorted({r for _, low, high in _quantile_ranks(n, bins) for r in (low, high)}) for f, (n, _) in sketched.items()}
    places = order_statistics(long_form(df, features), "feature", "value", ranks, sketched)
    edges, counts = {}, {}
    for f, (n, _) in sketched.items():
        below: dict[float, int] = {}
        for h, low, high in _quantile_ranks(n, bins):
            a, b = places[f, low], places[f, high]
            edge = a.value + (b.value - a.value) * (h - low)
            below[edge] = a.below if edge <= a.value else a.below + a.equal
        edges[f] = sorted(below)
        upto = [0, *(below[e] for e in edges[f]), n]
        counts[f] = [b - a for a, b in zip(upto, upto[1:], strict=False)]
    return edges, counts


def quantile_edges(df: DataFrame, features: tuple[str, ...], bins: int, method: str) -> dict[str, list[float]]:
    """Interior edges of each feature, ascending and distinct, by Spark's aggregates.

    ``method``: exact (one task holds the distinct values of all features: small tables) or approx.
    """
    points = [k / bins for k in range(1, bins)]
    pick = F.percentile if method == "exact" else F.percentile_approx
    row = df.agg(*(pick(number(f), points if method == "approx" else F.array(*map(F.lit, points))).alias(f"q{k}") for k, f in enumerate(features))).first()
    return {f: sorted(set(row[k])) for k, f in enumerate(features)}


def bin_of(value: Column, edges: Column) -> Column:
    """Number of edges at or below the value: bins are closed below, the outer ones open-ended."""
    return F.size(F.filter(edges, lambda e: e <= value))


def binned(df: DataFrame, edges: dict[str, list[float]], features: tuple[str, ...]) -> DataFrame:
    """feature, ordinal, bin, n: rows of each bin that has any; bin -1 has missing and infinite values."""
    known = F.create_map(*(x for f in features for x in (F.lit(f), F.array(*map(F.lit, edges[f])).cast("array<double>"))))
    placed = F.when(is_finite(F.col("value")), bin_of(F.col("value"), F.element_at(known, F.col("feature")))).otherwise(-1)
    return long_form(df, features).groupBy("feature", "ordinal", placed.alias("bin")).agg(F.count("*").alias("n"))


def build_profile(df: DataFrame, features: tuple[str, ...] | list[str], bins: int = 10, method: str = "selected") -> DataFrame:
    """A row a feature (see PROFILE). Means and deviations are of the population.

    Two passes over the rows: checks, moments and a quantile sketch a feature in one aggregation, then exact
    selection of the values beside the quantiles, which gives the edges and the rows of each bin (see
    :mod:`riskframe.operators.selection`; very large tables take a pass or two more).  ``exact`` and
    ``approx`` take the edges from Spark's percentile aggregates instead.
    """
    features = tuple(features)
    if not 2 <= bins <= 50:
        raise DriftError("bins must be between 2 and 50")
    if not features:
        raise DriftError("A profile needs at least one feature")
    contract = FeatureContract(features)
    match_schema(df.select(*(F.col(quoted(f)) for f in features)), contract, DriftError)
    own = [(F.avg(number(f)).alias(f"m{k}"), F.stddev_pop(number(f)).alias(f"s{k}"), *([sketch(number(f), "double").alias(f"q{k}")] if method == "selected" else [])) for k, f in enumerate(features)]
    moments = df.agg(*(m for parts in own for m in parts), F.count("*").alias("rows"), count_where(bad_rows(contract)).alias("bad")).first()
    if not moments["rows"]:
        raise DriftError("The table is empty")
    if moments["bad"]:
        raise DriftError(f"{moments['bad']} rows have missing or infinite values")
    if method == "selected":
        edges, counts = _selected(df, features, bins, {f: (moments["rows"], moments[f"q{k}"]) for k, f in enumerate(features)})
    else:
        edges = quantile_edges(df, features, bins, method)
        counts = {f: [0] * (len(edges[f]) + 1) for f in features}
        for r in binned(df, edges, features).collect():
            counts[r.feature][r.bin] = r.n
    rows = []
    for k, f in enumerate(features):
        mean, deviation = moments[f"m{k}"], moments[f"s{k}"]
        if not all(math.isfinite(x) for x in (*edges[f], mean, deviation)):
            raise DriftError(f"The profile of {f!r} overflows: values are too large")
        rows.append((f, k, edges[f], [n / moments["rows"] for n in counts[f]], mean, deviation))
    return local_table(df.sparkSession, rows, PROFILE)


def profile_bins(profile: DataFrame) -> DataFrame:
    """feature, ordinal, bin, lower, upper, expected: a profile in long form; null bounds are open."""
    lower = F.when(F.col("bin") > 0, F.try_element_at("interior_edges", F.greatest(F.col("bin"), F.lit(1))))
    upper = F.try_element_at("interior_edges", F.col("bin") + 1)
    spread = profile.select("feature", "ordinal", "interior_edges", F.posexplode("proportions").alias("bin", "expected"))
    return spread.select("feature", "ordinal", "bin", lower.alias("lower"), upper.alias("upper"), "expected")


def profile_faults(profile: DataFrame) -> DataFrame:
    """feature, fault (null where the row is valid)."""
    edges, shares = F.col("interior_edges"), F.col("proportions")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(edges) - 1, F.lit(1))), lambda k: (F.size(edges) < 2) | (F.try_element_at(edges, k) < F.try_element_at(edges, k + 1)))
    whole = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    fault = (
        F.when(F.col("feature").isNull() | (F.trim("feature") == ""), "feature name is empty")
        .when(edges.isNull() | ~F.forall(edges, finite), "edges must be finite")
        .when(~rising, "edges must increase")
        .when(shares.isNull() | (F.size(shares) != F.size(edges) + 1), "proportions do not fit the edges")
        .when(~F.forall(shares, lambda x: finite(x) & (x >= 0)), "proportions must be finite and not negative")
        .when(F.abs(whole - 1) > 1e-8 + 1e-5, "proportions must sum to 1")
    )
    return profile.select("feature", fault.alias("fault"))


def status_of(psi: Column) -> Column:
    return F.when(psi < WARNING, "stable").when(psi < DRIFTED, "warning").otherwise("drifted")


def psi_by_feature(expected: DataFrame, counts: DataFrame) -> DataFrame:
    """feature, ordinal, psi, status. expected: see profile_bins; counts: see binned."""
    totals = counts.groupBy("feature").agg(F.sum("n").alias("rows"))
    both = expected.join(counts.select("feature", "bin", "n"), ["feature", "bin"], "left").join(totals, "feature")
    actual = F.coalesce("n", F.lit(0)) / F.col("rows")
    term = (actual - F.col("expected")) * F.ln((actual + EPSILON) / (F.col("expected") + EPSILON))
    psi = F.greatest(F.lit(0.0), F.sum(term))
    return both.groupBy("feature", "ordinal").agg(psi.alias("psi")).withColumn("status", status_of(F.col("psi")))


def assess_drift(profile: DataFrame, df: DataFrame, ignore: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(features by descending psi, ties in profile order; one-row summary)."""
    rows = profile.orderBy("ordinal").collect()
    if not rows:
        raise DriftError("The reference profile is empty")
    bad = [r for r in profile_faults(profile.orderBy("ordinal")).collect() if r.fault]
    if bad:
        raise DriftError(f"The reference profile is malformed: {bad[0].feature}: {bad[0].fault}")
    features = tuple(r.feature for r in rows)
    own, contract = df.drop(*ignore), FeatureContract(features)
    match_schema(own, contract, DriftError)
    # one pass: at most bins times features rows, which all that follows is made of
    found = binned(own, {r.feature: r.interior_edges for r in rows}, features).collect()
    if not found or any(r.bin < 0 for r in found):
        check_scorable(own, contract, DriftError)
    counts = local_table(df.sparkSession, [tuple(r) for r in found], "feature string, ordinal int, bin int, n long")
    detail = psi_by_feature(profile_bins(profile), counts)
    return detail.orderBy(F.col("psi").desc(), "ordinal"), drift_summary(detail, counts)


def drift_summary(detail: DataFrame, counts: DataFrame) -> DataFrame:
    """n_rows, mean_psi, max_psi, status."""
    whole = detail.agg(F.avg("psi").alias("mean_psi"), F.max("psi").alias("max_psi"))
    rows = counts.groupBy("feature").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n_rows"))
    return rows.join(F.broadcast(whole)).select("n_rows", "mean_psi", "max_psi", status_of(F.col("max_psi")).alias("status"))
