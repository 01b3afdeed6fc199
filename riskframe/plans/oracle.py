"""DuckDB SQL with the same rows as the registered queries."""

from __future__ import annotations

from riskframe.plans.checks import check_sql
from riskframe.plans.outputs import output_sql
from riskframe.plans.proofs import proof_sql
from riskframe.plans.queries import DRIFT_FEATURES, FEATURES, FOLDS, K_MODEL

T = """t AS (SELECT event_id, ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(user_id AS DOUBLE) AS user_id,
    CAST(hour(ts) AS DOUBLE) AS hour, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events)"""
M = "m AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_extendedprice / 105000 AS score FROM lineitem)"
TIES = M.replace("l_extendedprice / 105000", "l_quantity / 50")
GROUPS = """g AS (SELECT score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM m GROUP BY score),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g
    WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""
_SHUFFLED = f"""{T}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42#' || event_id), event_id) AS place, count(*) OVER (PARTITION BY label) AS size FROM t),
z AS (SELECT *, round_even(size * 0.2, 0) AS a FROM r),
s AS (SELECT event_id, label, CASE WHEN place <= a THEN 'test' WHEN place <= a + round_even((size - a) * (0.2 / (1 - 0.2)), 0) THEN 'validation' ELSE 'train' END AS split FROM z)"""


def _margin(fold, features) -> str:
    return f"({fold.intercept} + " + " + ".join(f"({c}) * (({f}) - {m}) / {s}" for f, m, s, c in zip(features, fold.means, fold.scales, fold.coefficients, strict=True)) + ")"


_P = f"((1 / (1 + exp({FOLDS[0].calibrator.slope} * {_margin(FOLDS[0], FEATURES)} + {FOLDS[0].calibrator.intercept}))) + 1 / (1 + exp(-{_margin(FOLDS[1], FEATURES)}))) / 2"
_CONFUSION = """SELECT count(*) FILTER (label = 0 AND score < 0.5) AS true_negatives, count(*) FILTER (label = 0 AND score >= 0.5) AS false_positives,
    count(*) FILTER (label = 1 AND score < 0.5) AS false_negatives, count(*) FILTER (label = 1 AND score >= 0.5) AS true_positives FROM m"""
_EVALUATE = f"""{GROUPS}, q AS ({_CONFUSION}),
a AS (SELECT sum(neg * (tp - pos / 2)) / (max(p) * max(n)) AS roc_auc, sum(pos * (tp / (tp + fp))) / max(p) AS average_precision FROM c),
b AS (SELECT avg(pow(score - label, 2)) AS brier_score FROM m)
SELECT CAST(0.5 AS DOUBLE) AS threshold, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision, round(brier_score, 9) AS brier_score,
    round(true_positives / (true_positives + false_positives), 9) AS precision, round(true_positives / (true_positives + false_negatives), 9) AS recall,
    round(2 * true_positives / (2 * true_positives + false_positives + false_negatives), 9) AS f1,
    round((true_positives / (true_positives + false_negatives) + true_negatives / (true_negatives + false_positives)) / 2, 9) AS balanced_accuracy,
    true_negatives, false_positives, false_negatives, true_positives FROM q, a, b"""
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, {k} AS ordinal, CAST({f} AS DOUBLE) AS value, l_shipdate < TIMESTAMP '1995-06-17' AS early FROM lineitem" for k, f in enumerate(DRIFT_FEATURES))
_PROFILE = f"""v AS ({_LONG}),
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM v WHERE early GROUP BY feature),
h AS (SELECT v.feature, early, len(list_filter(edges, lambda x: x <= value)) AS bin, count(*) AS n FROM v JOIN e ON v.feature = e.feature GROUP BY ALL),
bins AS (SELECT e.feature, (SELECT min(ordinal) FROM v WHERE v.feature = e.feature) AS ordinal, b.bin, CASE WHEN b.bin > 0 THEN edges[b.bin] END AS lower, edges[b.bin + 1] AS upper,
    coalesce(h.n, 0) / sum(h.n) OVER (PARTITION BY e.feature) AS expected
    FROM e JOIN range(10) AS b(bin) ON b.bin <= len(edges) LEFT JOIN h ON h.feature = e.feature AND h.bin = b.bin AND h.early)"""
_DRIFT = f"""{_PROFILE}, late AS (SELECT feature, bin, n, sum(n) OVER (PARTITION BY feature) AS rows FROM h WHERE NOT early),
x AS (SELECT bins.feature, ordinal, coalesce(n, 0) / (SELECT max(rows) FROM late l WHERE l.feature = bins.feature) AS actual, expected FROM bins LEFT JOIN late ON late.feature = bins.feature AND late.bin = bins.bin),
d AS (SELECT feature, CAST(ordinal AS INTEGER) AS ordinal, greatest(0, sum((actual - expected) * ln((actual + 1e-6) / (expected + 1e-6)))) AS psi FROM x GROUP BY feature, ordinal)"""
_STATUS = "CASE WHEN {0} < 0.1 THEN 'stable' WHEN {0} < 0.25 THEN 'warning' ELSE 'drifted' END AS status"
_FOLDS = f"{T}, f AS (SELECT *, ntile(3) OVER (PARTITION BY label ORDER BY ts, event_id) AS fold FROM t)"
_EFFECTS = f"""{_FOLDS}, k AS ({" UNION ALL ".join(f"SELECT fold, {k} AS ordinal, '{f}' AS feature, corr({f}, label) AS coefficient FROM f GROUP BY fold" for k, f in enumerate(FEATURES))}),
w AS (SELECT ordinal, feature, avg(coefficient) AS c FROM k GROUP BY ordinal, feature),
x AS (SELECT CAST(row_number() OVER (ORDER BY abs(c) DESC, ordinal) AS INTEGER) AS rank, feature, round(c, 9) AS coefficient, round(abs(c), 9) AS absolute_effect,
    CASE WHEN c >= 0 THEN 'higher_fraud_risk' ELSE 'lower_fraud_risk' END AS direction FROM w) SELECT * FROM x"""

ORACLE_SQL = {
    "validation_report": f"WITH {T} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (isnan(CAST({c} AS DOUBLE))) AS n_nan, count(*) FILTER (isinf(CAST({c} AS DOUBLE))) AS n_inf FROM t" for c in (*FEATURES, "label")
    ),
    "schema_diff": """WITH x AS (SELECT json_keys(props) AS ks FROM events),
        y AS (SELECT 'missing' AS side, unnest(list_filter(['k', 'v'], lambda f: NOT list_contains(ks, f))) AS feature FROM x
        UNION ALL SELECT 'unexpected', unnest(list_filter(ks, lambda f: f NOT IN ('k', 'v'))) FROM x) SELECT side, feature, count(*) AS n_rows FROM y GROUP BY side, feature""",
    "dataset_summary": f"WITH {T} SELECT count(*) AS n_rows, count(*) FILTER (label = 1) AS n_positive, round(avg(label), 9) AS positive_rate, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS n_minority FROM t",
    "split_stratified_rows": f"WITH {_SHUFFLED} SELECT event_id, split FROM s",
    "split_stratified_counts": f"WITH {_SHUFFLED} SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_positive FROM s GROUP BY split",
    "split_temporal_ranges": f"""WITH {T}, r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS place, count(*) OVER () AS size, greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS part FROM t),
        s AS (SELECT *, CASE WHEN place <= size - 2 * part THEN 'train' WHEN place <= size - part THEN 'validation' ELSE 'test' END AS split FROM r)
        SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_positive, min(ts) AS t_min, max(ts) AS t_max FROM s GROUP BY split""",
    "capacity_check": "SELECT toxic AS label, count(*) AS n, count(*) >= 6 AND count(*) * 0.05 >= 1 AND count(*) * 0.05 >= 1 AS enough FROM labels JOIN documents USING (doc_id) GROUP BY toxic",
    "fold_assignment": f"WITH {_FOLDS} SELECT event_id, CAST(fold AS INTEGER) AS fold FROM f",
    "standardize": f"WITH {T} SELECT event_id, " + ", ".join(f"round(({f} - (SELECT avg({f}) FROM t)) / (SELECT stddev_pop({f}) FROM t), 6) AS z_{f}" for f in FEATURES) + " FROM t",
    "class_weights": f"WITH {T} SELECT CAST(label AS INTEGER) AS label, count(*) AS n, round((SELECT count(*) FROM t) / (2 * count(*)), 9) AS weight FROM t GROUP BY label",
    "score_fixed_model": f"WITH {T}, s AS (SELECT event_id, {_P} AS p FROM t) SELECT event_id, round(p, 6) AS fraud_probability, CAST(p >= 0.25 AS TINYINT) AS is_fraud FROM s",
    "score_summary": f"WITH {T}, s AS (SELECT {_P} AS p FROM t) SELECT count(*) AS n_rows, count(*) FILTER (p >= 0.25) AS n_flagged FROM s",
    "confusion": f"WITH {M} {_CONFUSION}",
    "evaluate_metrics": f"WITH {M}, {_EVALUATE}",
    "evaluate_metrics_ties": f"WITH {TIES}, {_EVALUATE}",
    "pr_curve": f"WITH {M}, {GROUPS} SELECT round(threshold, 9) AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM c",
    "roc_curve": f"WITH {M}, {GROUPS} SELECT round(threshold, 9) AS threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM c",
    "threshold_f1": f"WITH {M}, {GROUPS} SELECT round(threshold, 9) AS threshold, round(2 * tp / (tp + fp + p), 9) AS f1 FROM c ORDER BY 2 * tp / (tp + fp + p) DESC, c.threshold LIMIT 1",
    "threshold_cost": f"""WITH {TIES}, {GROUPS}, k AS (SELECT *, (fp * 1.0 + (p - tp) * 3.0) / (p + n) AS cost FROM c), l AS (SELECT min(cost) AS least, max(threshold) AS top, max(p) * 3.0 / (max(p) + max(n)) AS nothing FROM k),
        b AS (SELECT threshold, cost FROM k, l WHERE abs(cost - least) <= 1e-8 + 1e-5 * abs(least) ORDER BY tp DESC, threshold DESC LIMIT 1)
        SELECT round(CASE WHEN top < 1 AND nothing < least THEN 1.0 ELSE threshold END, 9) AS threshold, round(CASE WHEN top < 1 AND nothing < least THEN nothing ELSE cost END, 9) AS expected_cost FROM b, l""",
    "expected_cost": f"WITH {M}, q AS ({_CONFUSION}) SELECT round((false_positives * 1.0 + false_negatives * 10.0) / (true_negatives + false_positives + false_negatives + true_positives), 9) AS expected_cost FROM q",
    "reference_profile": f"WITH {_PROFILE} SELECT v.feature, CAST(ordinal AS INTEGER) AS ordinal, CAST(len(edges) AS INTEGER) AS n_edges, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS standard_deviation FROM v JOIN e ON v.feature = e.feature WHERE early GROUP BY v.feature, ordinal, edges",
    "profile_bins": f"WITH {_PROFILE} SELECT feature, CAST(ordinal AS INTEGER) AS ordinal, CAST(bin AS INTEGER) AS bin, round(lower, 9) AS lower, round(upper, 9) AS upper, round(expected, 9) AS expected FROM bins",
    "drift_features": f"WITH {_DRIFT} SELECT feature, ordinal, round(psi, 9) AS psi, {_STATUS.format('psi')} FROM d",
    "drift_summary": f"WITH {_DRIFT} SELECT (SELECT CAST(max(rows) AS BIGINT) FROM late) AS n_rows, round(avg(psi), 9) AS mean_psi, round(max(psi), 9) AS max_psi, {_STATUS.format('max(psi)')} FROM d",
    "profile_validity": """WITH s AS (SELECT l_returnflag || '-' || l_linestatus AS feature, l_quantity > 25 AS high, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT feature, CASE WHEN count(*) <> 2 THEN 'proportions do not fit the edges' END AS fault FROM s GROUP BY feature""",
    "feature_effects": f"WITH {_EFFECTS}",
    "feature_effects_top": f"WITH {_EFFECTS} WHERE rank <= 2",
    "score_requests": f"""WITH q AS (SELECT event_id, event_type, {1} / (1 + exp(-{_margin(K_MODEL[0], ["CAST(json_extract_string(props, '$.k') AS DOUBLE)"])})) AS p FROM events WHERE event_type IN ('click', 'view'))
        SELECT event_id, CASE event_type WHEN 'view' THEN 2 ELSE 1 END AS n_predictions, round(p, 6) AS fraud_probability, p >= 0.5 AS is_fraud FROM q""",
    "request_rejects": """SELECT CASE event_type WHEN 'error' THEN 'unknown field' WHEN 'signup' THEN 'feature schema mismatch' ELSE 'body is not valid' END AS reason, count(*) AS n_requests
        FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1""",
    "stream_score_requests": """SELECT CASE event_type WHEN 'error' THEN 'unknown field' WHEN 'signup' THEN 'feature schema mismatch' WHEN 'click' THEN NULL WHEN 'view' THEN NULL ELSE 'body is not valid' END AS reason,
        count(*) AS n_requests, count(*) FILTER (event_type IN ('click', 'view')) AS n_responses FROM events GROUP BY 1""",
    "csv_roundtrip": "SELECT * FROM orders",
}
ORACLE_SQL["profile_bins_sorted"] = ORACLE_SQL["profile_bins"]
ORACLE_SQL["manifest_check"] = "SELECT CAST(2 AS BIGINT) AS n_files, CAST(0 AS BIGINT) AS n_differences"
ORACLE_SQL |= check_sql(ORACLE_SQL, T)
ORACLE_SQL |= output_sql(ORACLE_SQL, T, _PROFILE, _LONG.replace(" AS value,", " AS value, l_shipdate,"))
ORACLE_SQL |= proof_sql(_SHUFFLED, _P)
