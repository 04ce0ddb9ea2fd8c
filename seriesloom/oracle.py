"""DuckDB SQL for the queries in `catalog`, over the same Parquet tables.

Adding 0 turns the negative zeros that DuckDB's round leaves into zeros, as Spark's gives."""

from __future__ import annotations

READ = """
r AS (SELECT event_type AS accident_type, user_id::VARCHAR AS severity_id, (epoch_us(ts) - 1577836800000000) / 1e6 AS time_seconds, event_id, value,
             (row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1)::INTEGER AS row_idx,
             count(*) OVER (PARTITION BY event_type, user_id) AS n_rows FROM events)"""
DURATION = READ + """,
d AS (SELECT accident_type, severity_id, count(*) AS n_rows, arg_max(time_seconds, row_idx) AS duration_seconds FROM r GROUP BY ALL)"""


def _win(size: int = 5, stride: int = 3, source: str = "r") -> str:
    f = f"OVER (PARTITION BY accident_type, severity_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)"
    return f""",
w AS (SELECT accident_type, severity_id, time_seconds AS window_start_seconds, e AS window_end_seconds, m AS value_mean, s AS value_std, coalesce(b, 0) AS value_slope
      FROM (SELECT *, last(time_seconds) {f} AS e, avg(value) {f} AS m, stddev_pop(value) {f} AS s, regr_slope(value, time_seconds) {f} AS b FROM {source})
      WHERE row_idx % {stride} = 0 AND row_idx + {size} <= n_rows)"""


WINDOWS = READ + _win()
NUMBER = "try_cast(severity_id AS DOUBLE)"
SEVERITY = f"{NUMBER} IS NULL, {NUMBER}, severity_id"
SPLIT = f""",
k AS (SELECT accident_type, severity_id, row_number() OVER (PARTITION BY accident_type ORDER BY {SEVERITY}) AS i, count(*) OVER (PARTITION BY accident_type) AS n
      FROM (SELECT DISTINCT accident_type, severity_id FROM %s)),
sp AS (SELECT accident_type, severity_id, CASE WHEN i %% 5 = 0 OR (n < 5 AND i = n) THEN 'test' ELSE 'train' END AS split FROM k WHERE n >= 2)"""
LABELS = "l AS (SELECT event_type AS accident_type, (row_number() OVER (ORDER BY event_type) - 1)::INTEGER AS label_idx FROM (SELECT DISTINCT event_type FROM events))"
MATRIX = LABELS + """,
j AS (SELECT l.label_idx AS true_idx, (floor(value / 10)::BIGINT % (SELECT count(*) FROM l))::INTEGER AS pred_idx FROM events JOIN l ON event_type = accident_type),
m AS (SELECT a.label_idx AS true_idx, b.label_idx AS pred_idx, (SELECT count(*) FROM j WHERE j.true_idx = a.label_idx AND j.pred_idx = b.label_idx) AS n FROM l a CROSS JOIN l b)"""
CLASSES = MATRIX + """,
t AS (SELECT l.accident_type, l.label_idx, (SELECT sum(n) FROM m WHERE true_idx = label_idx)::BIGINT AS support, (SELECT sum(n) FROM m WHERE pred_idx = label_idx)::BIGINT AS predicted,
             (SELECT sum(n) FROM m WHERE true_idx = label_idx AND pred_idx = label_idx)::BIGINT AS hits FROM l),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0::DOUBLE END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0.0::DOUBLE END AS rc FROM t),
c AS (SELECT accident_type, label_idx, p AS precision, rc AS recall, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0::DOUBLE END AS f1, support FROM pr)"""
SEQ = READ + """,
q AS (SELECT accident_type, severity_id, s.step::INTEGER AS step, first(value ORDER BY row_idx DESC) AS value
      FROM r, (SELECT unnest(range(10)) AS step) s WHERE row_idx <= s.step GROUP BY ALL)"""
XS = ",".join(f"x{i}" for i in range(64))
VECTORS = "v AS (SELECT vec_id, label::INTEGER AS label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(64)) + " FROM embeddings)"
LONG = VECTORS + ",\nf AS (" + " UNION ALL ".join(f"SELECT vec_id, label, {i} AS feature, x{i} AS value FROM v" for i in range(64)) + ")"
SOFTMAX = VECTORS + ",\nx AS (SELECT *, greatest(" + XS + ") AS top FROM v),\ns AS (SELECT vec_id, label, top, " + XS + ", exp(x0-top) AS e0, " + " + ".join(f"exp(x{i}-top)" for i in range(64)) + " AS z FROM x)"
SCORES = SOFTMAX + ",\nsc AS (SELECT vec_id, label >= 8 AS is_ood, round(1 / z, 4) AS score FROM s)"
THRESHOLD = "(SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM sc WHERE NOT is_ood) WHERE i = least(floor(n * 0.05), n - 1))"
SSE = """
g AS (SELECT label % 2 AS node, feature, value, count(*) AS n, sum(label::DOUBLE) AS s, sum(label::DOUBLE * label) AS q FROM f GROUP BY ALL),
h AS (SELECT node, feature, value, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(q) OVER w AS lq, sum(n) OVER a AS tn, sum(s) OVER a AS ts, sum(q) OVER a AS tq FROM g
      WINDOW w AS (PARTITION BY node, feature ORDER BY value), a AS (PARTITION BY node, feature)),
i AS (SELECT node, feature, value AS threshold, (tq - ts * ts / tn) - ((lq - ls * ls / ln) + (tq - lq - (ts - ls) * (ts - ls) / (tn - ln))) AS reduction FROM h WHERE ln >= 5 AND tn - ln >= 5)"""
_sq = lambda p, n: " + ".join(f"({p.format(k=k)} / {n}) * ({p.format(k=k)} / {n})" for k in range(10))
GINI = (
    "\ng AS (SELECT label % 2 AS node, feature, value, " + ", ".join(f"count(*) FILTER (label = {k}) AS c{k}" for k in range(10)) + " FROM f GROUP BY ALL),"
    "\nh AS (SELECT node, feature, value, " + ", ".join(f"sum(c{k}) OVER w AS l{k}, sum(c{k}) OVER a AS t{k}" for k in range(10)) + " FROM g WINDOW w AS (PARTITION BY node, feature ORDER BY value), a AS (PARTITION BY node, feature)),"
    "\nh2 AS (SELECT *, (" + " + ".join(f"l{k}" for k in range(10)) + ")::DOUBLE AS ln, (" + " + ".join(f"t{k}" for k in range(10)) + ")::DOUBLE AS tn FROM h),"
    "\ni AS (SELECT node, feature, value AS threshold, (1 - (" + _sq("t{k}", "tn") + ")) - ((1 - (" + _sq("l{k}", "ln") + ")) * (ln / tn) + (1 - (" + _sq("(t{k} - l{k})", "(tn - ln)") + ")) * ((tn - ln) / tn)) AS reduction FROM h2 WHERE ln >= 5 AND tn - ln >= 5)"
)
BEST = "SELECT node::INTEGER AS node, feature::INTEGER AS feature, round(threshold, 6) AS threshold, round(reduction, 6) AS reduction FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(reduction, 9) DESC, feature, threshold) AS i FROM i WHERE reduction > 1e-12) WHERE i = 1"
BAYES = LONG + """,
ex AS (SELECT max(va) * 1e-9 AS extra FROM (SELECT var_pop(value) AS va FROM f GROUP BY feature)),
p AS (SELECT label, feature, count(*) / (SELECT count(*) FROM v) AS prior, avg(value) AS mean, var_pop(value) + (SELECT extra FROM ex) AS var FROM f GROUP BY label, feature)"""
MULTI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_over = "OVER (PARTITION BY accident_type, severity_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)"

ORACLE = {
    "run_duration": f"WITH {DURATION} SELECT accident_type, severity_id, n_rows, round(duration_seconds, 6) AS duration_seconds FROM d",
    "eda_summary": f"WITH {DURATION} SELECT accident_type, count(*) AS sample_count, round(min(duration_seconds), 6) AS min_duration_seconds, round(avg(duration_seconds), 6) AS mean_duration_seconds, round(max(duration_seconds), 6) AS max_duration_seconds FROM d GROUP BY 1",
    "class_balance": "SELECT event_type AS accident_type, count(DISTINCT user_id) AS n_runs, count(*) AS n_rows FROM events GROUP BY 1",
    "accident_types": "SELECT DISTINCT event_type AS accident_type FROM events",
    "rolling_features": f"WITH {WINDOWS} SELECT accident_type, severity_id, round(window_start_seconds, 6) AS window_start_seconds, round(window_end_seconds, 6) AS window_end_seconds, round(value_mean, 6) AS value_mean, round(value_std, 6) AS value_std, round(value_slope, 6) + 0::DOUBLE AS value_slope FROM w",
    "rolling_midpoint": f"WITH {WINDOWS} SELECT accident_type, severity_id, round((window_start_seconds + window_end_seconds) / 2, 3) AS midpoint_seconds, round(value_mean, 6) AS value_mean FROM w",
    "multi_sensor_features": "WITH a AS (SELECT *, l_returnflag AS accident_type, l_suppkey::VARCHAR AS severity_id, (epoch_us(l_shipdate) - 1577836800000000) / 1e6 AS time_seconds FROM lineitem), r AS (SELECT *, (row_number() OVER o - 1)::INTEGER AS row_idx, count(*) OVER (PARTITION BY accident_type, severity_id) AS n_rows FROM a WINDOW o AS (PARTITION BY accident_type, severity_id ORDER BY time_seconds, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax)), z AS (SELECT accident_type, severity_id, row_idx, n_rows, time_seconds AS window_start_seconds, last(time_seconds) " + _over + " AS window_end_seconds, " + ", ".join(f"avg({s}) {_over} AS {s}_mean, stddev_pop({s}) {_over} AS {s}_std, coalesce(regr_slope({s}, time_seconds) {_over}, 0) AS {s}_slope" for s in MULTI) + " FROM r) SELECT accident_type, severity_id, round(window_start_seconds, 6) AS window_start_seconds, round(window_end_seconds, 6) AS window_end_seconds, " + ", ".join(f"round({s}_{k}, 6) + 0::DOUBLE AS {s}_{k}" for s in MULTI for k in ("mean", "std", "slope")) + " FROM z WHERE row_idx % 3 = 0 AND row_idx + 5 <= n_rows",
    "windows_per_type": f"WITH {WINDOWS} SELECT t.accident_type, count(w.accident_type) AS n_windows FROM (SELECT DISTINCT accident_type FROM r) t LEFT JOIN w USING (accident_type) GROUP BY 1",
    "zero_window_types": f"WITH {READ + _win(25)} SELECT DISTINCT accident_type FROM r WHERE accident_type NOT IN (SELECT accident_type FROM w)",
    "run_split": f"WITH {READ + SPLIT % 'r'} SELECT accident_type, severity_id, split FROM sp",
    "single_run_types": f"WITH {READ} SELECT accident_type FROM r GROUP BY 1 HAVING count(DISTINCT severity_id) < 2",
    "routed_windows": f"WITH {WINDOWS + SPLIT % 'r'} SELECT accident_type, CASE WHEN split = 'train' OR accident_type IN (SELECT accident_type FROM k WHERE n < 2) THEN 'train' ELSE 'test' END AS split, count(*) AS n_windows FROM w LEFT JOIN sp USING (accident_type, severity_id) GROUP BY ALL",
    "subsample_train": f"WITH {WINDOWS}, o AS (SELECT *, row_number() OVER (PARTITION BY accident_type ORDER BY {SEVERITY}, window_start_seconds) - 1 AS k, count(*) OVER (PARTITION BY accident_type) AS n FROM w) SELECT accident_type, severity_id, round(window_start_seconds, 6) AS window_start_seconds FROM o WHERE n <= 100 OR k IN (SELECT floor(i * (n - 1) / 99) FROM (SELECT unnest(range(100)) AS i))",
    "label_index": f"WITH {LABELS} SELECT accident_type, label_idx FROM l",
    "confusion_matrix": f"WITH {MATRIX} SELECT true_idx, pred_idx, n FROM m",
    "confusion_row_norm": f"WITH {MATRIX} SELECT true_idx, pred_idx, round(CASE WHEN sum(n) OVER (PARTITION BY true_idx) > 0 THEN n / sum(n) OVER (PARTITION BY true_idx) ELSE 0 END, 6)::DOUBLE AS share FROM m",
    "per_class_metrics": f"WITH {CLASSES} SELECT accident_type, label_idx, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM c",
    "macro_f1": f"WITH {CLASSES} SELECT round((SELECT sum(n) FILTER (true_idx = pred_idx) / sum(n) FROM m), 6)::DOUBLE AS accuracy, round((SELECT avg(f1) FROM c WHERE support > 0), 6) AS macro_f1",
    "fixed_length_sequences": f"WITH {SEQ} SELECT accident_type, severity_id, step, round(value, 6) AS value FROM q",
    "normalization_stats": f"WITH {SEQ} SELECT 0 AS sensor, round(avg(value), 6) AS mean, round(greatest(stddev_pop(value), 1e-8), 6) AS std FROM q",
    "zscored_sequences": f"WITH {SEQ} SELECT accident_type, severity_id, step, round((value - (SELECT avg(value) FROM q)) / (SELECT greatest(stddev_pop(value), 1e-8) FROM q), 6) + 0::DOUBLE AS value FROM q",
    "longest_run": f"WITH {DURATION} SELECT accident_type, severity_id, n_rows, round(duration_seconds, 6) AS duration_seconds FROM (SELECT *, row_number() OVER (PARTITION BY accident_type ORDER BY duration_seconds DESC, {SEVERITY}) AS i FROM d) WHERE i = 1",
    "first_runs": f"WITH {DURATION} SELECT accident_type, severity_id, n_rows, round(duration_seconds, 6) AS duration_seconds FROM (SELECT *, row_number() OVER (PARTITION BY accident_type ORDER BY {SEVERITY}) AS i FROM d WHERE accident_type IN ('view', 'click', 'absent')) WHERE i = 1",
    "relative_power": f"WITH {READ}, o AS (SELECT *, first(value) OVER (PARTITION BY accident_type, severity_id ORDER BY row_idx) AS v0 FROM r) SELECT accident_type, severity_id, row_idx, round(value / nullif(v0, 0), 6) AS relative FROM o WHERE time_seconds <= 127500000",
    "downsample": f"WITH {READ} SELECT accident_type, severity_id, row_idx, round(value, 6) AS value FROM r WHERE row_idx % 4 = 0",
    "ramp_reactivity": "SELECT event_id, round(CASE WHEN value < 10 THEN 0 WHEN value >= 25 THEN 0.003::DOUBLE ELSE 0.003::DOUBLE * (value - 10) / 15 END, 6) AS rho FROM events",
    "histogram_bins": "WITH b AS (SELECT unnest(range((SELECT ceil(max(value) / 25) + 1 FROM events)::BIGINT))::INTEGER AS bin) SELECT b.bin, b.bin * 25.0::DOUBLE AS bin_start, count(e.value) AS n_values FROM b LEFT JOIN events e ON floor(e.value / 25) = b.bin GROUP BY ALL",
    "axis_extents": f"WITH {READ} SELECT round(min(time_seconds), 6) AS x_min, round(max(time_seconds), 6) AS x_max, round(min(value) - greatest(max(value) - min(value), 1) * 0.05::DOUBLE, 6) AS y_min, round(max(value) + greatest(max(value) - min(value), 1) * 0.05::DOUBLE, 6) AS y_max, round(max(value) * 1.1::DOUBLE, 6) AS bar_top FROM r",
    "heat_colors": "WITH a AS (SELECT event_id, least(greatest(value / 100 - 0.1::DOUBLE, 0), 1) AS f FROM events) SELECT event_id, '#' || " + " || ".join(f"lpad(lower(to_hex(round(255 + ({c} - 255) * f)::BIGINT)), 2, '0')" for c in (30, 60, 150)) + " AS color FROM a",
    "canonical_header": "SELECT props AS header, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, header LIMIT 1",
    "ecdf": "SELECT round(value, 6) AS value, round((row_number() OVER (ORDER BY value) - 1) / count(*) OVER (), 6) AS fraction FROM events",
    "best_split_sse": f"WITH {LONG}, {SSE} {BEST}",
    "best_split_gini": f"WITH {LONG}, {GINI} {BEST}",
    "node_impurity": f"WITH {VECTORS}, c AS (SELECT vec_id % 7 AS node, label, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT vec_id % 7 AS node, avg(label) AS mean, count(*) AS total FROM v GROUP BY ALL) SELECT node, round(1 - sum((n / total) * (n / total)), 6) AS gini, round(any_value(mean), 6) AS mean FROM c JOIN t USING (node) GROUP BY node",
    "softmax_scores": f"WITH {SOFTMAX} SELECT vec_id, round(1 / z, 6) AS max_probability, (list_position([{XS}], top) - 1)::INTEGER AS pred_idx, round(e0 / z, 6) AS p0 FROM s",
    "gaussian_nb_params": f"WITH {BAYES} SELECT label, feature::INTEGER AS feature, round(prior, 6) AS prior, round(mean, 6) + 0::DOUBLE AS mean, round(var, 6) AS var FROM p",
    "gaussian_nb_predict": f"WITH {BAYES}, s AS (SELECT vec_id, p.label, round(sum(-0.5 * ln(2 * pi() * var) - (value - mean) * (value - mean) / (2 * var)) + ln(any_value(prior)), 6) AS ll FROM f JOIN p ON f.feature = p.feature GROUP BY ALL) SELECT vec_id AS row_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC, label) AS i FROM s) WHERE i = 1",
    "ood_threshold": f"WITH {SCORES} SELECT {THRESHOLD} AS threshold",
    "ood_rates": f"WITH {SCORES} SELECT round({THRESHOLD}, 6) AS threshold, round(avg((score < {THRESHOLD})::INTEGER) FILTER (NOT is_ood), 6) AS false_alarm_rate, round(avg((score < {THRESHOLD})::INTEGER) FILTER (is_ood), 6) AS ood_detection_rate FROM sc",
    "ood_mean_scores": f"WITH {SCORES} SELECT round(avg(score) FILTER (NOT is_ood), 6) AS known_mean, round(avg(score) FILTER (is_ood), 6) AS ood_mean FROM sc",
    "auroc_rank": f"WITH {SCORES} SELECT round(sum(CASE WHEN o.score < k.score THEN 1.0 WHEN o.score = k.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auroc FROM (SELECT score FROM sc WHERE is_ood) o CROSS JOIN (SELECT score FROM sc WHERE NOT is_ood) k",
}
ORACLE["rolling_features_grouped"] = ORACLE["rolling_features"]
