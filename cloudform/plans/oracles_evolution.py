"""SQL for the queries over windows of years, profiles and distributions, for DuckDB over the same tables."""

from .oracles import COUNTS, V

METRICS = ("mean_distance", "median_distance", "iqr_distance", "p90_distance")
NAMES, VALUES = "[" + ", ".join(f"'{m}'" for m in METRICS) + "]", "[" + ", ".join(METRICS) + "]"


def cos(a: str, b: str) -> str:
    return f"(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def guarded(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


WIN = (
    V
    + f""", wc AS (SELECT l1, w, list(m ORDER BY d) AS c FROM (SELECT l1, w, d, avg(x) AS m FROM e GROUP BY ALL) GROUP BY ALL),
wd AS (SELECT v.l1, wc.w, {cos("u", "c")} AS d FROM v JOIN wc ON v.l1 = wc.l1 AND (v.year - 2000) // 5 = wc.w),
ws AS (SELECT l1, w, count(*) AS n, avg(d) AS mean_distance, quantile_cont(d, 0.5) AS median_distance, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS iqr_distance, quantile_cont(d, 0.9) AS p90_distance FROM wd GROUP BY ALL),
wm AS (SELECT l1, w::INT AS w, coalesce(n, 0) AS n, {", ".join(f"CASE WHEN n >= 3 THEN {m} END AS {m}" for m in METRICS)}
  FROM (SELECT l1, w FROM (SELECT DISTINCT l1 FROM v), (SELECT unnest(range(5)) AS w)) LEFT JOIN ws USING (l1, w)),
lg AS (SELECT l1, w, unnest({NAMES}) AS metric, unnest({VALUES}) AS value FROM wm),
sc AS (SELECT metric, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM lg GROUP BY 1),
lz AS (SELECT l1, w, metric, value, CASE WHEN abs(s) > 1e-12 THEN (value - m) / s END AS z, CASE WHEN abs(iqr) > 1e-12 THEN (value - q2) / iqr END AS rz FROM lg JOIN sc USING (metric)),
rk AS (SELECT *, 2002 + 5.0 * w AS mid, rank() OVER (PARTITION BY l1, metric ORDER BY value) + (count(*) OVER (PARTITION BY l1, metric, value) - 1) / 2 AS rv, rank() OVER (PARTITION BY l1, metric ORDER BY w) AS rt FROM lz WHERE value IS NOT NULL),
c0 AS (SELECT l1, metric, count(*) AS n_windows, max(value) FILTER (w = 0) AS first_value, max(value) FILTER (w = 4) AS last_value, max(z) FILTER (w = 4) - max(z) FILTER (w = 0) AS delta_z,
  CASE WHEN count(*) > 1 THEN regr_slope(value, mid) END AS slope, CASE WHEN count(*) > 1 THEN regr_slope(z, mid) END AS slope_z, {guarded("rv", "rt")} AS spearman FROM rk GROUP BY ALL),
ch AS (SELECT *, last_value - first_value AS delta, CASE WHEN delta_z IS NULL THEN 'unknown' WHEN abs(delta_z) < 0.25 THEN 'stable' WHEN delta_z > 0 THEN 'increase' ELSE 'decrease' END AS trend FROM c0)
"""
)
PATHS = (
    V
    + f""", wc AS (SELECT l1, w, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM (SELECT l1, w, list(m ORDER BY d) AS c FROM (SELECT l1, w, d, avg(x) AS m FROM e GROUP BY ALL) GROUP BY ALL)
  JOIN (SELECT l1, (year - 2000) // 5 AS w FROM v GROUP BY ALL HAVING count(*) >= 3) USING (l1, w)),
st AS (SELECT l1, w, c, lag(c) OVER (PARTITION BY l1 ORDER BY w) AS b FROM wc),
s2 AS (SELECT l1, w, c, {cos("c", "b")} AS step, list_distance(c, b) AS leg FROM st),
pa AS (SELECT l1, count(*) AS n_windows, sum(step) AS path, sum(leg) AS length, arg_max(w, step)::INT AS largest_step_window, max(step) AS largest_step, arg_min(c, w) AS a, arg_max(c, w) AS z FROM s2 GROUP BY l1),
pw AS (SELECT l1, n_windows, path, CASE WHEN n_windows > 1 THEN {cos("a", "z")} END AS drift, CASE WHEN n_windows > 1 AND length > 1e-12 THEN list_distance(a, z) / length END AS directness, largest_step_window, largest_step FROM pa)
"""
)
PROF = (
    V
    + f""", p AS (SELECT level, entity, {", ".join(f"avg({m}) AS {m}" for m in METRICS)} FROM (SELECT *, unnest(['l1', 'l2', 'l3']) AS level, unnest([l1, l1 // 3, l1 // 6])::VARCHAR AS entity FROM m) GROUP BY ALL),
pl AS (SELECT level, entity, unnest({NAMES}) AS metric, unnest({VALUES}) AS value FROM p),
ps AS (SELECT level, metric, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, stddev_pop(value) AS s FROM pl GROUP BY ALL),
x AS (SELECT level, entity, metric, CASE WHEN iqr > 1e-12 THEN (value - q2) / iqr WHEN s > 1e-12 THEN (value - q2) / s END AS s FROM pl JOIN ps USING (level, metric)),
sp AS (SELECT a.level, a.entity AS a, b.entity AS b, count(*) AS n_metrics, sqrt(sum((a.s - b.s) ** 2)) AS euclid, 1 - {guarded("a.s", "b.s")} AS corr FROM x a JOIN x b ON a.level = b.level AND a.metric = b.metric AND a.entity < b.entity
  WHERE a.s IS NOT NULL AND b.s IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
"""
)
GAPS = (
    WIN
    + """, y AS (SELECT w, metric, l1::VARCHAR AS entity, rz FROM lz WHERE rz IS NOT NULL),
g AS (SELECT a.w, a.entity AS a, b.entity AS b, sqrt(sum((a.rz - b.rz) ** 2)) AS d FROM y a JOIN y b ON a.w = b.w AND a.metric = b.metric AND a.entity < b.entity GROUP BY ALL),
h AS (SELECT a, b, count(*) AS n_windows, max(d) FILTER (w = 0) AS first_distance, max(d) FILTER (w = 4) AS last_distance FROM g GROUP BY ALL),
dc AS (SELECT *, last_distance - first_distance AS delta, CASE WHEN last_distance < first_distance THEN 'converging' WHEN last_distance > first_distance THEN 'diverging' END AS direction FROM h)
"""
)
DIST = V + f", f AS (SELECT l1, unnest({NAMES}) AS metric, unnest({VALUES}) AS value FROM m)"


def extremes(table: str, keys: str, value: str, ties: str, n: int, columns: str, digits: int) -> str:
    """The lowest and highest n rows of each group."""
    one = "SELECT {c}, round({v}, {r}) AS {v}, row_number() OVER (PARTITION BY {k} ORDER BY {v} {o}, {t})::INT AS rank, '{d}' AS direction FROM {f} WHERE {v} IS NOT NULL QUALIFY rank <= {n}"
    return " UNION ALL ".join(one.format(c=columns, v=value, r=digits, k=keys, o=o, t=ties, d=d, f=table, n=n) for o, d in (("ASC", "lowest"), ("DESC", "highest")))


LABEL = "(2000 + 5 * w)::VARCHAR || '-' || (2004 + 5 * w)::VARCHAR AS window_label"
ORACLES = {
    "window_metrics": WIN + f"SELECT l1, w AS window_index, {LABEL}, n, CASE WHEN n >= 3 THEN 'completed' ELSE 'skipped' END AS status, {r(*METRICS)} FROM wm",
    "metric_long_scaled": WIN + f"SELECT l1, w AS window_index, metric, {r('value', 'z', 'rz', digits=5)} FROM lz",
    "metric_changes": WIN + f"SELECT l1, metric, n_windows, trend, {r('first_value', 'last_value', 'delta_z', 'slope', 'slope_z', 'spearman', 'delta', digits=5)} FROM ch",
    "change_ranking": WIN + ", t AS (SELECT l1, coalesce(sqrt(sum(delta_z * delta_z)), 0) AS change, count(delta_z) AS n_metrics FROM ch GROUP BY l1) SELECT l1, round(change, 5) AS change, n_metrics, row_number() OVER (ORDER BY change DESC, l1)::INT AS rank FROM t",
    "top_changes": WIN + extremes("ch", "metric", "delta_z", "l1", 3, "l1, metric", 5),
    "metric_trajectories": WIN + "SELECT (l1 // 3)::INT AS l2, w AS window_index, metric, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, count(DISTINCT l1) AS n_entities FROM lg GROUP BY ALL",
    "window_sample_sizes": WIN + "SELECT w AS window_index, count(*) FILTER (n >= 3) AS completed, min(n) AS least, round(quantile_cont(n, 0.05), 6) AS p05, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most FROM wm GROUP BY w",
    "window_centroid_paths": PATHS + f"SELECT l1, n_windows, largest_step_window, {r('path', 'drift', 'directness', 'largest_step')} FROM pw",
    "movement_by_level": PATHS + "SELECT (l1 // 3)::INT AS level, count(*) AS n_entities, round(avg(path), 6) AS mean_path, round(median(path), 6) AS median_path, round(avg(drift), 6) AS mean_drift, round(median(drift), 6) AS median_drift FROM pw GROUP BY 1",
    "largest_jump_hist": PATHS + f", n AS (SELECT w::INT AS w, count(largest_step_window) AS n FROM (SELECT unnest(range(5)) AS w) LEFT JOIN pw ON largest_step_window = w GROUP BY ALL) SELECT w AS window_index, {LABEL}, n, round(n / greatest(sum(n) OVER (), 1), 6) AS share FROM n",
    "cloud_drift": V
    + f", s AS (SELECT l1, year < 2005 AS early, d, x FROM e WHERE year < 2005 OR year > 2019), k AS (SELECT l1, early, list(x ORDER BY d) AS c FROM (SELECT l1, early, d, avg(x) AS x FROM s GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL) SELECT l1, round({cos('a.c', 'b.c')}, 6) AS drift FROM (SELECT DISTINCT l1 FROM v) LEFT JOIN (SELECT * FROM k WHERE early) a USING (l1) LEFT JOIN (SELECT * FROM k WHERE NOT early) b USING (l1)",
    "cloud_annual_path": V
    + f", k AS (SELECT l2, year, list(x ORDER BY d) AS c FROM (SELECT l2, year, d, avg(x) AS x FROM e GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL), t AS (SELECT l2, c, lag(c) OVER (PARTITION BY l2 ORDER BY year) AS b FROM k) SELECT l2::INT AS l2, count(*) AS n_years, round(sum({cos('c', 'b')}), 6) AS path FROM t GROUP BY l2",
    "profile_rankings": PROF + extremes("pl", "level, metric", "value", "entity", 2, "level, entity, metric", 6),
    "profile_distances_static": PROF + f"SELECT level, a, b, n_metrics, {r('euclid', 'corr', digits=5)} FROM sp",
    "profile_pairs_top": PROF + extremes("sp", "level", "euclid", "a, b", 3, "level, a, b", 5),
    "nearest_profile": PROF + "SELECT level, entity, arg_min(other, (d, other)) AS nearest, round(min(d), 5) AS distance FROM (SELECT level, a AS entity, b AS other, euclid AS d FROM sp UNION ALL SELECT level, b, a, euclid FROM sp) GROUP BY ALL",
    "distance_changes": GAPS + f"SELECT a, b, n_windows, direction, {r('first_distance', 'last_distance', 'delta', digits=5)} FROM dc",
    "pair_entity_frequency": GAPS + "SELECT entity, count(*) FILTER (direction = 'converging') AS converging, count(*) FILTER (direction = 'diverging') AS diverging, round(avg(delta), 4) AS mean_delta, round(median(abs(delta)), 4) AS median_change FROM (SELECT unnest([a, b]) AS entity, direction, round(delta, 5) AS delta FROM dc WHERE direction IS NOT NULL) GROUP BY 1",
    "corpus_plan": COUNTS
    + ", t AS (SELECT c_nationkey, sum(n_all)::BIGINT AS a, sum(n_closed)::BIGINT AS c FROM n GROUP BY 1), j AS (SELECT n_nationkey, n_name, n_regionkey, r_name, coalesce(a, 0) AS n_all, coalesce(c, 0) AS n_closed FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN t ON n_nationkey = c_nationkey), s AS (SELECT *, sum(n_all) OVER (PARTITION BY n_regionkey) AS g FROM j) SELECT n_nationkey, n_name, r_name, n_all, round(CASE WHEN n_all > 0 THEN n_closed / n_all ELSE 0 END, 6) AS closed_share, round(CASE WHEN g > 0 THEN n_all / g ELSE 0 END, 6) AS region_share, CASE WHEN n_all >= 60 THEN 'main' WHEN n_all >= 40 THEN 'robustness_only' ELSE 'too_small' END AS reason FROM s",
    "docs_tokens": r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+')), 0) AS n_tokens FROM documents",
    "metric_distribution": DIST
    + ", s AS (SELECT metric, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM f GROUP BY 1) SELECT metric, count(value) AS n, count(DISTINCT value) AS n_unique, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(quantile_cont(value, 0.01), 5) AS p01, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.99), 5) AS p99, round(skewness(value), 5) AS skew, round(avg((value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))::INT), 5) AS outlier_share FROM f JOIN s USING (metric) GROUP BY 1",
    "metric_correlations": DIST
    + f", k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2 AS rk FROM f) SELECT a.metric AS a, b.metric AS b, count(*) AS n, round({guarded('a.value', 'b.value')}, 5) AS pearson, round({guarded('a.rk', 'b.rk')}, 5) AS spearman FROM k a JOIN k b ON a.l1 = b.l1 AND a.metric < b.metric GROUP BY ALL",
    "cluster_scores": V
    + ", k AS (SELECT a.work_id, a.l1, b.l1 AS o, avg(list_distance(a.u, b.u)) AS d FROM v a JOIN v b ON a.work_id <> b.work_id GROUP BY ALL), s AS (SELECT work_id, l1, max(d) FILTER (o = l1) AS own, min(d) FILTER (o <> l1) AS other FROM k GROUP BY ALL) SELECT l1, count(*) AS n, round(avg(CASE WHEN own IS NULL OR other IS NULL OR greatest(own, other) <= 1e-12 THEN 0 ELSE (other - own) / greatest(own, other) END), 6) AS silhouette FROM s GROUP BY 1",
    "density_entropy": V
    + ", k AS (SELECT l1, least(7, greatest(0, floor((u[1] + 0.5) * 8)))::INT AS ix, least(7, greatest(0, floor((u[2] + 0.5) * 8)))::INT AS iy, count(*) AS n FROM v GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY l1) AS mass FROM k), s AS (SELECT *, coalesce(sum(mass) OVER (PARTITION BY l1 ORDER BY mass DESC, ix, iy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM p) SELECT l1, round(sum(-mass * ln(mass)) / ln(64), 6) AS entropy, round(max(mass), 6) AS peak, count(*) FILTER (run < 0.5 - 1e-9) AS cells_50, count(*) FILTER (run < 0.9 - 1e-9) AS cells_90 FROM s GROUP BY 1",
}
