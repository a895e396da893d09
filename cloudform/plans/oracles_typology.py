"""SQL for the queries over records, typologies and trajectories, for DuckDB over the same tables."""

from .oracles import COUNTS, V
from .oracles_evolution import METRICS, PATHS, PROF, WIN, cos, r

F_ROWS = "(SELECT c_nationkey, c_mktsegment, year, count(*) AS present FROM o WHERE s = 'F' GROUP BY ALL)"
PART = V + ", k AS (SELECT l1, year % 4 AS part, count(*) AS n FROM v GROUP BY ALL)"
CEN = V + ", q AS (SELECT v.*, c.l1 AS o, list_distance(u, c.c) AS d FROM v, c)"
FIRSTS = COUNTS + ", s AS (SELECT *, least(n_all, 5) AS planned, CASE WHEN n_all <= 0 THEN 'skip' WHEN n_all <= 5 THEN 'download_all' ELSE 'sample' END AS method, CASE WHEN n_all > 5 THEN least(n_all, ceil(5 * 1.75), 10000) ELSE n_all END AS ask FROM n)"
TRAJ = (
    WIN
    + """, st AS (SELECT *, z - lag(z) OVER (PARTITION BY l1, metric ORDER BY w) AS step FROM lz WHERE z IS NOT NULL),
tf AS (SELECT l1, metric, max(z) FILTER (w = 4) - max(z) FILTER (w = 0) AS delta, CASE WHEN count(*) > 1 THEN regr_slope(z, w) END AS slope, stddev_pop(step) AS volatility FROM st GROUP BY ALL)
"""
)
PLANE = V + ", k AS (SELECT l1, year, u[1] AS x, u[2] AS y FROM v)"
SP = "SELECT b.l1, avg(list_distance(u, c)) AS s FROM v b JOIN c USING (l1) GROUP BY 1"
ORACLES = {
    "url_short_ids": r"SELECT page_id, nullif(regexp_extract(trim(url), '([^/]*)/*$', 1), '') AS short_id, trim(regexp_replace(lower(concat_ws('_', page_id::VARCHAR, url)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages",
    "record_acceptance": r"SELECT CASE WHEN doc_id IS NULL THEN 'id' WHEN NOT coalesce(lang = 'en', false) THEN 'language' WHEN NOT coalesce(trim(source) <> '', false) THEN 'source' WHEN coalesce(len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+')), 0) < 80 THEN 'length' END AS rejected, count(*) AS n FROM documents GROUP BY 1",
    "error_classes": "SELECT CASE WHEN value > 100 THEN 'rate_limit' WHEN value > 80 THEN 'timeout' WHEN value > 60 THEN 'server' WHEN value > 40 THEN 'network' WHEN value > 20 THEN 'other' ELSE 'none' END AS error, count(*) AS n FROM events GROUP BY 1",
    "request_totals": FIRSTS + "SELECT method, count(*) AS n_cells, sum(ask)::BIGINT AS n_rows, sum(ceil(ask / 3))::BIGINT AS n_pages FROM s GROUP BY 1",
    "backfill_requests": FIRSTS + f", t AS (SELECT c_nationkey, c_mktsegment, year, greatest(0, planned - coalesce(present, 0))::BIGINT AS shortfall FROM s LEFT JOIN {F_ROWS} USING (c_nationkey, c_mktsegment, year)) SELECT *, ceil(shortfall * 1.75 * 1.5)::BIGINT AS request FROM t WHERE shortfall > 0",
    "completion_report": FIRSTS + f", t AS (SELECT count(*) AS expected, count(present) AS actual FROM s LEFT JOIN {F_ROWS} USING (c_nationkey, c_mktsegment, year) WHERE planned > 0) SELECT expected, actual, round(actual / expected, 6) AS share, CASE WHEN actual / expected >= 0.99 THEN 'complete' ELSE 'incomplete' END AS verdict FROM t",
    "attribute_mismatches": 'SELECT \'n_chars\' AS "column", count(*) FILTER (length(text) IS DISTINCT FROM n_chars) AS n FROM documents UNION ALL SELECT \'lang\', count(*) FILTER (lower(lang) IS DISTINCT FROM lang) FROM documents',
    "key_overlap": "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 100000), t AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both) SELECT *, round(n_both / least(n_a, n_b), 6) AS overlap FROM t",
    "merged_records": "SELECT o_orderstatus <> 'F' AS \"new\", count(*) AS n FROM orders GROUP BY 1",
    "cluster_margins": CEN + ", t AS (SELECT work_id, l1, min(d) FILTER (o = l1) AS own, min(d) FILTER (o <> l1) AS other FROM q GROUP BY ALL) SELECT work_id, l1, round(own, 6) AS own, round(other, 6) AS other, round(other - own, 6) AS margin, row_number() OVER (PARTITION BY l1 ORDER BY own, work_id) = 1 AS prototype FROM t",
    "cluster_quality_indices": V
    + f", p AS (SELECT l1, d, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM e GROUP BY ALL), g AS (SELECT d, sum(n * m) / sum(n) AS g FROM p GROUP BY 1), t AS (SELECT sum(n * (m - g) ** 2) AS b, sum(n * v) AS w, count(DISTINCT l1) AS k, (sum(n) FILTER (d = 1))::BIGINT AS n FROM p JOIN g USING (d)), s AS (SELECT c.l1, c.c, s.s FROM c JOIN ({SP}) s USING (l1)), z AS (SELECT a.l1, max((a.s + b.s) / list_distance(a.c, b.c)) AS x FROM s a JOIN s b ON a.l1 <> b.l1 GROUP BY 1) SELECT k, n, round(b * (n - k) / (w * (k - 1)), 5) AS calinski_harabasz, round((SELECT avg(x) FROM z), 5) AS davies_bouldin FROM t",
    "contingency_nmi": PART + ", p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY l1) / sum(n) OVER () AS a, sum(n) OVER (PARTITION BY part) / sum(n) OVER () AS b FROM k), t AS (SELECT sum(p * ln(p / (a * b))) AS mi, sum(-p * ln(a)) AS ha, sum(-p * ln(b)) AS hb FROM p) SELECT round(mi, 6) AS mi, round(ha, 6) AS ha, round(hb, 6) AS hb, round(2 * mi / (ha + hb), 6) AS nmi FROM t",
    "cluster_dominant": PART + "SELECT l1, sum(n)::BIGINT AS size, arg_min(part, (-n, part)) AS dominant, round(max(n) / sum(n), 6) AS dominant_share FROM k GROUP BY 1",
    "cluster_shares": PART + "SELECT l1, part, n, round(n / sum(n) OVER (PARTITION BY l1), 6) AS share_of_cluster, round(n / sum(n) OVER (PARTITION BY part), 6) AS share_of_domain FROM k",
    "cluster_traits": PROF + ", t AS (SELECT (entity::INT // 3)::BIGINT AS cluster, metric, avg(s) AS mean FROM x WHERE level = 'l1' GROUP BY ALL HAVING avg(s) IS NOT NULL) SELECT cluster, metric, round(mean, 5) AS mean, row_number() OVER (PARTITION BY cluster ORDER BY mean DESC, metric)::INT AS rank, 'high' AS side FROM t QUALIFY rank <= 2 UNION ALL SELECT cluster, metric, round(mean, 5), row_number() OVER (PARTITION BY cluster ORDER BY mean, metric)::INT AS rank, 'low' FROM t QUALIFY rank <= 2",
    "typology_names": V + f", a AS (SELECT l1 FROM m ORDER BY p90_distance DESC, l1 LIMIT 1), b AS (SELECT l1 FROM m WHERE l1 NOT IN (FROM a) ORDER BY median_distance, l1 LIMIT 1), g AS (SELECT l1 FROM m WHERE l1 NOT IN (FROM a) AND l1 NOT IN (FROM b) ORDER BY iqr_distance DESC, l1 LIMIT 1) SELECT l1, {r(*METRICS)}, CASE WHEN l1 IN (FROM a) THEN 'spread' WHEN l1 IN (FROM b) THEN 'compact' WHEN l1 IN (FROM g) THEN 'mixed' END AS name FROM m",
    "blended_distances": PROF + ", t AS (SELECT level, a, b, euclid / avg(euclid) OVER (PARTITION BY level) AS x, corr / avg(corr) OVER (PARTITION BY level) AS y FROM sp) SELECT level, a, b, round(0.7 * x + 0.3 * y, 5) AS d FROM t",
    "domain_gap_medians": PROF + "SELECT least(a::INT // 3, b::INT // 3)::BIGINT AS domain_a, greatest(a::INT // 3, b::INT // 3)::BIGINT AS domain_b, count(*) AS n_pairs, round(median(euclid), 5) AS median_distance FROM sp WHERE level = 'l1' GROUP BY ALL",
    "pair_movement": PATHS + "SELECT CASE WHEN a.path IS NULL OR b.path IS NULL THEN 'unavailable' WHEN greatest(a.path, b.path) <= 1e-12 THEN 'neither' WHEN a.path >= 1.2 * b.path THEN 'mostly_a' WHEN b.path >= 1.2 * a.path THEN 'mostly_b' ELSE 'both_move' END AS moved, count(*) AS n FROM pw a JOIN pw b ON a.l1::VARCHAR < b.l1::VARCHAR GROUP BY 1",
    "complete_windows": WIN + "SELECT l1, w AS window_index, n FROM wm WHERE l1 IN (SELECT l1 FROM wm WHERE n >= 3 GROUP BY l1 HAVING count(*) = 5)",
    "trajectory_features": TRAJ + f"SELECT l1, metric, {r('delta', 'slope', 'volatility', digits=5)} FROM tf",
    "trajectory_vectors": TRAJ
    + f", t AS (SELECT l1, metric, unnest([0, 1, 2]) AS p, unnest([delta, slope, volatility]) AS x FROM tf), z AS (SELECT metric, p, avg(x) AS m, stddev_pop(x) AS s FROM t GROUP BY ALL) SELECT l1, (3 * (list_position({list(METRICS)}, metric) - 1) + p)::INT AS i, round(coalesce(CASE WHEN s > 1e-12 THEN (x - m) / s END, 0), 5) AS x FROM t JOIN z USING (metric, p)",
    "change_texts": WIN + ", t AS (SELECT l1, metric, delta_z, row_number() OVER (PARTITION BY l1 ORDER BY abs(delta_z) DESC, metric) AS k FROM ch WHERE delta_z IS NOT NULL QUALIFY k <= 3) SELECT l1, string_agg(metric || ':' || printf('%+.2f', delta_z), '; ' ORDER BY k) AS changes FROM t GROUP BY 1",
    "centroid_pair_distances": V
    + f", a AS (SELECT l1, l2, w, count(*) AS n, list(m ORDER BY d) AS c FROM (SELECT l1, l2, w, d, avg(x) AS m, count(*) AS n FROM e GROUP BY ALL) GROUP BY ALL), s AS (SELECT l1, l2, (year - 2000) // 5 AS w, count(*) AS n FROM v GROUP BY ALL), b AS (SELECT l2, w, s.n, unnest(list_transform(c, lambda x: x / sqrt(list_dot_product(c, c)))) AS x, generate_subscripts(c, 1) AS d FROM a JOIN s USING (l1, l2, w)), t AS (SELECT l2, w, list(x ORDER BY d) AS c FROM (SELECT l2, w, d, sum(x * n) / sum(n) AS x FROM b GROUP BY ALL) GROUP BY ALL) SELECT x.w::INT AS window_index, x.l2::INT AS a, y.l2::INT AS b, round({cos('x.c', 'y.c')}, 6) AS d FROM t x JOIN t y ON x.w = y.w AND x.l2 < y.l2",
    "plane_extents": PLANE + "SELECT l1, round(min(x) - 0.05 * (max(x) - min(x)), 6) AS x_low, round(max(x) + 0.05 * (max(x) - min(x)), 6) AS x_high, round(min(y) - 0.05 * (max(y) - min(y)), 6) AS y_low, round(max(y) + 0.05 * (max(y) - min(y)), 6) AS y_high FROM k GROUP BY 1",
    "plane_shape": PLANE
    + ", a AS (SELECT l1, x - median(x) OVER (PARTITION BY l1) AS x, y - median(y) OVER (PARTITION BY l1) AS y FROM k), b AS (SELECT *, sqrt(x * x + y * y) AS r FROM a), g AS (SELECT l1, count(*) AS n, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS q2, quantile_cont(r, 0.75) AS q3, quantile_cont(r, 0.95) AS q4, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vc FROM b GROUP BY 1), o AS (SELECT b.l1, avg((r > q3 + 1.5 * (q3 - q1))::INT) AS s FROM b JOIN g USING (l1) GROUP BY 1) SELECT l1, n, round(q4 / q2, 5) AS tail, round((q3 - q1) / q2, 5) AS spread, round(s, 5) AS outlier_share, round(sqrt(((vx + vy) / 2 + sqrt((vx - vy) ** 2 / 4 + vc * vc)) / ((vx + vy) / 2 - sqrt((vx - vy) ** 2 / 4 + vc * vc))), 5) AS elongation FROM g JOIN o USING (l1)",
    "plane_window_means": PLANE + "SELECT ((year - 2000) // 5)::INT AS window_index, (2000 + 5 * ((year - 2000) // 5))::VARCHAR || '-' || (2004 + 5 * ((year - 2000) // 5))::VARCHAR AS window_label, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM k GROUP BY 1, 2",
    "density_smoothed": V
    + ", k AS (SELECT l1, least(7, greatest(0, floor((u[1] + 0.5) * 8)))::INT AS ix, least(7, greatest(0, floor((u[2] + 0.5) * 8)))::INT AS iy, count(*) AS n FROM v GROUP BY ALL), p AS (SELECT l1, ix, iy, n / sum(n) OVER (PARTITION BY l1) AS mass FROM k), t AS (SELECT unnest(range(-4, 5))::INT AS k), w AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM t), a AS (SELECT l1, (ix + k + 16) % 16 AS i, iy, mass * w AS mass FROM p, w), b AS (SELECT l1, CASE WHEN i < 8 THEN i ELSE 15 - i END AS ix, (iy + k + 16) % 16 AS i, mass * w AS mass FROM a, w) SELECT l1, ix, CASE WHEN i < 8 THEN i ELSE 15 - i END AS iy, round(sum(mass), 6) AS mass FROM b GROUP BY ALL",
    "cell_gini": V + ", k AS (SELECT l1, count(*) AS x FROM v GROUP BY l1, least(7, greatest(0, floor((u[1] + 0.5) * 8))), least(7, greatest(0, floor((u[2] + 0.5) * 8)))), q AS (SELECT l1, x, row_number() OVER (PARTITION BY l1 ORDER BY x) AS i FROM k) SELECT l1, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM q GROUP BY 1",
}
