"""SQL for the queries over rows of metrics, similarities over windows, joins and reports of entities."""

from ..operators.rows import DICTIONARY
from .oracles import KNN, V
from .oracles_evolution import ORACLES as EVOLUTION
from .oracles_evolution import GAPS, PATHS, PROF, WIN, cos, extremes, guarded, r
from .oracles_typology import CEN

GINI = """deg AS (SELECT v.l1, v.work_id, count(k.dst) AS x FROM v LEFT JOIN knn k ON k.dst = v.work_id GROUP BY ALL), rg AS (SELECT l1, x, row_number() OVER (PARTITION BY l1 ORDER BY x) AS i, count(*) OVER (PARTITION BY l1) AS n FROM deg),
gi AS (SELECT l1, 2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n) AS hub_gini FROM rg GROUP BY l1)"""
KNW = f""", kp AS (SELECT a.l1, (a.year - 2000) // 5 AS w, a.work_id AS src, b.work_id AS dst, 1 - list_dot_product(a.u, b.u) AS d FROM v a JOIN v b ON a.l1 = b.l1 AND (a.year - 2000) // 5 = (b.year - 2000) // 5 AND a.work_id <> b.work_id
  QUALIFY row_number() OVER (PARTITION BY a.l1, (a.year - 2000) // 5, a.work_id ORDER BY round(d, 12), b.work_id) <= 5),
kw AS (SELECT l1, w, quantile_cont(d, 0.5) AS median_knn, stddev_pop(d) / avg(d) AS cv_knn FROM kp GROUP BY ALL),
dw AS (SELECT v.l1, (v.year - 2000) // 5 AS w, v.work_id, count(k.dst) AS x FROM v LEFT JOIN kp k ON k.dst = v.work_id GROUP BY ALL),
rw AS (SELECT l1, w, x, row_number() OVER (PARTITION BY l1, w ORDER BY x) AS i, count(*) OVER (PARTITION BY l1, w) AS n FROM dw),
gw AS (SELECT l1, w, 2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n) AS hub_gini FROM rw GROUP BY ALL)
"""
WALK = PATHS[len(V) :].replace("wc", "pc")
MOVED = ", mv AS (SELECT l1::VARCHAR AS entity, path, drift FROM pw)"
LABEL = "(2000 + 5 * w)::VARCHAR || '-' || (2004 + 5 * w)::VARCHAR AS window_label"
LEVELS = (
    WIN
    + """, lm AS (SELECT level, w, entity, metric, avg(rz) AS scaled, count(DISTINCT l1) AS n_entities FROM (SELECT *, unnest(['l1', 'l2', 'l3']) AS level, unnest([l1, l1 // 3, l1 // 6])::VARCHAR AS entity FROM lz) GROUP BY ALL),
lk AS (SELECT * FROM lm WHERE scaled IS NOT NULL)
"""
)
SIMILAR = (
    LEVELS
    + f""", s0 AS (SELECT a.level, a.w, a.entity AS a, b.entity AS b, count(*) AS n_metrics, sqrt(sum((a.scaled - b.scaled) ** 2)) AS euclid, {guarded("a.scaled", "b.scaled")} AS rr, max(abs(a.scaled - b.scaled) - 1e-5 * abs(b.scaled)) AS gap
  FROM lk a JOIN lk b ON a.level = b.level AND a.w = b.w AND a.metric = b.metric AND a.entity < b.entity GROUP BY ALL),
s1 AS (SELECT level, w, a, b, n_metrics, euclid, CASE WHEN n_metrics < 2 THEN NULL WHEN rr IS NOT NULL THEN 1 - greatest(-1.0, least(1.0, rr)) WHEN gap <= 1e-8 THEN 0 END AS corr FROM s0)
"""
)


def changed(table: str, keys: str, value: str, digits: int) -> str:
    k = keys + ", " if keys else ""
    return f""", t AS (SELECT {k}a, b, count(*) AS n_windows, max({value}) FILTER (w = 0) AS first_distance, max({value}) FILTER (w = 4) AS last_distance, CASE WHEN count(*) > 1 THEN regr_slope({value}, w) END AS slope FROM {table} WHERE {value} IS NOT NULL GROUP BY ALL),
u AS (SELECT *, last_distance - first_distance AS delta FROM t)
SELECT {k}a, b, n_windows, {r("first_distance", "last_distance", "slope", "delta", digits=digits)}, CASE WHEN delta < 0 THEN 'converging' WHEN delta > 0 THEN 'diverging' WHEN delta = 0 THEN 'unchanged' END AS direction FROM u"""


def drift(a: str, b: str) -> str:
    return f"""sd AS (SELECT l1, side, list(x ORDER BY d) AS c FROM (SELECT l1, side, d, avg(x) AS x FROM (SELECT l1, d, x, unnest(['early', 'late']) AS side, unnest([{a}, {b}]) AS used FROM e) WHERE used GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL),
sn AS (SELECT l1, count(*) FILTER ({a}) AS n_early, count(*) FILTER ({b}) AS n_late FROM v GROUP BY l1),
dr AS (SELECT l1, {cos("a.c", "b.c")} AS drift, n_early, n_late FROM sn LEFT JOIN (SELECT * FROM sd WHERE side = 'early') a USING (l1) LEFT JOIN (SELECT * FROM sd WHERE side = 'late') b USING (l1))"""


EDGES = "year BETWEEN 2000 AND 2004", "year BETWEEN 2020 AND 2024"
WORKS = r"""
WITH k AS (SELECT d.doc_id::VARCHAR AS work_id, d.source AS l1, d.lang AS l2, d.source[1:1] AS l3, e.event_type AS topic_id, e.event_type AS topic, e.props AS topics_json, string_split(d.text, chr(10))[1] AS title, d.text AS body, d.lang AS language, d.source AS kind, year(e.ts) AS year
  FROM documents d LEFT JOIN events e ON d.doc_id = e.event_id)
"""


def blank(c: str) -> str:
    return f"count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS missing_{c}"


TOKENS = r"coalesce(len(regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+')), 0)"
_names = ("work_id", "l1", "l2", "l3", "topic_id", "topic", "topics_json", "title", "body")
WORK_COUNTS = (
    "count(*) AS n_rows, count(work_id) - count(DISTINCT work_id) AS duplicates, count(*) FILTER (year > 2023) AS after_window, count(*) FILTER (year < 2000) AS before_window, count(*) FILTER (year IS NULL OR year NOT BETWEEN 2000 AND 2023) AS outside_window, "
    + ", ".join(map(blank, _names))
    + f", count(*) FILTER (topics_json IS NULL OR NOT json_valid(topics_json)) AS unparsable_topics, count(*) FILTER ({TOKENS.format('title')} < 5) AS short_title, count(*) FILTER ({TOKENS.format('body')} < 80) AS short_body, count(*) FILTER (language IS NULL OR language <> 'en') AS other_language, count(*) FILTER (kind IS NULL OR kind NOT IN ('web', 'news')) AS other_kind"
)
_dictionary = ", ".join("({}, {})".format(i, ", ".join("'" + x.replace("'", "''") + "'" for x in row)) for i, row in enumerate(DICTIONARY))

ORACLES = {
    "window_metrics": WIN + KNW + f"SELECT l1, w AS window_index, {LABEL}, n, CASE WHEN n >= 3 THEN 'completed' ELSE 'skipped' END AS status, {r('median_distance', 'iqr_distance', 'p90_distance')}, " + ", ".join(f"CASE WHEN n >= 3 THEN round({c}, 6) END AS {c}" for c in ("median_knn", "cv_knn", "hub_gini")) + " FROM wm LEFT JOIN kw USING (l1, w) LEFT JOIN gw USING (l1, w)",
    "metric_changes": EVOLUTION["metric_changes"].replace("max(z) FILTER (w = 4) - max(z) FILTER (w = 0) AS delta_z,", "max(z) FILTER (w = 4) - max(z) FILTER (w = 0) AS delta_z, max(rz) FILTER (w = 4) - max(rz) FILTER (w = 0) AS delta_rz,").replace("round(delta_z, 5) AS delta_z", "round(delta_z, 5) AS delta_z, round(delta_rz, 5) AS delta_rz"),
    "change_ranking": WIN + ", t AS (SELECT l1, coalesce(sqrt(sum(delta_z * delta_z)), 0) AS change, coalesce(sqrt(sum(slope_z * slope_z)), 0) AS slope_norm, count(delta_z) AS n_metrics FROM ch GROUP BY l1) SELECT l1, round(change, 5) AS change, round(slope_norm, 5) AS slope_norm, n_metrics, row_number() OVER (ORDER BY change DESC, l1)::INT AS rank FROM t",
    "top_changes": WIN + extremes("ch", "metric", "delta_z", "l1", 3, "l1, metric", 5) + " UNION ALL SELECT l1, metric, round(delta_z, 5) AS delta_z, row_number() OVER (PARTITION BY metric ORDER BY abs(ch.delta_z) DESC, l1)::INT AS rank, 'largest' AS direction FROM ch WHERE delta_z IS NOT NULL QUALIFY rank <= 3",
    "metric_trajectories": WIN + "SELECT (l1 // 3)::INT AS l2, w AS window_index, metric, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, round(avg(z), 6) AS mean_z, round(median(z), 6) AS median_z, count(DISTINCT l1) AS n_entities FROM lz GROUP BY ALL",
    "metric_scaling": WIN + "SELECT metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM lg GROUP BY metric",
    "cloud_drift": V + ", " + drift(*EDGES) + " SELECT l1, round(drift, 6) AS drift, n_early, n_late FROM dr",
    "cloud_drift_short": V + ", " + drift("year BETWEEN 2003 AND 2007", "year BETWEEN 2006 AND 2010") + " SELECT l1, round(drift, 6) AS drift, n_early, n_late FROM dr",
    "cloud_graph_components": KNN.replace("WITH v", "WITH RECURSIVE v", 1) + ", bo AS (SELECT l1, a, b FROM edges UNION SELECT l1, b, a FROM edges), re(l1, s, t) AS (SELECT l1, work_id, work_id FROM v UNION SELECT re.l1, re.s, bo.b FROM re JOIN bo ON bo.a = re.t), cc AS (SELECT l1, s, min(t) AS c FROM re GROUP BY ALL), cs AS (SELECT l1, c, count(*) AS n FROM cc GROUP BY ALL) SELECT l1, count(*) AS n_components, round(max(n) / sum(n), 6) AS largest_share FROM cs GROUP BY l1",
    "distance_matrix": PROF + ", q AS (SELECT level, a AS entity, b AS other, euclid AS d FROM sp UNION ALL SELECT level, b, a, euclid FROM sp) SELECT level, entity, other, round(d, 5) AS d FROM q UNION ALL SELECT DISTINCT level, entity, entity, 0.0 FROM q",
    "group_status": KNN + ", " + GINI + ", " + drift(*EDGES) + f""", ky AS (SELECT l1, year, list(x ORDER BY d) AS c FROM (SELECT l1, year, d, avg(x) AS x FROM e GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL), st AS (SELECT l1, year, c, lag(c) OVER (PARTITION BY l1 ORDER BY year) AS b FROM ky), pt AS (SELECT l1, sum({cos('c', 'b')}) AS path FROM st GROUP BY l1),
k1 AS (SELECT l1, quantile_cont(d, 0.5) AS median_knn FROM knn GROUP BY l1), e1 AS (SELECT l1, quantile_cont(d, 0.5) AS median_edge FROM edges GROUP BY l1),
j AS (SELECT m.l1, m.n, m.centroid_norm, m.median_distance, k1.median_knn, gi.hub_gini, e1.median_edge, dr.drift, pt.path, CASE WHEN abs(pt.path) > 1e-12 THEN dr.drift / pt.path END AS directness FROM m LEFT JOIN k1 USING (l1) LEFT JOIN gi USING (l1) LEFT JOIN e1 USING (l1) LEFT JOIN dr USING (l1) LEFT JOIN pt USING (l1)),
w AS (SELECT *, n >= 30 AS ok, array_to_string(list_filter([CASE WHEN n <= 5 THEN 'fewer neighbours than asked for' END, CASE WHEN drift IS NULL THEN 'too few rows in the first or last years' END, CASE WHEN path IS NULL THEN 'fewer than two years with enough rows' END], lambda x: x IS NOT NULL), '; ') AS t FROM j)
SELECT l1, n AS n_available, CASE WHEN ok THEN n ELSE 0 END AS n_used, 2000::INT AS early_min, 2004::INT AS early_max, 2020::INT AS late_min, 2024::INT AS late_max, CASE WHEN NOT ok THEN 'skipped' WHEN t <> '' THEN 'completed_with_warnings' ELSE 'completed' END AS status, CASE WHEN ok THEN '' ELSE 'fewer than 30 rows' END AS error, CASE WHEN ok THEN t ELSE '' END AS warnings,
  CASE WHEN ok THEN least(5, n - 1) ELSE 0 END::INT AS effective_k, CASE WHEN ok THEN least(64, n - 1) ELSE 0 END::INT AS n_axes, """ + ", ".join(f"CASE WHEN ok THEN round({c}, 5) END AS {c}" for c in ("centroid_norm", "median_distance", "median_knn", "hub_gini", "median_edge", "drift", "path", "directness")) + " FROM w",
    "metric_dictionary": f"SELECT place::INT AS place, metric, family, meaning FROM (VALUES {_dictionary}) t(place, metric, family, meaning)",
    "window_centroid_status": V + "SELECT l1, w::INT AS window_index, count(work_id) AS n, CASE WHEN count(work_id) >= 3 THEN 'completed' ELSE 'skipped' END AS status, CASE WHEN count(work_id) >= 3 THEN 64::INT END AS dim FROM (SELECT l1, w FROM (SELECT DISTINCT l1 FROM v), (SELECT unnest(range(5)) AS w)) g LEFT JOIN (SELECT l1, work_id, (year - 2000) // 5 AS w FROM v) x USING (l1, w) GROUP BY ALL",
    "entropy_trends": V + ", k AS (SELECT l1, year, least(7, greatest(0, floor((u[1] + 0.5) * 8)))::INT AS ix, least(7, greatest(0, floor((u[2] + 0.5) * 8)))::INT AS iy, count(*) AS n FROM v GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY l1, year) AS mass FROM k), s AS (SELECT l1, year, sum(-mass * ln(mass)) / ln(64) AS h FROM p GROUP BY ALL) SELECT l1, round(CASE WHEN count(*) > 1 THEN regr_slope(h, year) END, 5) AS entropy_slope, round(CASE WHEN count(*) > 1 THEN regr_r2(h, year) END, 5) AS entropy_r2 FROM s GROUP BY l1",
    "level_window_means": LEVELS + "SELECT level, w AS window_index, entity, metric, round(scaled, 5) AS scaled, n_entities FROM lm",
    "level_similarities": SIMILAR + "SELECT level, w AS window_index, a, b, n_metrics, round(euclid, 5) AS euclid, round(corr, 5) AS corr FROM s1",
    "similarity_changes": SIMILAR + changed("s1", "level", "euclid", 4),
    "semantic_distance_changes": V + f", wc AS (SELECT l2, w, list(m ORDER BY d) AS c FROM (SELECT l2, w, d, avg(x) AS m FROM e GROUP BY ALL) GROUP BY ALL), pp AS (SELECT x.w, x.l2::INT AS a, y.l2::INT AS b, {cos('x.c', 'y.c')} AS d FROM wc x JOIN wc y ON x.w = y.w AND x.l2 < y.l2)" + changed("pp", "", "d", 5),
    "closest_farthest": PROF + ", t AS (" + extremes("sp", "level", "euclid", "a, b", 3, "level, a, b", 5) + ") SELECT level, CASE direction WHEN 'lowest' THEN 'closest' ELSE 'farthest' END AS side, rank, least(a, b) || '__' || greatest(a, b) AS pair, a, b, euclid AS distance FROM t",
    "works_quality": WORKS + f", t AS (SELECT {WORK_COUNTS} FROM k) SELECT *, true AS failed FROM t",
    "index_join": "SELECT vec_id AS doc_id, label, lang, source FROM embeddings LEFT JOIN documents ON vec_id = doc_id",
    "parent_names": "SELECT n_regionkey AS k, n_nationkey, CASE WHEN ends_with(n_name, '1') THEN r_name ELSE n_name END AS name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "nation_totals": "SELECT coalesce(a.k, b.k) AS nation, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 0 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_acctbal < 0 GROUP BY 1) b ON a.k = b.k",
    "range_totals": "SELECT o_orderstatus, count(*)::BIGINT AS n_range FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1",
    "counts_by_year": "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (year(o_orderdate) = {y}) AS n_{y}" for y in range(1995, 1999)) + " FROM orders GROUP BY 1",
    "numbered_documents": "SELECT doc_id, row_number() OVER (ORDER BY lang NULLS FIRST, n_chars NULLS FIRST, doc_id) - 1 AS row_id, length(text) AS n FROM documents",
    "shared_segment_names": "SELECT c_mktsegment, c_nationkey, n AS n_ids FROM (SELECT DISTINCT c_mktsegment, c_nationkey, count(DISTINCT c_nationkey) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE n > 1",
    "unfinished_orders": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus <> 'F' GROUP BY 1",
    "reduced_numbers": "SELECT event_id, round(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 3) AS k, round(value, 3) AS value FROM events",
    "cluster_nearest": V + "SELECT l1, work_id, round(d, 5) AS d, rank::INT AS rank FROM (SELECT l1, work_id, list_distance(u, c) AS d, row_number() OVER (PARTITION BY l1 ORDER BY list_distance(u, c), work_id) AS rank FROM v JOIN c USING (l1)) WHERE rank <= 5",
    "largest_orders": "SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 3",
    "strongest_correlations": "SELECT *, row_number() OVER (ORDER BY abs(spearman) DESC, a, b)::INT AS rank FROM (" + EVOLUTION["metric_correlations"] + ") WHERE spearman IS NOT NULL QUALIFY rank <= 3",
    "distribution_flags": "SELECT metric, n_unique, skew, 0.0::DOUBLE AS missing_share, n_unique <= 3 AS near_constant, coalesce(abs(skew) >= 0.3, false) AS skewed, false AS missing, concat_ws(',', CASE WHEN n_unique <= 3 THEN 'near_constant' END, CASE WHEN abs(skew) >= 0.3 THEN 'skewed' END) AS flags FROM (" + EVOLUTION["metric_distribution"] + ")",
    "checkpoint_cap": "WITH b AS (SELECT o_orderkey, o_custkey, o_orderdate, (o_orderstatus <> 'F')::INT AS fresh FROM orders) SELECT o_orderkey, o_custkey FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY fresh, o_orderdate, o_orderkey) <= 5",
    "density_kernel": V + """, s AS (SELECT l1, count(*) AS n, var_samp(u[1]) AS a, var_samp(u[2]) AS b, covar_samp(u[1], u[2]) AS c FROM v GROUP BY l1), g AS (SELECT i::INT AS ix, j::INT AS iy FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j)),
k AS (SELECT v.l1, ix, iy, a, b, c, n, a * b - c * c AS det, -0.5 + (ix + 0.5) / 8 - u[1] AS dx, -0.5 + (iy + 0.5) / 8 - u[2] AS dy FROM v JOIN s USING (l1), g),
w AS (SELECT l1, ix, iy, sum(exp(-(b * dx * dx - 2 * c * dx * dy + a * dy * dy) / det * pow(n, 1 / 3) / 2)) AS w FROM k GROUP BY ALL) SELECT l1, ix, iy, round(w / sum(w) OVER (PARTITION BY l1), 6) AS mass FROM w""",
    "density_ceiling": V + ", k AS (SELECT l1, least(7, greatest(0, floor((u[1] + 0.5) * 8)))::INT AS ix, least(7, greatest(0, floor((u[2] + 0.5) * 8)))::INT AS iy, count(*) AS n FROM v GROUP BY ALL), p AS (SELECT l1, n, n / sum(n) OVER (PARTITION BY l1) AS mass, sum(n) OVER (PARTITION BY l1) AS t FROM k) SELECT l1, round(quantile_cont(mass, 0.995), 6) AS ceiling FROM p WHERE t >= 20 GROUP BY l1",
    "accept_capped": "WITH a AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS c FROM events), b AS (SELECT *, c <= 2 AND count(*) FILTER (c <= 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5 AS ok FROM a) SELECT event_id, user_id, event_type, CASE WHEN ok THEN 'accepted' WHEN count(*) FILTER (ok) OVER (PARTITION BY user_id, event_type) >= 2 THEN 'cell_full' ELSE 'entity_full' END AS decision FROM b",
    "events_accept_stream": "SELECT user_id, event_type, least(count(*), 3) AS n, least(count(*), 3) AS n_ids FROM events GROUP BY ALL",
    "pair_drivers": PROF + WALK + MOVED + " SELECT a, b, round(x.path, 5) AS path_a, round(x.drift, 5) AS drift_a, round(y.path, 5) AS path_b, round(y.drift, 5) AS drift_b, CASE WHEN x.path IS NULL OR y.path IS NULL THEN 'unavailable' WHEN x.path > y.path THEN a WHEN y.path > x.path THEN b ELSE 'both' END AS driver FROM sp LEFT JOIN mv x ON x.entity = a LEFT JOIN mv y ON y.entity = b WHERE level = 'l1'",
    "pair_edges": GAPS + WALK + MOVED + """, z AS (SELECT a, b, round(delta, 5) AS delta FROM dc WHERE delta IS NOT NULL), t AS (SELECT * FROM z QUALIFY row_number() OVER (ORDER BY delta, a, b) <= 5 UNION ALL SELECT * FROM z QUALIFY row_number() OVER (ORDER BY delta DESC, a, b) <= 5)
SELECT a, b, CASE WHEN delta < 0 THEN 'approach' ELSE 'departure' END AS kind, round(abs(delta), 4) AS weight, round(x.path, 4) AS movement_a, round(y.path, 4) AS movement_b FROM t LEFT JOIN mv x ON x.entity = a LEFT JOIN mv y ON y.entity = b""",
    "cluster_reports": CEN + """, t AS (SELECT work_id, l1, min(d) FILTER (o = l1) AS own, min(d) FILTER (o <> l1) AS other FROM q GROUP BY ALL),
y AS (SELECT l1, year, count(*) AS n FROM v GROUP BY ALL), z AS (SELECT *, n / sum(n) OVER (PARTITION BY l1) AS part FROM y),
mx AS (SELECT l1, sum(n)::BIGINT AS size, string_agg(year::VARCHAR || ' ' || round(100 * part)::BIGINT || '%', ', ' ORDER BY n DESC, year::VARCHAR) AS mix FROM z GROUP BY l1),
pr AS (SELECT l1, string_agg(work_id::VARCHAR, ', ' ORDER BY rk) AS prototypes FROM (SELECT l1, work_id, row_number() OVER (PARTITION BY l1 ORDER BY own, work_id) AS rk FROM t) WHERE rk <= 3 GROUP BY l1),
mg AS (SELECT l1, median(other - own) AS median_margin, avg((other - own < 0)::INT) AS border_share FROM t GROUP BY l1)
SELECT l1, size, mix, prototypes, round(median_margin, 5) AS median_margin, round(border_share, 5) AS border_share FROM mx JOIN pr USING (l1) JOIN mg USING (l1)""",
    "entity_names": "SELECT c_nationkey, min(c_mktsegment) AS c_mktsegment, count(DISTINCT c_mktsegment) AS n_names FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1",
    "canonical_flags": "WITH o AS (SELECT CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS main, o_totalprice > 100000 AS robust FROM orders) SELECT main, robust, NULL::BOOLEAN AS strict, main AS eligible, count(*) AS n FROM o GROUP BY ALL",
    "first_entities": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 20) GROUP BY 1",
    "derived_columns": "SELECT year(o_orderdate)::INT AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL",
    "strict_prices": "SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "threshold_statuses": "SELECT metric, n, row_number() OVER (ORDER BY n DESC, metric)::INT AS rank FROM (SELECT o_orderstatus AS metric, count(*)::DOUBLE AS n FROM orders GROUP BY 1) WHERE n >= 1000",
    "nation_master": "SELECT n_nationkey AS k, n_name, c.n AS customers_n, s.n AS suppliers_n FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1) s ON s.k = n_nationkey",
    "eligible_years": "SELECT o_orderkey, year(o_orderdate)::INT AS year, true AS main FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) BETWEEN 1993 AND 1995",
    "named_clusters": V + """, w AS (SELECT (l1 // 3)::INT AS l2, avg(mean_distance) AS width, avg(centroid_norm) AS norm FROM m GROUP BY 1), a AS (SELECT l2 FROM w ORDER BY width DESC, l2 LIMIT 1), b AS (SELECT l2 FROM w WHERE l2 NOT IN (FROM a) ORDER BY width, l2 LIMIT 1), c3 AS (SELECT l2 FROM w WHERE l2 NOT IN (FROM a) AND l2 NOT IN (FROM b) ORDER BY norm DESC, l2 LIMIT 1)
SELECT l2, CASE WHEN l2 IN (FROM a) THEN 'wide' WHEN l2 IN (FROM b) THEN 'narrow' WHEN l2 IN (FROM c3) THEN 'central' END AS name FROM w""",
    "replaced_table": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
}
