"""SQL with the results of the queries, for DuckDB over the same tables."""

V = """
WITH v AS (SELECT vec_id AS work_id, label AS l1, label // 3 AS l2, label // 6 AS l3, (2000 + vec_id % 25)::INT AS year, e,
  list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM (SELECT *, embedding::DOUBLE[] AS e FROM embeddings)),
e AS (SELECT l1, l2, year, (year - 2000) // 5 AS w, unnest(u) AS x, generate_subscripts(u, 1) AS d FROM v),
c AS (SELECT l1, list(m ORDER BY d) AS c FROM (SELECT l1, d, avg(x) AS m FROM e GROUP BY ALL) GROUP BY l1),
dist AS (SELECT v.l1, sqrt(list_dot_product(c, c)) AS norm, 1 - list_dot_product(u, c) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(c, c))) AS d FROM v JOIN c USING (l1)),
m AS (SELECT l1, count(*) AS n, first(norm) AS centroid_norm, avg(d) AS mean_distance, stddev_pop(d) AS std_distance, quantile_cont(d, 0.5) AS median_distance,
  quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS iqr_distance, quantile_cont(d, 0.9) AS p90_distance, quantile_cont(d, 0.9) / quantile_cont(d, 0.5) AS p90_to_median FROM dist GROUP BY l1)
"""
KNN = (
    V
    + """, pairs AS (SELECT a.l1, a.work_id AS src, b.work_id AS dst, 1 - list_dot_product(a.u, b.u) AS d FROM v a JOIN v b ON a.l1 = b.l1 AND a.work_id <> b.work_id),
knn AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY l1, src ORDER BY round(d, 12), dst) <= 5),
edges AS (SELECT l1, least(src, dst) AS a, greatest(src, dst) AS b, max(d) AS d FROM knn WHERE d > 1e-12 GROUP BY ALL)
"""
)
COUNTS = """
WITH o AS (SELECT c_nationkey, c_mktsegment, year(o_orderdate)::INT AS year, o_orderstatus AS s, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT * FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM o), (SELECT unnest(range(1995, 2002))::INT AS year)),
n AS (SELECT c_nationkey, c_mktsegment, year, count(s) AS n_all, count(*) FILTER (s = 'F') AS n_closed, count(*) FILTER (s = 'F' AND p > 100000) AS n_large
  FROM g LEFT JOIN o USING (c_nationkey, c_mktsegment, year) GROUP BY ALL)
"""
ORACLES = {
    "cloud_dispersion": V + "SELECT l1, n, round(centroid_norm, 6) AS centroid_norm, round(mean_distance, 6) AS mean_distance, round(std_distance, 6) AS std_distance, round(median_distance, 6) AS median_distance, round(iqr_distance, 6) AS iqr_distance, round(p90_distance, 6) AS p90_distance, round(p90_to_median, 6) AS p90_to_median FROM m",
    "cloud_knn_stats": KNN + "SELECT l1, count(*) AS n_pairs, round(avg(d), 6) AS mean_knn, round(quantile_cont(d, 0.5), 6) AS median_knn, round(quantile_cont(d, 0.9), 6) AS p90_knn, round(stddev_pop(d) / avg(d), 6) AS cv_knn FROM knn GROUP BY l1",
    "cloud_hub_gini": KNN + ", deg AS (SELECT v.l1, v.work_id, count(k.dst) AS x FROM v LEFT JOIN knn k ON k.dst = v.work_id GROUP BY ALL), r AS (SELECT l1, x, row_number() OVER (PARTITION BY l1 ORDER BY x) AS i, count(*) OVER (PARTITION BY l1) AS n FROM deg) SELECT l1, round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n), 6) AS hub_gini FROM r GROUP BY l1",
    "cloud_graph_edges": KNN + "SELECT l1, count(*) AS n_edges, round(quantile_cont(d, 0.5), 6) AS median_edge, round(quantile_cont(d, 0.9), 6) AS p90_edge FROM edges GROUP BY l1",
    "entity_centroid_unit": V + "SELECT l1, (generate_subscripts(c, 1) - 1)::INT AS dim, round(unnest(list_transform(c, lambda x: x / sqrt(list_dot_product(c, c)))), 6) AS x FROM c",
    "profile_table_raw": V + ", p AS (SELECT 'l1' AS level, l1::VARCHAR AS entity, * EXCLUDE (l1) FROM m UNION ALL SELECT 'l2', (l1 // 3)::VARCHAR, * EXCLUDE (l1) FROM m UNION ALL SELECT 'l3', (l1 // 6)::VARCHAR, * EXCLUDE (l1) FROM m) SELECT level, entity, count(*) AS n_rows, round(avg(mean_distance), 6) AS mean_distance, round(avg(median_distance), 6) AS median_distance, round(avg(iqr_distance), 6) AS iqr_distance, round(avg(p90_distance), 6) AS p90_distance FROM p GROUP BY ALL",
    "year_counts_dense": COUNTS + "SELECT * FROM n",
    "annual_coverage": COUNTS + "SELECT c_nationkey, c_mktsegment, sum(n_all)::BIGINT AS total, count(*) FILTER (n_all > 0) AS n_years, count(*) FILTER (n_all >= 5) AS n_years_at_target, min(n_all) AS least, round(median(n_all), 6) AS median FROM n GROUP BY ALL",
    "sample_plan": COUNTS + "SELECT c_nationkey, c_mktsegment, year, n_all, least(n_all, 5)::BIGINT AS planned, CASE WHEN n_all <= 0 THEN 'skip' WHEN n_all <= 5 THEN 'download_all' ELSE 'sample' END AS method, CASE WHEN n_all <= 5 THEN n_all ELSE least(n_all, 9) END::BIGINT AS first_request FROM n",
    "cell_coverage": COUNTS + "SELECT c_nationkey, c_mktsegment, year, least(n_all, 5)::BIGINT AS planned, n_closed AS present, greatest(0, least(n_all, 5) - n_closed)::BIGINT AS shortfall, round(CASE WHEN n_all > 0 THEN n_closed / least(n_all, 5) ELSE 0 END, 6) AS coverage FROM n",
    "labels_display": "SELECT n_nationkey, n_nationkey || ' | ' || r_name || ' / ' || n_name AS label, count(*) OVER (PARTITION BY n_name) > 1 AS repeated FROM nation JOIN region ON n_regionkey = r_regionkey",
    "docs_quality_counters": "SELECT count(*) AS n_rows, count(doc_id) - count(DISTINCT doc_id) AS duplicates, count(*) FILTER (text IS NULL OR trim(text) = '') AS missing_text, count(*) FILTER (source IS NULL OR trim(source) = '') AS missing_source, count(*) FILTER (lang <> 'en') AS other_language, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (n_chars < 200) AS short, true AS failed FROM documents LEFT JOIN labels USING (doc_id)",
    "json_validity": "SELECT event_type, count(*) AS n, count(*) FILTER (props IS NULL OR NOT json_valid(props)) AS invalid FROM events GROUP BY 1",
    "abstract_rebuild": "SELECT doc_id, md5(text) AS digest FROM documents",
    "resume_pending": "SELECT DISTINCT user_id, event_type FROM events EXCEPT SELECT user_id, event_type FROM events WHERE value > 120",
    "accept_capped": "WITH a AS (SELECT event_id, user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 2) SELECT event_id, user_id, event_type FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5",
    "status_histogram": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "balanced_sample_size": "SELECT label AS l1, least(count(*), 30) AS n FROM embeddings GROUP BY 1",
    "index_audit": "SELECT 'vectors_without_document' AS \"check\", count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'documents_without_vector', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'repeated_vectors', count(vec_id) - count(DISTINCT vec_id) FROM embeddings UNION ALL SELECT 'wrong_dimension', count(*) FROM embeddings WHERE len(embedding) <> 64",
    "cluster_composition": V + "SELECT l1, year % 4 AS part, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l1), 6) AS share FROM v GROUP BY l1, year % 4",
    "cluster_purity": V + "SELECT round(sum(most) / sum(n), 6) AS purity FROM (SELECT l2, max(n) AS most, sum(n) AS n FROM (SELECT l2, l1, count(*) AS n FROM v GROUP BY ALL) GROUP BY l2)",
    "cluster_relabel": V + "SELECT work_id, cluster::INT AS cluster FROM v JOIN (SELECT l1, row_number() OVER (ORDER BY count(*) DESC, l1::VARCHAR) AS cluster FROM v GROUP BY l1) USING (l1)",
    "contingency_ari": V + ", t AS (SELECT l1, l2, count(*) AS n FROM v GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS b, (SELECT sum(n) FROM t) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY l1)) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY l2)) AS y) SELECT round((b - x * y / (a * (a - 1) / 2)) / ((x + y) / 2 - x * y / (a * (a - 1) / 2)), 6) AS ari FROM s",
    "density_cells": V + "SELECT l1, ix, iy, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l1), 6) AS mass FROM (SELECT l1, greatest(0, least(7, floor((u[1] + 0.5) * 8)))::INT AS ix, greatest(0, least(7, floor((u[2] + 0.5) * 8)))::INT AS iy FROM v) GROUP BY l1, ix, iy",
    "events_tumbling": "SELECT time_bucket(INTERVAL '5 days', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
}
