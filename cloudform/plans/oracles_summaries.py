"""SQL for the queries over summaries and comparisons, for DuckDB over the same tables."""

from .oracles import KNN, V
from .oracles_evolution import GAPS, METRICS, PROF, WIN, guarded, r
from .oracles_typology import F_ROWS, FIRSTS, PLANE

COVER = FIRSTS + f", t AS (SELECT *, coalesce(present, 0) AS have, greatest(0, planned - coalesce(present, 0)) AS short FROM s LEFT JOIN {F_ROWS} USING (c_nationkey, c_mktsegment, year))"
TOTALS = "count(*) AS n_cells, count(*) FILTER (short = 0) AS n_complete, sum(planned)::BIGINT AS planned, sum(have)::BIGINT AS present, sum(short)::BIGINT AS shortfall, round(CASE WHEN sum(planned) > 0 THEN sum(have) / sum(planned) ELSE 0 END, 6) AS coverage"
LONG = V + f", lo AS (SELECT l1, unnest({list(METRICS)}) AS metric, unnest([{', '.join(METRICS)}]) AS value FROM m)"
HOLED = LONG + ", ho AS (SELECT l1, metric, CASE WHEN NOT ((metric = 'iqr_distance' AND l1 % 5 = 1) OR (metric = 'p90_distance' AND l1 % 2 = 1)) THEN value END AS value FROM lo)"
SPECS = PROF + (
    ", s2 AS (SELECT a.level, a.entity AS a, b.entity AS b, sqrt(sum((a.s - b.s) ** 2)) AS y FROM x a JOIN x b ON a.level = b.level AND a.metric = b.metric AND a.entity < b.entity WHERE a.s IS NOT NULL AND b.s IS NOT NULL AND a.metric <> 'mean_distance' GROUP BY ALL HAVING count(*) >= 2)"
    ", two AS (SELECT level, a, b, euclid AS x, y, y - euclid AS delta, rank() OVER (PARTITION BY level ORDER BY euclid)::INT AS rank_x, rank() OVER (PARTITION BY level ORDER BY y)::INT AS rank_y FROM sp JOIN s2 USING (level, a, b))"
)


def ranks(c: str, keys: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2"


ORACLES = {
    "converging_pairs": GAPS + "SELECT a, b, round(delta, 5) AS delta, row_number() OVER (ORDER BY delta, a, b)::INT AS rank, 'converging' AS side FROM dc WHERE delta < 0 QUALIFY rank <= 3 UNION ALL SELECT a, b, round(delta, 5), row_number() OVER (ORDER BY delta DESC, a, b)::INT AS rank, 'diverging' FROM dc WHERE delta > 0 QUALIFY rank <= 3",
    "entity_retention": WIN + ", t AS (SELECT l1, count(value) FILTER (w = 0) AS n_first, count(value) FILTER (w = 4) AS n_last FROM lg GROUP BY 1) SELECT *, n_first >= 2 AND n_last >= 2 AS kept, CASE WHEN n_first >= 2 AND n_last >= 2 THEN 'kept' WHEN n_last >= 2 THEN 'first_window' WHEN n_first >= 2 THEN 'last_window' ELSE 'both_windows' END AS reason FROM t",
    "entity_coverage": COVER + f" SELECT c_nationkey, c_mktsegment, {TOTALS} FROM t GROUP BY ALL",
    "year_coverage": COVER + f" SELECT year, {TOTALS} FROM t GROUP BY ALL",
    "change_signs": WIN + "SELECT metric, count(*) FILTER (delta_z > 0) AS n_up, count(*) FILTER (delta_z < 0) AS n_down, count(*) FILTER (delta_z = 0) AS n_flat, round(min(delta_z), 5) AS least, round(max(delta_z), 5) AS most FROM ch GROUP BY 1",
    "cluster_profile_z": LONG + ", g AS (SELECT metric, avg(value) AS gm, stddev_pop(value) AS gs FROM lo GROUP BY 1), t AS (SELECT (l1 // 3)::INT AS cluster, metric, avg(value) AS mean, median(value) AS median FROM lo GROUP BY ALL) SELECT cluster, metric, round(mean, 5) AS mean, round(median, 5) AS median, round((mean - gm) / gs, 5) AS z FROM t JOIN g USING (metric)",
    "metric_information": HOLED + ", t AS (SELECT metric, count(*) AS n, 1 - count(value) / count(*) AS missing_share, count(DISTINCT value) AS n_unique, count(*) FILTER (value = 0) / count(value) AS zero_share, count(DISTINCT value) / count(value) AS unique_share FROM ho GROUP BY 1) SELECT metric, n, round(missing_share, 6) AS missing_share, n_unique, round(zero_share, 6) AS zero_share, round(unique_share, 6) AS unique_share, CASE WHEN missing_share >= 0.3 THEN 'missing' WHEN n_unique <= 3 THEN 'constant' WHEN zero_share >= 0.8 THEN 'zero_dominated' ELSE 'fine' END AS flag FROM t",
    "family_correlations": LONG + f", p AS (SELECT a.metric AS a, b.metric AS b, a.value AS x, b.value AS y FROM lo a JOIN lo b USING (l1) WHERE a.metric IN ('{METRICS[0]}', '{METRICS[1]}') AND b.metric IN ('{METRICS[2]}', '{METRICS[3]}')), q AS (SELECT *, {ranks('x', 'a, b')} AS rx, {ranks('y', 'a, b')} AS ry FROM p) SELECT a, b, count(*) AS n, round({guarded('x', 'y')}, 5) AS pearson, round({guarded('rx', 'ry')}, 5) AS spearman FROM q GROUP BY ALL",
    "imputed_metrics": HOLED + ", f AS (SELECT metric, median(value) AS q FROM ho GROUP BY 1 HAVING 1 - count(value) / count(*) < 0.3 AND count(DISTINCT value) > 1), i AS (SELECT l1, metric, coalesce(value, q) AS value FROM ho JOIN f USING (metric)) SELECT l1, metric, round(value, 5) AS value, round((value - avg(value) OVER (PARTITION BY metric)) / stddev_pop(value) OVER (PARTITION BY metric), 5) AS z FROM i",
    "balanced_scaling": PROF + "SELECT level, entity, metric, round(s / sqrt(CASE WHEN metric = 'iqr_distance' THEN 1 ELSE 3 END), 5) AS scaled FROM x",
    "spec_pairs": SPECS + f"SELECT level, a, b, {r('x', 'y', 'delta', digits=5)}, rank_x, rank_y, least(rank_x, rank_y) AS best_rank FROM two",
    "spec_agreement": SPECS + f", q AS (SELECT *, {ranks('x', 'level')} AS rx, {ranks('y', 'level')} AS ry FROM two) SELECT level, count(*) AS n, round({guarded('x', 'y')}, 5) AS pearson, round({guarded('rx', 'ry')}, 5) AS spearman FROM q GROUP BY 1",
    "domain_ends": PROF + "SELECT level, metric, arg_min(entity, (s, entity)) AS lowest, arg_min(entity, (-s, entity)) AS highest FROM x WHERE level <> 'l3' AND s IS NOT NULL GROUP BY ALL",
    "kth_neighbour_stats": KNN + ", t AS (SELECT l1, src, arg_max(d, round(d, 12)) AS d FROM knn GROUP BY ALL) SELECT l1, count(*) AS n, round(median(d), 6) AS median_kth, round(stddev_pop(d) / avg(d), 6) AS cv_kth FROM t GROUP BY 1",
    "plane_yearly_path": PLANE
    + f", a AS (SELECT l1, year, median(x) AS x, median(y) AS y, median(sqrt(x * x + y * y)) AS r FROM k GROUP BY ALL), b AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM a WINDOW w AS (PARTITION BY l1 ORDER BY year)), t AS (SELECT l1, count(*) AS n_years, sum(step) AS path, stddev_pop(step) / avg(step) AS step_cv, arg_min(x, year) AS ax, arg_min(y, year) AS ay, arg_max(x, year) AS zx, arg_max(y, year) AS zy, regr_slope(r, year) AS radial_slope, {guarded('r', 'year')} AS c FROM b GROUP BY 1) SELECT l1, n_years, round(sqrt((ax - zx) ** 2 + (ay - zy) ** 2), 5) AS drift, {r('path', 'step_cv', 'radial_slope', digits=5)}, round(c * c, 5) AS radial_r2 FROM t",
    "matrix_checks": "SELECT count(*) AS n, count(*) FILTER (coalesce(len(embedding), -1) <> 64) AS wrong_dimension, count(*) - count(DISTINCT vec_id) AS repeated, max(vec_id) - min(vec_id) + 1 = count(DISTINCT vec_id) AS contiguous FROM embeddings",
    "share_pivot": V + "SELECT l1, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (year % 4 = {k}) / count(*), 6) AS share_{k}" for k in range(4)) + " FROM v GROUP BY 1",
    "top_ranked_profiles": V + f"SELECT l1, {r(*METRICS)}, row_number() OVER (ORDER BY p90_distance DESC, l1)::INT AS place FROM m QUALIFY place <= 4",
}
