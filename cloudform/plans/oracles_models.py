"""SQL for the queries over models that SQL can express, for DuckDB over the same tables."""

from .oracles import V


def ari(b: str) -> str:
    two = "(SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM k WHERE b = '{b}' GROUP BY {c}))"
    x, y, s = two.format(b=b, c="l1"), two.format(b=b, c="o"), two.format(b=b, c="l1, o")
    n = f"(SELECT sum(n) FROM k WHERE b = '{b}')"
    want = f"({x} * {y} / ({n} * ({n} - 1) / 2))"
    return f"SELECT '{b}' AS pair, ({s} - {want}) / (({x} + {y}) / 2 - {want}) AS ari"


ORACLES = {
    "partition_verdicts": V
    + f", k AS (SELECT 'l1_l2' AS b, l1, l2 AS o, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'l1_part', l1, year % 4, count(*) FROM v GROUP BY ALL), t AS ({ari('l1_l2')} UNION ALL {ari('l1_part')}) SELECT pair, round(ari, 6) AS ari, CASE WHEN ari IS NULL THEN 'unknown' WHEN ari >= 0.5 THEN 'agree' WHEN ari >= 0.2 THEN 'partly' ELSE 'differ' END AS verdict FROM t",
    "shard_vectors": "SELECT vec_id, label, len(embedding)::INT AS dim, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[-1]::DOUBLE, 5) AS last FROM embeddings WHERE embedding IS NOT NULL",
    "shard_counts": "SELECT max(len(embedding))::INT AS dim, count(*) AS n_rows, count(*) AS n_meta, count(DISTINCT vec_id) AS n_ids, 0::BIGINT AS n_errors FROM embeddings WHERE embedding IS NOT NULL",
}
