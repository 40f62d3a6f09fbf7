"""DuckDB SQL for the queries that SQL can express whole."""

_PARTS = r"""
parsed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages)
"""



def _rounds(rounds: int) -> str:
    """Centroid and assignment tables of each round: c0, a0, c1, a1, and so on."""
    out = ""
    for r in range(rounds + 1):
        out += f"""
d{r} AS MATERIALIZED (SELECT vec_id, e, cluster, CAST(list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM v, c{r}),
a{r} AS MATERIALIZED (SELECT vec_id, any_value(e) AS e, CAST(arg_min(cluster, (distance, cluster)) AS INTEGER) AS cluster, min(distance) AS distance FROM d{r} GROUP BY vec_id),"""
        if r < rounds:
            out += f"""
s{r} AS (SELECT cluster, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, unnest(range(1, 65)) AS j FROM a{r}) GROUP BY cluster, j),
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} USING (cluster)),"""
    return out


ORACLE_SQL: dict[str, str] = {
    "op3_url_rules": f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
{_PARTS},
fits AS (
  SELECT host, path, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(r_verdict, length(r_host || r_path)) AS r_verdict
  FROM (SELECT DISTINCT host, path FROM parsed), rules
  WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY host, path)
SELECT page_id, parsed.host, parsed.path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM parsed LEFT JOIN fits ON parsed.host = fits.host AND parsed.path = fits.path
""",
    "op8_pivot_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q, v WHERE q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    "op11_yinyang": f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, e AS m FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40),{_rounds(5)}
t AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a5 GROUP BY cluster)
SELECT vec_id, cluster, distance, cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM a5) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a5 JOIN t USING (cluster) JOIN c5 USING (cluster)
""",
    "op12_content_sort": r"""
WITH normed AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (w ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM normed WINDOW w AS (PARTITION BY norm)
""",
}
