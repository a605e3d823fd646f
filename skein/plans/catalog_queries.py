"""Registered queries of target validation, release audits, collections and upkeep, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, contract, curation, maintenance, release
from ..sources.tables import table
from .state_queries import _ENTRIES, _NORM, _entries


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id is not null").withColumnRenamed("source", "collection").withColumnRenamed("text", "body")


def contract_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every error and warning of the training targets."""
    rows = table(spark, d, "qmd_expansion_personal_entities").where("record_id is not null").select("record_id", "query", "intent", "output").distinct()
    checked = contract.check_targets(rows)
    return checked.select("record_id", F.explode(F.concat("errors", "warnings")).alias("c")).select("record_id", "c.code", "c.path").distinct()


def contract_keys(spark: SparkSession, d: str) -> DataFrame:
    """Targets by the key of their input, and how many of each are valid or quarantined."""
    rows = table(spark, d, "qmd_expansion_personal_entities").where("record_id is not null").select("record_id", "query", "intent", "output").distinct()
    checked = contract.check_targets(rows.where(~F.coalesce(F.concat_ws("", "query", "intent"), F.lit("")).rlike(r'["\\\p{Cc}/]')))
    return checked.groupBy("input_key").agg(F.count(F.lit(1)).alias("records"), F.count_if("quarantined").alias("quarantined"))


def prepared_queries(spark: SparkSession, d: str) -> DataFrame:
    """Judged queries of the training sources and why some are left out."""
    judged = curation.binary_judgements(table(spark, d, "qrels")).where("split = 'train' and source_id is not null").select("source_id", F.col("query_id").alias("qid")).distinct()
    queries = table(spark, d, "distill_records").select("source_id", "qid", "query")
    known = table(spark, d, "distill_records").where("source_id is not null and qid is not null").select("source_id", "qid").distinct()
    return release.prepare_source(judged.unionByName(known).distinct(), queries, curation.distinct_queries(table(spark, d, "eval_deep_research"), "query"))


def release_checks(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of the training and evaluation splits break the rules of a release."""
    train = table(spark, d, "qmd_expansion_locations").select(F.col("record_id").alias("id"), F.col("query").alias("text"), F.lit("train").alias("split"), F.col("source_id").alias("source")).distinct()
    evals = table(spark, d, "eval_deep_research").select(F.col("case_id").alias("id"), F.col("query").alias("text"), "split", F.col("source_id").alias("source")).distinct()
    judged = table(spark, d, "qrels").where("query_id is not null and corpus_id is not null").select("split", "query_id", F.col("corpus_id").alias("doc"), "score").distinct()
    docs = table(spark, d, "eval_deep_research").where("expected_doc is not null").select(F.col("expected_doc").alias("doc")).distinct()
    return release.release_audit(train.unionByName(evals), judged, docs)


def tree_digest(spark: SparkSession, d: str) -> DataFrame:
    """One digest over the paths and contents of a collection."""
    rows = _docs(spark, d).where("active and collection = 'handbook'")
    return spark.createDataFrame([(release.tree_hash(rows, "path", "hash"),)], "digest string")


def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files of a collection below a folder."""
    return catalog.list_files(_docs(spark, d), "handbook", "notes/").select("collection", "path", "size")


def collection_files(spark: SparkSession, d: str) -> DataFrame:
    return catalog.list_collections(_docs(spark, d).where("collection is not null"))


CONFIG = {
    "collections": {
        "handbook": {"path": "/data/handbook", "ignore": ["notes/**", "**/*-1*.md"], "context": {"": "Team handbook", "notes": "Meeting notes", "notes/2030": "Notes of a year"}},
        "vault-tamdovhul": {"path": "/data/vault-tamdovhul", "ignore": ["Archive/**"], "includeByDefault": False},
        "vault-wexgriren": {"path": "/data/vault-wexgriren"},
    },
    "global_context": "Everything",
}


def default_scope(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the collections that queries take when none is named."""
    names = catalog.Catalog.from_config(CONFIG).scope()
    return _docs(spark, d).where("active").where(F.col("collection").isin(names)).select("doc_id", "collection")


def synced_collections(spark: SparkSession, d: str) -> DataFrame:
    """Documents per collection after those of collections outside the configuration are gone."""
    return catalog.Catalog.from_config(CONFIG).sync(_docs(spark, d)).groupBy("collection").agg(F.count(F.lit(1)).alias("documents"))


def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    """References in several forms and the ignore rule that excludes them."""
    refs = _docs(spark, d).where("path is not null and collection is not null")
    forms = F.array(F.concat(F.lit("skein://"), "collection", F.lit("/"), "path"), F.concat(F.lit("/data/"), "collection", F.lit("/"), "path"), F.concat("collection", F.lit("/"), "path"))
    return catalog.Catalog.from_config(CONFIG).ignored(refs.select(F.explode(forms).alias("ref")).distinct())


def context_list(spark: SparkSession, d: str) -> DataFrame:
    """The configured contexts after one was added and one removed."""
    c = catalog.Catalog.from_config(CONFIG)
    c.set_context("vault-wexgriren", "inbox", "Unsorted")
    c.remove_context("handbook", "notes")
    return c.contexts(spark)


def contained_paths(spark: SparkSession, d: str) -> DataFrame:
    """Whether paths stay inside their collection once they are resolved."""
    docs = _docs(spark, d).where("active and path is not null and collection is not null")
    root = F.concat(F.lit("/data/"), "collection")
    forms = {"plain": F.concat(root, F.lit("/"), "path"), "up": F.concat(root, F.lit("/../other/"), "path"), "detour": F.concat(root, F.lit("/./a/../"), "path"), "sibling": F.concat(root, F.lit("x/"), "path")}
    return docs.select("doc_id", *[catalog.contained(c, root).alias(n) for n, c in forms.items()])


def attached_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The latest documents with their metadata."""
    top = _docs(spark, d).where("active").orderBy(F.desc("modified_at"), "doc_id").limit(50).select(F.col("doc_id").alias("doc"))
    e = _entries(spark, d).where("value_type = 'string'").select("doc", "key", "ordinal", "value_type", "text_value", "number_value", "boolean_value")
    return catalog.attach_metadata(top, e)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Three vectors of each content that a language's model embedded."""
    docs = _docs(spark, d).where("hash is not null")
    rows = docs.select("hash", F.coalesce("lang", F.lit("?")).alias("model"), F.substring("hash", 1, 1).alias("fingerprint")).distinct()
    return rows.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(2))))


def embedding_groups(spark: SparkSession, d: str) -> DataFrame:
    return catalog.fingerprint_groups(_vectors(spark, d))


def vector_occupancy(spark: SparkSession, d: str) -> DataFrame:
    """How full the files of a vector table are, one file per collection."""
    files = _docs(spark, d).where("collection is not null").groupBy("collection").agg(F.count(F.lit(1)).alias("rows"))
    return catalog.occupancy(files, 64)


def cleaned_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a clean-up leaves in each table."""
    docs = _docs(spark, d).select("hash", "active", "collection")
    content = table(spark, d, "content").select("hash").unionByName(docs.select("hash")).where("hash is not null").distinct()
    kept = catalog.cleanup(content, docs, _vectors(spark, d))
    out = None
    for name, df in sorted(kept.items()):
        one = df.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def without_collection(spark: SparkSession, d: str) -> DataFrame:
    """What is left once a collection is removed."""
    docs = _docs(spark, d).where("collection is not null").select("hash", "collection")
    rest, content = catalog.remove_collection(docs, docs.select("hash").where("hash is not null").distinct(), "handbook")
    return rest.agg(F.count(F.lit(1)).alias("documents")).crossJoin(content.agg(F.count(F.lit(1)).alias("contents")))  # one row each


def cleared_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors per model after those that only one collection has are cleared."""
    kept = catalog.clear_embeddings(_vectors(spark, d), _docs(spark, d), "handbook")
    return kept.groupBy("model").agg(F.count(F.lit(1)).alias("vectors"))


def vectors_to_copy(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that a collection lacks although another has its content's."""
    docs = _docs(spark, d).where("collection is not null and hash is not null")
    v = _vectors(spark, d).groupBy("hash", "seq").agg(F.min("model").alias("model"))
    rows = maintenance.vector_rows(v, docs).where("collection <> 'handbook'").select("hash", "seq", "collection")
    return catalog.copied_vectors(v, docs, rows).select("hash", "seq", "collection", "model")


def complete_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of documents whose set is complete; every fourth hash lacks its last one."""
    v = _vectors(spark, d).groupBy("hash", "seq").agg(F.lit(3).alias("total_chunks"))
    partial = v.where(~(F.substring("hash", 2, 1).isin("0", "4", "8", "c") & (F.col("seq") == 2)))
    return maintenance.partial_vectors(partial).groupBy("seq").agg(F.count(F.lit(1)).alias("vectors"))


def size_labels(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and ages of documents as people read them."""
    docs = _docs(spark, d).where("n_chars is not null and modified_at is not null")
    now = F.lit("2031-01-01 00:00:00").cast("timestamp")
    return docs.select("doc_id", release.size_label(F.col("n_chars") * 700).alias("size"), release.span_label(F.col("n_chars")).alias("span"), release.age_label(F.least("modified_at", now), now).alias("age"))


def term_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How alike question and notes of each evaluation case are by their terms."""
    rows = table(spark, d, "eval_deep_research").where("case_id is not null and query is not null and notes is not null").select("case_id", "query", "notes").distinct()
    return rows.select("case_id", "query", "notes", F.round(T.term_jaccard(F.col("query"), F.col("notes")), 9).alias("similarity"))


def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    """Document fields as JSON with ordered keys."""
    docs = _docs(spark, d).where(r"path is not null and collection is not null and lang is not null and not path rlike '[\"\\\\]'")
    return docs.select("doc_id", T.canonical_map(F.create_map(F.lit("path"), "path", F.lit("collection"), "collection", F.lit("lang"), "lang")).alias("json"))


def golden_expansions(spark: SparkSession, d: str) -> DataFrame:
    """Entries of training outputs against those of the other records of the same question, by words."""
    rows = table(spark, d, "qmd_expansion_locations").where("record_id is not null and query is not null").select("record_id", "query", "output").distinct()
    first = rows.groupBy("query").agg(F.min("record_id").alias("record_id"), F.max("record_id").alias("other")).where("record_id <> other")
    said = first.join(rows.select("record_id", "output"), "record_id").select(F.col("record_id").alias("id"), F.lit("said").alias("side"), F.explode("output").alias("e"))
    gold = first.join(rows.select(F.col("record_id").alias("other"), "output"), "other").select(F.col("record_id").alias("id"), F.lit("golden").alias("side"), F.explode("output").alias("e"))
    text = F.get("e", F.lit(1))
    return curation.golden_scores(said.unionByName(gold).where(text.isNotNull()).select("id", "side", text.alias("text")).distinct())


def only_queries(spark: SparkSession, d: str) -> DataFrame:
    """Training records, and those whose question is limited to one kind."""
    rows = table(spark, d, "qmd_expansion_locations").where("record_id is not null").select("record_id", "query").distinct()
    marked = rows.withColumn("query", F.when(F.col("record_id").endswith("7"), F.concat("query", F.lit(" /only:lex"))).otherwise(F.col("query")))
    return marked.where(curation.only_directive(F.col("query"))).select("record_id")


QUERIES = {
    f.__name__: f
    for f in (
        contract_checks, contract_keys, prepared_queries, release_checks, tree_digest, file_listing, collection_files, default_scope, synced_collections, ignored_files, context_list, contained_paths,
        attached_metadata, embedding_groups, vector_occupancy, cleaned_tables, without_collection, cleared_vectors, vectors_to_copy, complete_vectors, size_labels, term_similarity, canonical_rows,
        golden_expansions, only_queries,
    )
}

_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_VEC = "SELECT DISTINCT hash, coalesce(lang, '?') AS model, substring(hash, 1, 1) AS fingerprint, unnest([0, 1, 2]) AS seq FROM documents WHERE doc_id IS NOT NULL AND hash IS NOT NULL"
_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"
_TERMS = "list_filter(" + _WORDS + ", lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.TERM_STOP_WORDS) + "))"


def _targets() -> str:
    s = _STRIP.format
    return rf"""
WITH r AS (SELECT DISTINCT record_id, query, intent, output FROM qmd_expansion_personal_entities WHERE record_id IS NOT NULL),
q AS (SELECT *, {s("coalesce(query, '')")} AS sq, {s("coalesce(intent, '')")} AS si, coalesce(len(output), 0) AS n FROM r),
m AS (SELECT *, regexp_matches(lower(sq), '{contract.ONLY_MODE}') AS only_ FROM q),
e AS (SELECT record_id, query, intent, output, only_, unnest(output) AS x, generate_subscripts(output, 1) - 1 AS i FROM m),
f AS (SELECT *, coalesce(len(x), -1) = 2 AS pair, coalesce(len(x), -1) = 2 AND coalesce(x[1] IN ('hyde', 'lex', 'vec'), false) AS known FROM e),
g AS (SELECT *, x[1] AS kind, x[2] AS raw, {s("coalesce(x[2], '')")} AS t FROM f),
k AS (SELECT *, known AND t <> '' AS said, lower(regexp_replace(t, '[\s\p{{Z}}]+', ' ', 'g')) AS cmp, len(regexp_split_to_array(t, '[\s\p{{Z}}]+')) AS w, length(t) - length(replace(t, '"', '')) AS quotes FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY record_id, query, intent, output, kind, cmp, said ORDER BY i) AS nth FROM k),
c AS (SELECT record_id, query, intent, output, any_value(only_) AS only_, count(*) FILTER (kind = 'lex' AND said) AS lex, count(*) FILTER (kind = 'vec' AND said) AS vec, count(*) FILTER (kind = 'hyde' AND said) AS hyde FROM p GROUP BY ALL),
z AS (SELECT m.record_id, m.only_, coalesce(lex, 0) AS lex, coalesce(vec, 0) AS vec, coalesce(hyde, 0) AS hyde FROM m LEFT JOIN c ON m.record_id = c.record_id AND m.query IS NOT DISTINCT FROM c.query AND m.intent IS NOT DISTINCT FROM c.intent AND m.output IS NOT DISTINCT FROM c.output)
"""


def _item(code: str, condition: str, path: str = "[1]") -> str:
    return f"SELECT record_id, '{code}' AS code, 'output[' || i || ']{path}' AS path FROM p WHERE {condition}"


def _row(code: str, condition: str, path: str, source: str = "m") -> str:
    return f"SELECT record_id, '{code}' AS code, '{path}' AS path FROM {source} WHERE {condition}"


_CHECKS = [
    _row("TRAIN_EMPTY_QUERY", "sq = ''", "query"),
    _row("TRAIN_MULTILINE_QUERY", r"sq <> '' AND regexp_matches(query, '[\r\n]')", "query"),
    _row("TRAIN_EMPTY_INTENT", "intent IS NOT NULL AND si = ''", "intent"),
    _row("TRAIN_MULTILINE_INTENT", r"intent IS NOT NULL AND si <> '' AND regexp_matches(intent, '[\r\n]')", "intent"),
    _row("TRAIN_ONLY_MODE", "only_", "query"),
    _row("TRAIN_EMPTY_OUTPUT", "n = 0", "output"),
    _item("TRAIN_INVALID_OUTPUT_PAIR", "NOT pair", ""),
    _item("TRAIN_INVALID_OUTPUT_TYPE", "pair AND NOT known", "[0]"),
    _item("TRAIN_EMPTY_OUTPUT_TEXT", "known AND NOT said"),
    _item("TRAIN_MULTILINE_OUTPUT", r"said AND regexp_matches(raw, '[\r\n]')"),
    _item("TRAIN_CONTROL_CHARACTER", r"said AND regexp_matches(raw, '[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x{9f}]')"),
    _item("TRAIN_CHAT_TEMPLATE_LEAK", "said AND (" + " OR ".join(f"contains(raw, '{t}')" for t in contract.CHAT_TOKENS) + ")"),
    _item("TRAIN_DUPLICATE_OUTPUT", "said AND nth > 1", ""),
    _item("TRAIN_LEX_UNMATCHED_QUOTE", "said AND kind = 'lex' AND quotes % 2 = 1"),
    _item("TRAIN_LEX_NO_POSITIVE_TERM", r"""said AND kind = 'lex' AND quotes % 2 = 0 AND len(list_filter(regexp_extract_all(t, '-?"[^"]*"|\S+'), lambda y: NOT starts_with(y, '-') AND regexp_matches(y, '[\p{L}\p{N}_]'))) = 0"""),
    _item("WARN_LEX_TOO_LONG", "said AND kind = 'lex' AND w > 16"),
    _item("WARN_TEMPLATE_FINGERPRINT", f"said AND contains(cmp, '{contract.TEMPLATE}')"),
    _item("WARN_TIME_SENSITIVE", f"said AND regexp_matches(cmp, '{contract.TIME_SENSITIVE}')"),
    *[_item(f"WARN_{k.upper()}_TOO_SHORT", f"said AND kind = '{k}' AND w < {a}") for k, (a, _, _) in contract.LENGTHS.items()],
    *[_item(f"{c}_{k.upper()}_TOO_LONG", f"said AND kind = '{k}' AND w > {b}") for k, (_, b, c) in contract.LENGTHS.items()],
    *[_row(f"TRAIN_MISSING_{k.upper()}", f"NOT only_ AND {k} = 0", "output", "z") for k in ("lex", "vec")],
    *[_row(f"TRAIN_TOO_MANY_{k.upper()}", f"NOT only_ AND {k} > {n}", "output", "z") for k, n in contract.MOST.items()],
]

_T_NORM = _NORM.replace("lower(query)", "lower(coalesce(text, ''))")

SQL = {
    "contract_checks": _targets() + "SELECT DISTINCT * FROM (" + "\nUNION ALL ".join(_CHECKS) + ")",
    "contract_keys": _targets()
    + r"""SELECT CASE WHEN sq <> '' THEN sha256('{"intent":' || CASE WHEN intent IS NULL THEN 'null' ELSE '"' || si || '"' END || ',"query":"' || sq || '"}') END AS input_key, count(*) AS records, count(*) FILTER (only_) AS quarantined
      FROM m WHERE NOT regexp_matches(coalesce(query, '') || coalesce(intent, ''), '["\\\x00-\x1f\x7f-\x{9f}/]') GROUP BY 1""",
    "prepared_queries": f"""WITH j AS (SELECT source_id, query_id AS qid FROM qrels WHERE split = 'train' AND score >= 1 AND source_id IS NOT NULL AND query_id IS NOT NULL AND corpus_id IS NOT NULL
        UNION SELECT source_id, qid FROM distill_records WHERE source_id IS NOT NULL AND qid IS NOT NULL),
      q AS (SELECT source_id, qid, min(query) AS query, true AS known FROM distill_records WHERE qid IS NOT NULL GROUP BY ALL),
      h AS (SELECT DISTINCT {_NORM} AS t FROM eval_deep_research WHERE query IS NOT NULL),
      b AS (SELECT j.source_id, j.qid, q.query, known, coalesce({_NORM.replace("lower(query)", "lower(q.query)")}, '') AS t FROM j LEFT JOIN q ON j.source_id = q.source_id AND j.qid = q.qid)
      SELECT source_id, qid, query, CASE WHEN known IS NULL THEN 'missing_query' WHEN t = '' THEN 'empty_query' WHEN t IN (SELECT t FROM h) THEN 'exact_holdout_collision' ELSE 'admitted' END AS state FROM b""",
    "release_checks": f"""WITH q0 AS (SELECT DISTINCT record_id AS id, query AS text, 'train' AS split, source_id AS source FROM qmd_expansion_locations
        UNION ALL (SELECT DISTINCT case_id, query, split, source_id FROM eval_deep_research)),
      q AS (SELECT *, CASE WHEN text IS NOT NULL THEN {_T_NORM} END AS t FROM q0),
      j AS (SELECT DISTINCT split, query_id, corpus_id AS doc, score FROM qrels WHERE query_id IS NOT NULL AND corpus_id IS NOT NULL),
      s AS (SELECT source, count(*) AS n FROM q WHERE split = 'train' AND source IS NOT NULL GROUP BY source)
      SELECT 'duplicate_id' AS check, (SELECT count(*) FROM (SELECT 1 FROM q WHERE id <> '' GROUP BY split, id HAVING count(*) > 1)) AS rows
      UNION ALL SELECT 'duplicate_text', (SELECT count(*) FROM (SELECT 1 FROM q WHERE t <> '' GROUP BY split, t HAVING count(*) > 1))
      UNION ALL SELECT 'id_across_splits', (SELECT count(*) FROM (SELECT 1 FROM q WHERE id <> '' GROUP BY id HAVING count(DISTINCT split) > 1))
      UNION ALL SELECT 'text_across_splits', (SELECT count(*) FROM (SELECT 1 FROM q WHERE t <> '' GROUP BY t HAVING count(DISTINCT split) > 1))
      UNION ALL SELECT 'dangling_query', (SELECT count(*) FROM j WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.id = j.query_id AND q.split = j.split))
      UNION ALL SELECT 'dangling_document', (SELECT count(*) FROM j WHERE NOT EXISTS (SELECT 1 FROM eval_deep_research e WHERE e.expected_doc = j.doc))
      UNION ALL SELECT 'not_binary', (SELECT count(*) FROM j WHERE score IS NULL OR score NOT IN (0, 1))
      UNION ALL SELECT 'unbalanced_source', (SELECT coalesce(sum(n) - min(n) * count(*), 0) FROM s)""",
    "tree_digest": "SELECT sha256(string_agg(path || chr(0) || hash || chr(10), '' ORDER BY path, hash)) AS digest FROM documents WHERE doc_id IS NOT NULL AND active AND source = 'handbook' AND path IS NOT NULL AND hash IS NOT NULL",
    "file_listing": "SELECT source AS collection, path, CAST(length(text) AS INT) AS size FROM documents WHERE doc_id IS NOT NULL AND active AND source = 'handbook' AND starts_with(path, 'notes/')",
    "collection_files": "SELECT source AS collection, count(*) AS files FROM documents WHERE doc_id IS NOT NULL AND active AND source IS NOT NULL GROUP BY source",
    "default_scope": "SELECT doc_id, source AS collection FROM documents WHERE doc_id IS NOT NULL AND active AND source IN ('handbook', 'vault-wexgriren')",
    "synced_collections": "SELECT source AS collection, count(*) AS documents FROM documents WHERE doc_id IS NOT NULL AND source IN ('handbook', 'vault-tamdovhul', 'vault-wexgriren') GROUP BY 1",
    "ignored_files": r"""WITH d AS (SELECT DISTINCT source AS c, path AS p FROM documents WHERE doc_id IS NOT NULL AND path IS NOT NULL AND source IS NOT NULL),
      h AS (SELECT c, p, CASE WHEN c = 'handbook' AND regexp_matches(p, '^notes/.+') THEN 'notes/**' WHEN c = 'handbook' AND regexp_matches(p, '(^|/)[^/]*-1[^/]*\.md$') THEN '**/*-1*.md' WHEN c = 'vault-tamdovhul' AND regexp_matches(p, '^Archive/.+') THEN 'Archive/**' END AS rule FROM d),
      other AS (SELECT *, c <> 'handbook' AND regexp_matches(p, '(^|/)[^/]*-1[^/]*\.md$') AS o FROM h)
      SELECT unnest(['skein://' || c || '/' || p, '/data/' || c || '/' || p]) AS ref, c AS collection, p AS path, rule FROM h WHERE rule IS NOT NULL
      UNION ALL SELECT c || '/' || p, CASE WHEN o THEN 'handbook' ELSE c END, CASE WHEN o THEN c || '/' || p ELSE p END, CASE WHEN o THEN '**/*-1*.md' ELSE rule END FROM other WHERE o OR rule IS NOT NULL""",
    "context_list": "SELECT * FROM (VALUES (NULL, '', 'Everything'), ('handbook', 'notes/2030', 'Notes of a year'), ('handbook', '', 'Team handbook'), ('vault-wexgriren', 'inbox', 'Unsorted')) AS t(collection, prefix, text)",
    "contained_paths": "SELECT doc_id, true AS plain, false AS up, true AS detour, false AS sibling FROM documents WHERE doc_id IS NOT NULL AND active AND path IS NOT NULL AND source IS NOT NULL",
    "attached_metadata": _ENTRIES
    + """, top AS (SELECT doc_id AS doc FROM documents WHERE doc_id IS NOT NULL AND active ORDER BY modified_at DESC NULLS LAST, doc_id LIMIT 50),
      k AS (SELECT doc, key, list('"' || text_value || '"' ORDER BY ordinal) AS v FROM e WHERE value_type = 'string' GROUP BY doc, key),
      o AS (SELECT doc, '{' || string_agg('"' || key || '":' || CASE WHEN len(v) = 1 THEN v[1] ELSE '[' || array_to_string(v, ',') || ']' END, ',' ORDER BY key) || '}' AS metadata FROM k GROUP BY doc)
      SELECT top.doc, metadata FROM top LEFT JOIN o ON top.doc = o.doc""",
    "embedding_groups": f"SELECT model, fingerprint, count(DISTINCT hash) AS docs, count(*) AS chunks FROM ({_VEC}) GROUP BY model, fingerprint",
    "vector_occupancy": "WITH f AS (SELECT count(*) AS n FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL GROUP BY source) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS chunks, CAST(ceil(sum(n) / 64) AS BIGINT) AS needed, ceil(sum(n) / 64) / count(*) AS occupancy, ceil(sum(n) / 64) / count(*) < 0.9 AS repack FROM f",
    "cleaned_tables": f"""WITH c AS (SELECT hash FROM content WHERE hash IS NOT NULL UNION SELECT hash FROM documents WHERE doc_id IS NOT NULL AND hash IS NOT NULL)
      SELECT 'content' AS kind, count(*) AS rows FROM c WHERE hash IN (SELECT hash FROM documents WHERE doc_id IS NOT NULL AND hash IS NOT NULL)
      UNION ALL SELECT 'documents', count(*) FROM documents WHERE doc_id IS NOT NULL AND active
      UNION ALL SELECT 'vectors', count(*) FROM ({_VEC}) WHERE hash IN (SELECT hash FROM documents WHERE doc_id IS NOT NULL AND active AND hash IS NOT NULL)""",
    "without_collection": "SELECT count(*) AS documents, count(DISTINCT hash) AS contents FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND source <> 'handbook'",
    "cleared_vectors": f"""WITH x AS (SELECT hash FROM documents WHERE doc_id IS NOT NULL AND active AND hash IS NOT NULL GROUP BY hash HAVING count(DISTINCT source) = 1 AND min(source) = 'handbook')
      SELECT model, count(*) AS vectors FROM ({_VEC}) WHERE hash NOT IN (SELECT hash FROM x) GROUP BY model""",
    "vectors_to_copy": f"""SELECT d.hash, v.seq, 'handbook' AS collection, v.model FROM (SELECT DISTINCT hash FROM documents WHERE doc_id IS NOT NULL AND active AND source = 'handbook' AND hash IS NOT NULL) d
      JOIN (SELECT hash, seq, min(model) AS model FROM ({_VEC}) GROUP BY hash, seq) v ON v.hash = d.hash""",
    "complete_vectors": f"SELECT seq, count(*) AS vectors FROM (SELECT DISTINCT hash, seq FROM ({_VEC})) WHERE substring(hash, 2, 1) NOT IN ('0', '4', '8', 'c') GROUP BY seq",
    "size_labels": """WITH d AS (SELECT doc_id, n_chars AS n, n_chars * 700 AS b, least(modified_at, TIMESTAMP '2031-01-01') AS t FROM documents WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL AND modified_at IS NOT NULL),
      s AS (SELECT *, CAST(epoch(TIMESTAMP '2031-01-01') - floor(epoch(t)) AS BIGINT) AS a FROM d)
      SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0 * 10 + 0.5) / 10) WHEN b < 1073741824 THEN printf('%.1f MB', floor(b / 1048576.0 * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(b / 1073741824.0 * 10 + 0.5) / 10) END AS size,
        CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE (n // 3600) || 'h ' || (n % 3600 // 60) || 'm' END AS span,
        CASE WHEN a < 60 THEN a || 's ago' WHEN a < 3600 THEN (a // 60) || 'm ago' WHEN a < 86400 THEN (a // 3600) || 'h ago' ELSE (a // 86400) || 'd ago' END AS age FROM s""",
    "term_similarity": f"""WITH r AS (SELECT DISTINCT case_id, query, notes FROM eval_deep_research WHERE case_id IS NOT NULL AND query IS NOT NULL AND notes IS NOT NULL),
      t AS (SELECT *, {_TERMS.format("query")} AS a, {_TERMS.format("notes")} AS b FROM r)
      SELECT case_id, query, notes, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 9) END AS similarity FROM t""",
    "canonical_rows": r"""SELECT doc_id, '{"collection":"' || source || '","lang":"' || lang || '","path":"' || path || '"}' AS json FROM documents
      WHERE doc_id IS NOT NULL AND path IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL AND NOT regexp_matches(path, '["\\]')""",
    "golden_expansions": f"""WITH r AS (SELECT DISTINCT record_id, query, output FROM qmd_expansion_locations WHERE record_id IS NOT NULL AND query IS NOT NULL),
      f AS (SELECT query, min(record_id) AS a, max(record_id) AS b FROM r GROUP BY query HAVING min(record_id) <> max(record_id)),
      s AS (SELECT DISTINCT a AS id, x[2] AS t FROM (SELECT f.a, unnest(r.output) AS x FROM f JOIN r ON r.record_id = f.a) WHERE x[2] IS NOT NULL),
      g AS (SELECT DISTINCT a AS id, x[2] AS t FROM (SELECT f.a, unnest(r.output) AS x FROM f JOIN r ON r.record_id = f.b) WHERE x[2] IS NOT NULL),
      j AS (SELECT s.id, s.t, max(CASE WHEN g.t IS NULL THEN 0.0 WHEN len({_WORDS.format("s.t")}) + len({_WORDS.format("g.t")}) = 0 THEN 1.0 ELSE len(list_intersect({_WORDS.format("s.t")}, {_WORDS.format("g.t")})) / (len({_WORDS.format("s.t")}) + len({_WORDS.format("g.t")}) - len(list_intersect({_WORDS.format("s.t")}, {_WORDS.format("g.t")}))) END) AS j FROM s LEFT JOIN g ON s.id = g.id GROUP BY s.id, s.t),
      h AS (SELECT id, CAST(sum(CASE WHEN j >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS said FROM j GROUP BY id), w AS (SELECT id, count(*) AS wanted FROM g GROUP BY id)
      SELECT coalesce(h.id, w.id) AS id, coalesce(hits, 0) AS hits, coalesce(said, 0) AS said, coalesce(wanted, 0) AS wanted FROM h FULL JOIN w ON h.id = w.id""",
    "only_queries": "SELECT record_id FROM (SELECT DISTINCT record_id, query FROM qmd_expansion_locations WHERE record_id IS NOT NULL AND query IS NOT NULL) WHERE ends_with(record_id, '7')",
}
