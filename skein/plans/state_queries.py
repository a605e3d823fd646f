"""Registered queries of metadata, ingestion, maintenance, metrics and curation, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation, expansion, ingest, maintenance, metadata, metrics
from ..session import broadcast_if_small, materialize
from ..sources.tables import table
from .search_queries import _LINES


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id is not null").withColumnRenamed("source", "collection")


# ---- metadata: typed entries of the columns, the labels (arrays) and the front matter ---------------


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of active documents: lang, n_chars, archived, subjects, and a key of two types."""
    docs = _documents(spark, d).where("active")
    labels = table(spark, d, "subject_labels").where("subject is not null").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("v"))
    none_s, none_n, none_b = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("boolean")

    def rows(key: str, kind: str, value) -> DataFrame:
        cols = {"string": (value, none_n, none_b), "number": (none_s, value.cast("double"), none_b), "boolean": (none_s, none_n, value)}[kind]
        out = docs.where(value.isNotNull()).select(
            F.col("doc_id").alias("doc"), F.lit(key).alias("key"), F.lit(0).alias("ordinal"), F.lit(kind).alias("value_type"),
            cols[0].alias("text_value"), cols[1].alias("number_value"), cols[2].alias("boolean_value"),
        )
        return out

    subjects = docs.select("doc_id").join(labels, "doc_id").select(F.col("doc_id").alias("doc"), F.lit("subject").alias("key"), F.posexplode("v").alias("ordinal", "text_value"))
    subjects = subjects.select("doc", "key", "ordinal", F.lit("string").alias("value_type"), "text_value", none_n.alias("number_value"), none_b.alias("boolean_value"))
    mixed_text = F.when(F.col("collection") == "handbook", F.col("title"))
    mixed_number = F.when(F.col("collection") != "handbook", F.col("n_chars"))
    return (
        rows("lang", "string", F.col("lang"))
        .unionByName(rows("n_chars", "number", F.col("n_chars")))
        .unionByName(rows("archived", "boolean", F.col("path").startswith("Archive/")))
        .unionByName(rows("mixed", "string", mixed_text))
        .unionByName(rows("mixed", "number", mixed_number))
        .unionByName(subjects)
    )


_ENTRIES = """
WITH docs AS (SELECT doc_id AS doc, source AS collection, lang, n_chars, path, title FROM documents WHERE active AND doc_id IS NOT NULL),
subj AS (SELECT doc, unnest(v) AS t, generate_subscripts(v, 1) - 1 AS o FROM (SELECT doc, list_sort(list(DISTINCT subject)) AS v FROM docs JOIN subject_labels ON doc = doc_id WHERE subject IS NOT NULL GROUP BY doc)),
e AS (SELECT doc, 'lang' AS key, 0 AS ordinal, 'string' AS value_type, lang AS text_value, NULL::DOUBLE AS number_value, NULL::BOOLEAN AS boolean_value FROM docs WHERE lang IS NOT NULL
  UNION ALL SELECT doc, 'n_chars', 0, 'number', NULL, n_chars, NULL FROM docs WHERE n_chars IS NOT NULL
  UNION ALL SELECT doc, 'archived', 0, 'boolean', NULL, NULL, starts_with(path, 'Archive/') FROM docs WHERE path IS NOT NULL
  UNION ALL SELECT doc, 'mixed', 0, 'string', title, NULL, NULL FROM docs WHERE collection = 'handbook' AND title IS NOT NULL
  UNION ALL SELECT doc, 'mixed', 0, 'number', NULL, n_chars, NULL FROM docs WHERE collection <> 'handbook' AND n_chars IS NOT NULL
  UNION ALL SELECT doc, 'subject', o, 'string', t, NULL, NULL FROM subj)
"""

FILTERS = {
    "filter_any": {"operator": "eq", "field": "subject", "value": "law"},
    "filter_range": {"operator": "and", "operands": [{"operator": "gte", "field": "n_chars", "value": 1000}, {"operator": "lt", "field": "n_chars", "value": 3000}, {"operator": "eq", "field": "archived", "value": False}]},
    "filter_ne": {"operator": "ne", "field": "subject", "value": "sport"},
    "filter_nin": {"operator": "nin", "field": "lang", "value": ["en", "de"]},
    "filter_all": {"operator": "all", "field": "subject", "value": ["law", "sport"]},
    "filter_not": {"operator": "not", "operand": {"operator": "or", "operands": [{"operator": "exists", "field": "subject", "value": True}, {"operator": "in", "field": "lang", "value": ["en", "fr"]}]}},
    "filter_text": {"operator": "or", "operands": [{"operator": "prefix", "field": "mixed", "value": "r", "caseInsensitive": True}, {"operator": "suffix", "field": "mixed", "value": "Notes"}, {"operator": "contains", "field": "mixed", "value": "BACKGROUND", "caseInsensitive": True}]},
    "filter_type": {"operator": "and", "operands": [{"operator": "type", "field": "mixed", "value": "number"}, {"operator": "gt", "field": "mixed", "value": 2500}]},
}
_FILTER_SQL = {
    "filter_any": "doc IN (SELECT doc FROM e WHERE key = 'subject' AND text_value = 'law')",
    "filter_range": "doc IN (SELECT doc FROM e WHERE key = 'n_chars' AND number_value >= 1000) AND doc IN (SELECT doc FROM e WHERE key = 'n_chars' AND number_value < 3000) AND doc IN (SELECT doc FROM e WHERE key = 'archived' AND NOT boolean_value)",
    "filter_ne": "doc IN (SELECT doc FROM e WHERE key = 'subject') AND doc NOT IN (SELECT doc FROM e WHERE key = 'subject' AND text_value = 'sport')",
    "filter_nin": "doc IN (SELECT doc FROM e WHERE key = 'lang' AND value_type = 'string') AND doc NOT IN (SELECT doc FROM e WHERE key = 'lang' AND text_value IN ('en', 'de'))",
    "filter_all": "doc IN (SELECT doc FROM e WHERE key = 'subject' AND text_value IN ('law', 'sport') GROUP BY doc HAVING count(DISTINCT text_value) = 2)",
    "filter_not": "doc NOT IN (SELECT doc FROM e WHERE key = 'subject' OR key = 'lang' AND text_value IN ('en', 'fr'))",
    "filter_text": "doc IN (SELECT doc FROM e WHERE key = 'mixed' AND (text_value ILIKE 'r%' OR text_value LIKE '%Notes' OR text_value ILIKE '%background%'))",
    "filter_type": "doc IN (SELECT doc FROM e WHERE key = 'mixed' AND value_type = 'number' AND number_value > 2500)",
}


def _filter(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _documents(spark, d).where("active").select(F.col("doc_id").alias("doc"))
        return metadata.filter_documents(docs, _entries(spark, d), FILTERS[name]).select(F.col("doc").alias("doc_id"))

    return run


def _collections(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where("active").select(F.col("doc_id").alias("doc"), "collection")


def metadata_keys(spark: SparkSession, d: str) -> DataFrame:
    return metadata.key_window(_entries(spark, d), 3, 1).where("in_page").drop("in_page")


def metadata_types(spark: SparkSession, d: str) -> DataFrame:
    t = metadata.type_stats(_entries(spark, d), _collections(spark, d))
    return t.select("key", "value_type", "documents", "multi_valued", F.array_join("collections", ",").alias("collections"))


def metadata_ranges(spark: SparkSession, d: str) -> DataFrame:
    return metadata.number_ranges(_entries(spark, d))


def metadata_values(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).where("value_type = 'string'")
    return metadata.value_counts(e, 5, 1, 2)


def metadata_summaries(spark: SparkSession, d: str) -> DataFrame:
    return metadata.collection_summaries(_entries(spark, d), _collections(spark, d), 3)


def metadata_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return metadata.type_conflicts(_entries(spark, d)).select("key", F.array_join("types", ",").alias("types"))


def metadata_matches(spark: SparkSession, d: str) -> DataFrame:
    """Entries that satisfy a predicate over single entries."""
    node = metadata.parse_filter(
        {"operator": "or", "operands": [{"operator": "and", "operands": [{"operator": "eq", "field": "key", "value": "subject"}, {"operator": "prefix", "field": "value", "value": "s"}]}, {"operator": "gt", "field": "value", "value": 9000}]},
        entry=True,
    )
    hit = _entries(spark, d).where(metadata.entry_column(node))
    return hit.select(F.col("doc").alias("doc_id"), "key", "value_type", F.coalesce("text_value", F.col("number_value").cast("long").cast("string")).alias("value"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Typed entries of the documents' front matter."""
    e = metadata.explode_entries(metadata.extract_metadata(_documents(spark, d), "doc_id", "text", "path"))
    return e.select(F.col("doc").alias("doc_id"), "key", "value_type", F.coalesce("text_value", F.col("number_value").cast("long").cast("string"), F.col("boolean_value").cast("string")).alias("value"))


_FRONT = r"""
WITH f AS (SELECT doc_id, regexp_extract(text, '^\x{FEFF}?---[ \t]*\r?\n((?s:.*?))(?:^|\n)(?:---|\.\.\.)[ \t]*(?:\r?\n|$)', 1) AS b FROM documents
  WHERE doc_id IS NOT NULL AND regexp_matches(lower(path), '\.(md|markdown|mdx)$') AND contains(substring(text, 1, 8), '---'))
"""

# ---- ingestion -----------------------------------------------------------------------------------


def _scan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A scan (active documents with a text, by change time) against a manifest (documents indexed before 1 May 2030)."""
    docs = _documents(spark, d).where("path is not null")
    scan = docs.where("active and hash is not null").select("collection", "path", F.col("modified_at").alias("mtime"), F.col("n_chars").alias("size"), "hash")
    old = docs.where("hash is not null and indexed_at < timestamp'2030-05-01 00:00:00'").select("collection", "path", F.when(F.col("modified_at") < F.timestamp_seconds(F.lit(1896134400)), F.col("modified_at")).otherwise(F.col("created_at")).alias("mtime"), F.col("n_chars").alias("size"), "hash")
    return scan, old


def scan_changes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.classify(*_scan(spark, d))


def gated_files(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).select("doc_id", F.col("text").alias("body"), F.octet_length("text").alias("size"))
    return ingest.gate(docs, limit=8000).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def stored_content(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of the documents that the content table lacks."""
    incoming = table(spark, d, "documents").select("hash", F.col("text").alias("doc"), "created_at")
    return ingest.new_content(table(spark, d, "content"), incoming).select("hash", F.length("doc").alias("n_chars"), "created_at")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Documents after an upsert of those changed since 1 March 2030 into the older ones."""
    docs = _documents(spark, d).where("path is not null").select("collection", "path", "title", "hash", "created_at", "modified_at", "active")
    out = ingest.upsert_documents(docs.where("modified_at < timestamp'2030-06-01 00:00:00'"), docs.where("modified_at >= timestamp'2030-03-01 00:00:00'"))
    return out.select("collection", "path", "hash", "active", "modified_at")


def unseen_inactive(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).where("path is not null").select("collection", "path", "active", "n_chars")
    seen = docs.where("n_chars > 500").select("collection", "path")
    return ingest.deactivate_unseen(docs, seen, "handbook").groupBy("collection").agg(F.count_if("active").alias("active"), F.count(F.lit(1)).alias("documents"))


def streamed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The documents table read as a stream of files and kept as latest rows per path."""
    from ..streaming.incremental import latest_from_stream

    return latest_from_stream(spark, f"{d}/documents.parquet", ["source", "path"], "modified_at", ["hash", "active"])


# ---- maintenance ------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vector rows of the content whose document id is a vector id; content of label 0 lacks one chunk."""
    docs = _documents(spark, d).where("hash is not null").select("doc_id", "hash")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    m = docs.join(e, "doc_id").groupBy("hash").agg(F.min("label").alias("label"))
    return m.select("hash", F.lit(0).alias("seq"), F.when(F.col("label") == 0, 2).otherwise(1).alias("total_chunks"))


_VECTORS = "v AS (SELECT hash, 0 AS seq, CASE WHEN min(label) = 0 THEN 2 ELSE 1 END AS total_chunks FROM documents JOIN embeddings ON doc_id = vec_id WHERE hash IS NOT NULL GROUP BY hash)"


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.collection_stats(_documents(spark, d))


def pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.pending_embeddings(_documents(spark, d), _vectors(spark, d)).select("hash", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def missing_vector_rows(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that active collections lack if only the handbook had them."""
    docs, vec = _documents(spark, d), _vectors(spark, d)
    have = maintenance.vector_rows(vec, docs.where("collection = 'handbook'"))
    return maintenance.missing_rows(vec, docs, have)


def cleanup_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    content = table(spark, d, "content").select("hash").where("hash is not null").distinct()
    return maintenance.cleanup_preview(content, docs, _vectors(spark, d))


def orphan_difference(spark: SparkSession, d: str) -> DataFrame:
    """Content held by inactive documents only: orphaned for the status, not for the clean-up."""
    docs = _documents(spark, d)
    content = docs.select("hash").where("hash is not null").distinct()
    kept = maintenance.orphaned_content(content, docs, keep_inactive=True)
    return maintenance.orphaned_content(content, docs, keep_inactive=False).join(kept, "hash", "left_anti")


def exclusive_content(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.exclusive_hashes(_documents(spark, d), "handbook")


def index_health(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.health(_documents(spark, d), _vectors(spark, d), F.lit("2031-12-31 00:00:00").cast("timestamp"))


def newest_results(spark: SparkSession, d: str) -> DataFrame:
    """The newest thousand bodies, as the cache keeps them."""
    c = table(spark, d, "documents").where("hash is not null").groupBy("hash").agg(F.max("created_at").alias("created_at"))
    return maintenance.keep_newest(c)


def top_folders(spark: SparkSession, d: str) -> DataFrame:
    ctx = spark.createDataFrame([("handbook", "/notes/", "n"), ("vault-crovivi", "", "all")], "collection string, prefix string, text string")
    return maintenance.without_context(_documents(spark, d).where("path is not null"), F.broadcast(ctx))


def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.fingerprint(_documents(spark, d), ["doc_id", "collection", "path", "hash", "active"])


def embedding_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of at most 64 documents and 64 KB, per language."""
    docs = _documents(spark, d).where("active and text is not null and lang is not null").select("doc_id", "lang", F.octet_length("text").cast("long").alias("bytes"))
    b = maintenance.batches(docs, "doc_id", "bytes", ["lang"], 64, 64 << 10)
    return b.groupBy("lang", "block", "batch").agg(F.count(F.lit(1)).alias("documents"))


# ---- metrics over judgements ---------------------------------------------------------------------------


def _rankings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rankings by digest of all judged documents of a query, and the relevant ones."""
    q = table(spark, d, "qrels").where("query_id is not null and corpus_id is not null")
    qid = F.concat_ws("|", "split", F.coalesce("source_id", F.lit("")), "query_id")
    pairs = q.select(qid.alias("qid"), F.col("corpus_id").alias("doc"), "score").groupBy("qid", "doc").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.sha2("doc", 256), "doc")))
    return ranked.select("qid", "rank", "doc"), pairs.where("score >= 1").select("qid", "doc")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.query_metrics(*_rankings(spark, d))
    return m.select("qid", *[F.round(c, 9).alias(c) for c in m.columns if c != "qid"])


def macro_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.query_metrics(*_rankings(spark, d)).withColumn("split", F.element_at(F.split("qid", r"\|"), 1))
    out = metrics.macro(m, ["split"])
    return out.select("split", "queries", *[F.round(c, 9).alias(c) for c in ("precision_10", "recall", "recall_1", "recall_5", "mrr_10", "f1", "ndcg_10")])


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean difference of recall at 1 and at 3 (no SQL twin: resampling)."""
    m = metrics.query_metrics(*_rankings(spark, d))
    return metrics.paired_bootstrap(m.select("qid", F.element_at(F.split("qid", r"\|"), 1).alias("source"), (F.col("recall_3") - F.col("recall_1")).alias("delta")), 2000)


def hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of evaluation cases whose expected document is among the first of its difficulty's list."""
    e = table(spark, d, "eval_deep_research").where("case_id is not null and expected_doc is not null and difficulty is not null").select("case_id", "expected_doc", "difficulty").distinct()
    docs = e.groupBy("difficulty", "expected_doc").agg(F.count(F.lit(1)).alias("n"))
    lists = docs.withColumn("rank", F.row_number().over(W.partitionBy("difficulty").orderBy(F.desc("n"), "expected_doc")))
    ranking = e.join(lists, ["difficulty", "expected_doc"]).select(F.col("case_id").alias("qid"), "rank", F.col("expected_doc").alias("doc"))
    m = metrics.hit_rates(ranking, e.select(F.col("case_id").alias("qid"), F.col("expected_doc").alias("doc"), "difficulty"))
    return m.select("difficulty", "queries", *[F.round(c, 9).alias(c) for c in ("hit_1", "hit_3", "hit_5")])


_METRICS = """
WITH q AS (SELECT split || '|' || coalesce(source_id, '') || '|' || query_id AS qid, corpus_id AS doc, max(score) AS score FROM qrels WHERE query_id IS NOT NULL AND corpus_id IS NOT NULL GROUP BY ALL),
r AS (SELECT qid, doc, coalesce(score, 0) >= 1 AS rel, row_number() OVER (PARTITION BY qid ORDER BY sha256(doc), doc) AS rank FROM q),
a AS (SELECT qid, count(*) FILTER (rel) AS e, count(*) FILTER (rel AND rank <= 10) AS hk, min(rank) FILTER (rel) AS f, sum(CASE WHEN rel AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg,
  count(*) FILTER (rel AND rank <= 1) AS h1, count(*) FILTER (rel AND rank <= 3) AS h3, count(*) FILTER (rel AND rank <= 5) AS h5, count(*) FILTER (rel AND rank <= 20) AS h20, count(*) FILTER (rel AND rank <= 30) AS h30 FROM r GROUP BY qid HAVING count(*) FILTER (rel) > 0),
m AS (SELECT qid, hk / least(10, e) AS precision_10, 1.0::DOUBLE AS recall, h1 / e AS recall_1, h3 / e AS recall_3, h5 / e AS recall_5, hk / e AS recall_10, h20 / e AS recall_20, h30 / e AS recall_30,
  1 / f AS mrr, CASE WHEN f <= 10 THEN 1 / f ELSE 0 END AS mrr_10, 2 * (hk / least(10, e)) / ((hk / least(10, e)) + 1) AS f1, dcg / list_sum(list_transform(range(1, least(e, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_10 FROM a)
"""

# ---- curation ------------------------------------------------------------------------------------------


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate training queries, over distinct normalised texts."""
    p = curation.near_pairs(curation.distinct_queries(table(spark, d, "qmd_expansion_locations"), "query"))
    return p.select("a", "b", F.round("by_words", 9).alias("by_words"), F.round("by_grams", 9).alias("by_grams"))


def leaked_queries(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicates of evaluation queries among the training queries."""
    p = curation.near_pairs(curation.distinct_queries(table(spark, d, "qmd_expansion_locations"), "query"), curation.distinct_queries(table(spark, d, "eval_deep_research"), "query"))
    return p.select(F.col("a").alias("train"), F.col("b").alias("eval"), F.round("by_words", 9).alias("by_words"), F.round("by_grams", 9).alias("by_grams"))


def query_families(spark: SparkSession, d: str) -> DataFrame:
    """Family of each training record: near-duplicate queries and shared judged documents (no SQL twin: iterative)."""
    rows = table(spark, d, "qmd_expansion_locations").where("record_id is not null")
    judged = curation.binary_judgements(table(spark, d, "qrels")).withColumnRenamed("query_id", "record_id")
    judged = materialize(judged, "judged")
    both = ["record_id", "source_id"]
    named = rows.select(*both).join(broadcast_if_small(materialize(judged.select(*both).distinct(), "judged")), both, "left_semi").distinct()
    judged = named.join(judged, both)
    f = curation.query_families(
        rows.select(F.col("record_id").alias("id"), F.col("query").alias("text")), judged.select(F.col("record_id").alias("id"), F.concat_ws("\u0002", "source_id", "corpus_id").alias("doc"))
    )
    return f.select(F.col("id").alias("record_id"), "query", "family")


def family_splits(spark: SparkSession, d: str) -> DataFrame:
    """Whole collections dealt to splits, largest first, each to the one that lacks most rows."""
    fam = _documents(spark, d).where("collection is not null").groupBy(F.col("collection").alias("family")).agg(F.count(F.lit(1)).alias("size"))
    return curation.split_families(fam, "7")


def query_family_splits(spark: SparkSession, d: str) -> DataFrame:
    """Whole query families dealt to splits, each to the one that lacks most records (no SQL twin: sequential)."""
    fam = query_families(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    return curation.split_families(fam, "7")


def content_copies(spark: SparkSession, d: str) -> DataFrame:
    """Copies of equal content: the smallest document id and the number of copies."""
    docs = _documents(spark, d).where("text is not null and text <> ''")
    g = docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return g.where("copies > 1")


def resolved_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Judged query ids with the first split of test, dev and train that has them."""
    q = table(spark, d, "qrels").where("query_id is not null").select("source_id", "query_id", "split").distinct().withColumn("key", F.concat_ws("|", "source_id", "query_id"))
    return curation.resolve_collisions(q, "key", "split").select("key", "split")


def exact_overlap(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "qmd_expansion_locations").select("record_id", "query").distinct()
    return curation.exact_overlap(train, table(spark, d, "eval_deep_research"), "query").select("record_id")


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents of each language with the smallest seeded digests."""
    docs = _documents(spark, d).where("lang is not null").select("doc_id", "lang")
    return curation.top_by_hash(docs, "doc_id", "seed-1", 50, "lang")


def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """A random sample of a hundred documents (no SQL twin: random)."""
    return _documents(spark, d).select("doc_id").orderBy(F.rand(5)).limit(100)


def _distilled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "distill_records").where("input_id is not null").select("input_id", "qid", "source_id", "selection_status", "query", "sample_key").distinct()
    return rows.groupBy("input_id").agg(F.max(F.struct("sample_key", "qid", "source_id", "selection_status", "query")).alias("r")).select("input_id", "r.*")


_DISTILLED = """WITH x AS (SELECT input_id, unnest(max(struct_pack(a := coalesce(sample_key, ''), b := coalesce(qid, ''), c := coalesce(source_id, ''), d := coalesce(selection_status, ''), e := coalesce(query, '')))) FROM distill_records WHERE input_id IS NOT NULL GROUP BY input_id),
x2 AS (SELECT input_id, nullif(a, '') AS sample_key, nullif(b, '') AS qid, nullif(c, '') AS source_id, nullif(d, '') AS selection_status, nullif(e, '') AS query FROM x)"""


def quota_table(spark: SparkSession, d: str) -> DataFrame:
    """Largest-remainder quotas of a thousand rows over source and status."""
    strata = _distilled(spark, d).where("source_id is not null and selection_status is not null").groupBy("source_id", "selection_status").agg(F.count(F.lit(1)).alias("n"))
    return curation.largest_remainder(strata, 500)


def stratified_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = _distilled(spark, d).where("source_id is not null and selection_status is not null")
    out = curation.stratified(rows, ["source_id", "selection_status"], 500, ["sample_key", "qid", "input_id"])
    return out.select("input_id", "source_id", "selection_status")


def main_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = _distilled(spark, d).where("query is not null and source_id is not null")
    return curation.main_pool(rows, "query", "source_id", "sample_key", "input_id", 40).select("input_id", "source_id")


def balanced_pool(spark: SparkSession, d: str) -> DataFrame:
    """As many documents of each language as of the rarest one."""
    docs = _documents(spark, d).where("lang is not null").select("doc_id", "lang")
    return curation.balanced_pool(docs, "lang", "doc_id", "seed-2")


def conflict_ledger(spark: SparkSession, d: str) -> DataFrame:
    """How the outputs of equal inputs relate."""
    rows = table(spark, d, "query_expansion_contract_v1").where("input_key is not null").dropDuplicates(["record_id"])
    canonical = F.nullif(F.array_join(F.array_sort(F.transform(expansion.usable(expansion.parsed_lines(F.col("raw_model_output"))), lambda e: F.concat(e["kind"], F.lit(": "), F.lower(e["text"])))), "\n"), F.lit(""))
    return curation.conflict_ledger(rows, "input_key", F.coalesce("raw_model_output", F.lit("")), canonical)


def length_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).where("lang is not null")
    return curation.length_stats(docs, F.length("text"), ["lang"])


def query_usage(spark: SparkSession, d: str) -> DataFrame:
    """Sources in which each training query occurs."""
    u = curation.usage_map(table(spark, d, "qmd_expansion_locations"), "query", "source_id")
    return u.select("text", F.array_join("labels", ",").alias("sources"))


def judged_pairs(spark: SparkSession, d: str) -> DataFrame:
    return curation.binary_judgements(table(spark, d, "qrels"))


def judgement_audit(spark: SparkSession, d: str) -> DataFrame:
    return curation.judgement_audit(table(spark, d, "qrels"))


def negation_lost(spark: SparkSession, d: str) -> DataFrame:
    """Entries of all expansion tables that do not negate although their query does."""
    found = None
    for name in ("qmd_expansion_locations", "qmd_expansion_personal_entities", "qmd_expansion_sports", "query_expansion_contract_v1"):
        rows = table(spark, d, name).where("record_id is not null").where(F.lower("query").rlike(curation.NEGATION))
        if name == "query_expansion_contract_v1":
            texts = F.transform(expansion.usable(expansion.parsed_lines(F.col("raw_model_output"))), lambda e: e["text"])
        else:
            texts = F.transform(F.filter("output", lambda e: e.isNotNull()), lambda e: F.get(e, F.lit(1)))
        rows = rows.select(F.lit(name).alias("table_name"), F.col("record_id").cast("string").alias("record_id"), "query", F.explode(texts).alias("text"))
        part = rows.where("text is not null").where(curation.lost_negation(F.col("query"), F.col("text"))).select("table_name", "record_id", "text").distinct()
        found = part if found is None else found.unionByName(part)
    return found


def normal_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Training outputs as ordered lines."""
    rows = table(spark, d, "qmd_expansion_locations").where("record_id is not null").select("record_id", "output").distinct()
    return rows.select("record_id", expansion.normal_output(F.col("output")).alias("lines"))


def rendered_documents(spark: SparkSession, d: str) -> DataFrame:
    """Digests of documents rendered with their title, or with their id and fenced where they hold code."""
    docs = _documents(spark, d).where("text is not null")
    code = F.col("text").contains("```")
    heading = F.when(code, F.col("doc_id").cast("string")).otherwise(F.coalesce("title", F.lit("")))
    return docs.select("doc_id", F.sha2(curation.render_document(heading, F.col("text"), code), 256).alias("digest"))


def query_categories(spark: SparkSession, d: str) -> DataFrame:
    """Training queries by category and length."""
    rows = table(spark, d, "qmd_expansion_locations").select("record_id", "query").distinct().where("query is not null")
    words = F.size(F.filter(F.split("query", r"\s+"), lambda w: w != ""))
    size = F.when(words <= 2, "short").when(words <= 5, "medium").otherwise("long")
    return rows.groupBy(curation.query_category(F.col("query")).alias("category"), size.alias("size")).agg(F.count(F.lit(1)).alias("n"))


def intent_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the stated intents."""
    rows = table(spark, d, "qmd_expansion_locations").where("intent is not null").select(F.explode(T.intent_terms(F.col("intent"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_NORM = r"trim(regexp_replace(regexp_replace(lower(query), '/only:\S*', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))"
_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda i: substring({0}, i, 3)))"


def _jac(x: str, y: str) -> str:
    return f"(len(list_intersect({x}, {y})) / (len({x}) + len({y}) - len(list_intersect({x}, {y}))))"


_NEAR = f"""
p AS (SELECT l.t AS a, r.t AS b, {_jac('l.w', 'r.w')} AS by_words, {_jac('l.g', 'r.g')} AS by_grams FROM l JOIN r ON {{0}})
SELECT a AS {{1}}, b AS {{2}}, round(by_words, 9) AS by_words, round(by_grams, 9) AS by_grams FROM p WHERE by_words >= {curation.WORDS} OR by_grams >= {curation.GRAMS}"""


def _side(name: str, source: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT t, {_WORDS.format('t')} AS w, {_GRAMS.format('t')} AS g FROM (SELECT DISTINCT {_NORM} AS t FROM {source}) WHERE t <> '')"


QUERIES = {n: _filter(n) for n in FILTERS}
QUERIES |= {
    f.__name__: f
    for f in (
        metadata_keys, metadata_types, metadata_ranges, metadata_values, metadata_summaries, metadata_conflicts, metadata_matches, front_matter, scan_changes, gated_files, stored_content,
        upserted, unseen_inactive, streamed_upsert, collection_stats, pending_embeddings, missing_vector_rows, cleanup_counts, orphan_difference, exclusive_content, index_health, newest_results,
        top_folders, table_fingerprint, embedding_batches, retrieval_metrics, macro_metrics, bootstrap_interval, hit_rates, near_duplicates, leaked_queries, query_families, family_splits, query_family_splits,
        content_copies, resolved_collisions, exact_overlap, hash_sample, random_sample, quota_table, stratified_selection, main_pool, balanced_pool, conflict_ledger, length_statistics,
        query_usage, judged_pairs, judgement_audit, negation_lost, normal_outputs, rendered_documents, query_categories, intent_terms,
    )
}

_D = "FROM documents WHERE doc_id IS NOT NULL"
SQL = {n: _ENTRIES + f"SELECT doc AS doc_id FROM docs WHERE {w}" for n, w in _FILTER_SQL.items()}
SQL |= {
    "metadata_keys": _ENTRIES + "SELECT * FROM (SELECT key, count(DISTINCT doc) AS documents, row_number() OVER (ORDER BY count(DISTINCT doc) DESC, key) AS position, count(*) OVER () AS total_keys FROM e GROUP BY key) WHERE position > 1 AND position <= 4",
    "metadata_types": _ENTRIES + "SELECT key, value_type, count(DISTINCT doc) AS documents, max(ordinal) > 0 AS multi_valued, array_to_string(list_sort(list(DISTINCT collection)), ',') AS collections FROM e JOIN docs USING (doc) GROUP BY key, value_type",
    "metadata_ranges": _ENTRIES + "SELECT key, min(number_value) AS low, quantile_cont(number_value, 0.5) AS median, max(number_value) AS high FROM e WHERE value_type = 'number' GROUP BY key",
    "metadata_values": _ENTRIES
    + """SELECT *, position > 1 AND position <= 6 AS in_page FROM (SELECT key, value_type, text_value AS value, count(DISTINCT doc) AS documents, row_number() OVER (PARTITION BY key, value_type ORDER BY count(DISTINCT doc) DESC, text_value) AS position,
      count(*) OVER (PARTITION BY key, value_type) AS distinct_values FROM e WHERE value_type = 'string' GROUP BY key, value_type, text_value HAVING count(DISTINCT doc) >= 2) WHERE position <= 6""",
    "metadata_summaries": _ENTRIES
    + """SELECT * FROM (SELECT collection, key, count(*) AS documents, count(*) OVER (PARTITION BY collection) AS total_keys, row_number() OVER (PARTITION BY collection ORDER BY count(*) DESC, key) AS position
      FROM e JOIN docs USING (doc) WHERE ordinal = 0 GROUP BY collection, key) WHERE position <= 3""",
    "metadata_conflicts": _ENTRIES + "SELECT key, array_to_string(list_sort(list(DISTINCT value_type)), ',') AS types FROM e GROUP BY key HAVING count(DISTINCT value_type) > 1",
    "metadata_matches": _ENTRIES + "SELECT doc AS doc_id, key, value_type, coalesce(text_value, CAST(CAST(number_value AS BIGINT) AS VARCHAR)) AS value FROM e WHERE key = 'subject' AND starts_with(text_value, 's') OR number_value > 9000",
    "scan_changes": """WITH d AS (SELECT source AS collection, * EXCLUDE (source) FROM documents WHERE doc_id IS NOT NULL AND path IS NOT NULL AND hash IS NOT NULL),
      s AS (SELECT collection, path, modified_at AS mtime, n_chars AS size, hash FROM d WHERE active), m AS (SELECT collection, path, CASE WHEN modified_at < to_timestamp(1896134400) THEN modified_at ELSE created_at END AS mtime, n_chars AS size, hash FROM d WHERE indexed_at < TIMESTAMP '2030-05-01 00:00:00')
      SELECT collection, path, CASE WHEN m.hash IS NULL THEN 'new' WHEN s.hash IS NULL THEN 'removed' WHEN s.mtime = m.mtime AND s.size = m.size THEN 'unchanged' WHEN s.hash = m.hash THEN 'touched' ELSE 'updated' END AS change
      FROM s FULL JOIN m USING (collection, path)""",
    "gated_files": r"SELECT CASE WHEN strlen(text) > 8000 THEN 'too_large' WHEN text IS NULL OR NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN 'empty' ELSE 'ok' END AS verdict, count(*) AS n " + _D + " GROUP BY 1",
    "stored_content": "SELECT hash, length(any_value(text)) AS n_chars, min(created_at) AS created_at FROM documents WHERE hash IS NOT NULL AND hash NOT IN (SELECT hash FROM content WHERE hash IS NOT NULL) GROUP BY hash",
    "upserted": """SELECT source AS collection, path, hash, modified_at >= TIMESTAMP '2030-03-01 00:00:00' OR active AS active, modified_at FROM documents WHERE doc_id IS NOT NULL AND path IS NOT NULL AND modified_at IS NOT NULL""",
    "unseen_inactive": "SELECT source AS collection, count(*) FILTER (active AND (source <> 'handbook' OR coalesce(n_chars, 0) > 500)) AS active, count(*) AS documents " + _D + " AND path IS NOT NULL GROUP BY source",
    "streamed_upsert": "SELECT source, path, hash, active, modified_at FROM (SELECT *, row_number() OVER (PARTITION BY source, path ORDER BY modified_at DESC NULLS LAST) AS n FROM documents WHERE source IS NOT NULL AND path IS NOT NULL) WHERE n = 1",
    "collection_stats": "SELECT source AS collection, count(*) AS documents, count(*) FILTER (active) AS active, max(modified_at) FILTER (active) AS last_modified " + _D + " GROUP BY source",
    "pending_embeddings": f"WITH {_VECTORS}, c AS (SELECT hash, count(DISTINCT seq) AS n, max(total_chunks) AS t FROM v GROUP BY hash) SELECT d.hash, coalesce(n, 0) AS chunks FROM (SELECT DISTINCT hash FROM documents WHERE active AND hash IS NOT NULL AND doc_id IS NOT NULL) d LEFT JOIN c USING (hash) WHERE n IS NULL OR n < t",
    "missing_vector_rows": f"WITH {_VECTORS}, r AS (SELECT DISTINCT hash, seq, source AS collection FROM v JOIN documents USING (hash) WHERE active) SELECT hash, seq, collection FROM r WHERE (hash, seq, collection) NOT IN (SELECT (hash, seq, collection) FROM r WHERE collection = 'handbook')".replace("(hash, seq, collection) NOT IN (SELECT (hash, seq, collection) FROM r WHERE collection = 'handbook')", "collection <> 'handbook'"),
    "cleanup_counts": f"""WITH {_VECTORS} SELECT 'inactive_documents' AS kind, count(*) AS rows FROM documents WHERE doc_id IS NOT NULL AND NOT active
      UNION ALL SELECT 'orphaned_content', count(DISTINCT hash) FROM content WHERE hash NOT IN (SELECT hash FROM documents WHERE hash IS NOT NULL)
      UNION ALL SELECT 'orphaned_vectors', count(*) FROM v WHERE hash NOT IN (SELECT hash FROM documents WHERE active AND hash IS NOT NULL)""",
    "orphan_difference": "SELECT DISTINCT hash FROM documents WHERE hash IS NOT NULL AND hash NOT IN (SELECT hash FROM documents WHERE active AND hash IS NOT NULL)",
    "exclusive_content": "SELECT hash FROM documents WHERE active AND hash IS NOT NULL AND doc_id IS NOT NULL GROUP BY hash HAVING count(DISTINCT source) = 1 AND min(source) = 'handbook'",
    "index_health": f"""WITH {_VECTORS}, c AS (SELECT hash, count(DISTINCT seq) AS n, max(total_chunks) AS t FROM v GROUP BY hash), d AS (SELECT * FROM documents WHERE active AND doc_id IS NOT NULL),
      b AS (SELECT count(*) AS documents, max(modified_at) AS last FROM d), p AS (SELECT count(*) AS pending FROM (SELECT DISTINCT hash FROM d WHERE hash IS NOT NULL) LEFT JOIN c USING (hash) WHERE n IS NULL OR n < t),
      x AS (SELECT documents, pending, CAST(floor((epoch(TIMESTAMPTZ '2031-12-31 00:00:00+00') - floor(epoch(last))) / 86400) AS BIGINT) AS days_stale FROM b, p)
      SELECT documents, pending, days_stale, pending >= 0.1 * documents AS warn_pending, days_stale >= 14 AS warn_stale FROM x""",
    "newest_results": "SELECT hash, max(created_at) AS created_at FROM documents WHERE hash IS NOT NULL GROUP BY hash ORDER BY 2 DESC, hash LIMIT 1000",
    "top_folders": "SELECT DISTINCT source AS collection, string_split(path, '/')[1] AS top FROM documents WHERE active AND doc_id IS NOT NULL AND path IS NOT NULL AND source <> 'vault-crovivi' AND NOT (source = 'handbook' AND string_split(path, '/')[1] = 'notes')",
    "embedding_batches": """WITH RECURSIVE t AS (SELECT lang, CAST(floor(doc_id / 65536) AS BIGINT) AS block, CAST(strlen(text) AS BIGINT) AS b, row_number() OVER (PARTITION BY lang, floor(doc_id / 65536) ORDER BY doc_id) AS n
        FROM documents WHERE active AND doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL),
      g AS (SELECT lang, block, n, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS k, b AS used FROM t WHERE n = 1
        UNION ALL SELECT t.lang, t.block, t.n, CASE WHEN g.k >= 64 OR g.used + t.b > 65536 THEN g.batch + 1 ELSE g.batch END,
          CASE WHEN g.k >= 64 OR g.used + t.b > 65536 THEN 1 ELSE g.k + 1 END, CASE WHEN g.k >= 64 OR g.used + t.b > 65536 THEN t.b ELSE g.used + t.b END
        FROM g JOIN t ON t.lang = g.lang AND t.block = g.block AND t.n = g.n + 1)
      SELECT lang, block, batch, count(*) AS documents FROM g GROUP BY lang, block, batch""",
    "retrieval_metrics": _METRICS + "SELECT qid, round(precision_10, 9) AS precision_10, round(recall, 9) AS recall, round(recall_1, 9) AS recall_1, round(recall_3, 9) AS recall_3, round(recall_5, 9) AS recall_5, round(recall_10, 9) AS recall_10, round(recall_20, 9) AS recall_20, round(recall_30, 9) AS recall_30, round(mrr, 9) AS mrr, round(mrr_10, 9) AS mrr_10, round(f1, 9) AS f1, round(ndcg_10, 9) AS ndcg_10 FROM m",
    "macro_metrics": _METRICS + "SELECT string_split(qid, '|')[1] AS split, count(*) AS queries, round(avg(precision_10), 9) AS precision_10, round(avg(recall), 9) AS recall, round(avg(recall_1), 9) AS recall_1, round(avg(recall_5), 9) AS recall_5, round(avg(mrr_10), 9) AS mrr_10, round(avg(f1), 9) AS f1, round(avg(ndcg_10), 9) AS ndcg_10 FROM m GROUP BY 1",
    "hit_rates": """WITH e AS (SELECT DISTINCT case_id, expected_doc, difficulty FROM eval_deep_research WHERE case_id IS NOT NULL AND expected_doc IS NOT NULL AND difficulty IS NOT NULL),
      l AS (SELECT difficulty, expected_doc, row_number() OVER (PARTITION BY difficulty ORDER BY n DESC, expected_doc) AS rank FROM (SELECT difficulty, expected_doc, count(*) AS n FROM e GROUP BY difficulty, expected_doc)),
      j AS (SELECT difficulty, case_id, min(rank) AS rank FROM e JOIN l USING (difficulty, expected_doc) GROUP BY difficulty, case_id)
      SELECT difficulty, count(*) AS queries, round(avg(CAST(rank <= 1 AS DOUBLE)), 9) AS hit_1, round(avg(CAST(rank <= 3 AS DOUBLE)), 9) AS hit_3, round(avg(CAST(rank <= 5 AS DOUBLE)), 9) AS hit_5 FROM j GROUP BY 1""",
    "near_duplicates": f"WITH {_side('l', 'qmd_expansion_locations')}, r AS (SELECT * FROM l), " + _NEAR.format("l.t < r.t", "a", "b"),
    "leaked_queries": f"WITH {_side('l', 'qmd_expansion_locations')}, {_side('r', 'eval_deep_research')}, " + _NEAR.format("true", '"train"', "eval"),
    "content_copies": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies " + _D + " AND text IS NOT NULL AND text <> '' GROUP BY 1 HAVING count(*) > 1",
    "resolved_collisions": """SELECT key, split FROM (SELECT *, rank() OVER (PARTITION BY key ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'dev' THEN 1 WHEN 'train' THEN 2 ELSE 3 END) AS r FROM
      (SELECT DISTINCT concat_ws('|', source_id, query_id) AS key, source_id, query_id, split FROM qrels WHERE query_id IS NOT NULL)) WHERE r = 1""",
    "exact_overlap": f"SELECT record_id FROM (SELECT DISTINCT record_id, query FROM qmd_expansion_locations) WHERE {_NORM} IN (SELECT {_NORM} FROM eval_deep_research WHERE query IS NOT NULL) AND {_NORM} <> ''",
    "hash_sample": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('' || chr(0) || 'seed-1' || chr(0) || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL) WHERE n <= 50",
    "balanced_pool": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('' || chr(0) || 'seed-2' || chr(0) || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL) WHERE n <= (SELECT min(c) FROM (SELECT count(*) AS c FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL GROUP BY lang))",
    "quota_table": _DISTILLED
    + """, s AS (SELECT source_id, selection_status, count(*) AS n FROM x2 WHERE source_id IS NOT NULL AND selection_status IS NOT NULL GROUP BY ALL), q AS (SELECT *, n * 500.0::DOUBLE / sum(n) OVER () AS x FROM s),
      f AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 12) DESC, source_id, selection_status) AS k, 500 - sum(floor(x)) OVER () AS rest FROM q)
      SELECT source_id, selection_status, n, CAST(least(n, floor(x) + CASE WHEN k <= rest THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM f""",
    "stratified_selection": _DISTILLED
    + """, s AS (SELECT source_id, selection_status, count(*) AS n FROM x2 WHERE source_id IS NOT NULL AND selection_status IS NOT NULL GROUP BY ALL), q AS (SELECT *, n * 500.0::DOUBLE / sum(n) OVER () AS x FROM s),
      f AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 12) DESC, source_id, selection_status) AS k, 500 - sum(floor(x)) OVER () AS rest FROM q),
      o AS (SELECT source_id, selection_status, least(n, floor(x) + CASE WHEN k <= rest THEN 1 ELSE 0 END) AS quota FROM f),
      r AS (SELECT input_id, source_id, selection_status, row_number() OVER (PARTITION BY source_id, selection_status ORDER BY sample_key NULLS FIRST, qid NULLS FIRST, input_id) AS n FROM x2)
      SELECT input_id, source_id, selection_status FROM r JOIN o USING (source_id, selection_status) WHERE n <= quota""",
    "main_pool": _DISTILLED
    + f""", n AS (SELECT *, {_NORM} AS t FROM x2 WHERE query IS NOT NULL AND source_id IS NOT NULL), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY sample_key NULLS FIRST, input_id) AS k FROM n) WHERE k = 1)
      SELECT input_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sample_key NULLS FIRST, input_id) AS j FROM o) WHERE j <= 40""",
    "length_statistics": """WITH t AS (SELECT lang, length(text) AS n, row_number() OVER (PARTITION BY lang ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL)
      SELECT lang, count(*) AS count, min(n) AS min, max(n) AS max, sum(n) AS sum, min(n) FILTER (i = floor(c * 0.5)) AS p50, min(n) FILTER (i = floor(c * 0.95)) AS p95, min(n) FILTER (i = floor(c * 0.99)) AS p99 FROM t GROUP BY lang""",
    "query_usage": f"SELECT t AS text, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS sources FROM (SELECT {_NORM} AS t, source_id FROM qmd_expansion_locations WHERE source_id IS NOT NULL) WHERE t <> '' GROUP BY t",
    "judged_pairs": "SELECT DISTINCT split, source_id, query_id, corpus_id FROM qrels WHERE score >= 1 AND query_id IS NOT NULL AND corpus_id IS NOT NULL",
    "judgement_audit": """WITH p AS (SELECT split, source_id, query_id, corpus_id, count(*) AS n, count(DISTINCT score) AS s FROM qrels GROUP BY ALL), q AS (SELECT split, source_id, query_id, max(score) AS b FROM qrels WHERE query_id IS NOT NULL GROUP BY ALL)
      SELECT 'repeated' AS check, count(*) AS rows FROM p WHERE n > 1 UNION ALL SELECT 'contradicting', count(*) FROM p WHERE s > 1
      UNION ALL SELECT 'null_id', count(*) FROM qrels WHERE query_id IS NULL OR corpus_id IS NULL UNION ALL SELECT 'without_relevant', count(*) FROM q WHERE coalesce(b, 0) < 1""".replace("AS check", 'AS "check"'),
    "normal_outputs": """SELECT record_id, array_to_string(list_transform(list_sort(list_filter(list_transform(output, lambda e, i: {'kind': lower(trim(e[1])), 'i': i, 'text': trim(e[2])}),
      lambda s: s.kind IN ('lex', 'vec', 'hyde') AND coalesce(s.text, '') <> '')), lambda s: s.kind || ': ' || s.text), chr(10)) AS lines FROM (SELECT DISTINCT record_id, output FROM qmd_expansion_locations WHERE record_id IS NOT NULL)""",
    "rendered_documents": r"""WITH u AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text, coalesce(title, '') AS title FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
      t AS (SELECT *, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda r: length(r))), 0) + 1)) AS f FROM u)
      SELECT doc_id, sha256(CASE WHEN contains(text, '```') THEN '# ' || doc_id || chr(10) || chr(10) || f || chr(10) || text || chr(10) || f || chr(10)
        ELSE CASE WHEN trim(title) <> '' THEN '# ' || title || chr(10) || chr(10) ELSE '' END || text || chr(10) END) AS digest FROM t""",
    "intent_terms": r"""SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(regexp_split_to_array(trim(lower(intent)), '\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '')),
      lambda w: length(w) > 1 AND w NOT IN (""".replace("\\\\", "\\") + ", ".join(f"'{w}'" for w in T.INTENT_STOP_WORDS) + """))) AS term FROM qmd_expansion_locations WHERE intent IS NOT NULL) GROUP BY term""",
    "front_matter": _FRONT + r"""SELECT doc_id, 'status' AS key, 'string' AS value_type, regexp_extract(b, '\n +status: +(\w+)', 1) AS value FROM f WHERE regexp_matches(b, '\n +status: +\w')
      UNION ALL SELECT doc_id, 'rank', 'number', regexp_extract(b, '\n +rank: +(\d+)', 1) FROM f WHERE regexp_matches(b, '\n +rank: +\d')""",
    "conflict_ledger": _LINES
    + """, k AS (SELECT DISTINCT record_id, input_key, coalesce(raw_model_output, '') AS raw FROM query_expansion_contract_v1 WHERE input_key IS NOT NULL),
      c AS (SELECT record_id, string_agg(kind || ': ' || lower(text), chr(10) ORDER BY kind || ': ' || lower(text)) AS canon FROM lines WHERE text IS NOT NULL GROUP BY record_id),
      g AS (SELECT input_key, count(*) AS "rows", count(DISTINCT raw) AS raws, count(DISTINCT canon) AS variants FROM k LEFT JOIN c USING (record_id) GROUP BY input_key)
      SELECT input_key, "rows", variants, CASE WHEN variants = 0 THEN 'invalid' WHEN "rows" = 1 THEN 'unique' WHEN raws = 1 THEN 'identical' WHEN variants = 1 THEN 'format_only' ELSE 'conflict' END AS state FROM g""",
    "table_fingerprint": """WITH d AS (SELECT sha256(coalesce(CAST(doc_id AS VARCHAR), chr(1)) || chr(0) || coalesce(source, chr(1)) || chr(0) || coalesce(path, chr(1)) || chr(0) || coalesce(hash, chr(1)) || chr(0) || coalesce(CAST(active AS VARCHAR), chr(1))) AS d FROM documents WHERE doc_id IS NOT NULL)
      SELECT sha256(CAST(count(*) AS VARCHAR) || """ + " || ".join(f"',' || CAST(sum(CAST('0x' || substring(d, {1 + 8 * i}, 8) AS HUGEINT)) AS VARCHAR)" for i in range(8)) + """) AS fingerprint FROM d""",
    "family_splits": """WITH RECURSIVE f AS (SELECT source AS family, CAST(count(*) AS BIGINT) AS size, sha256(chr(0) || '7' || chr(0) || source) AS h FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL GROUP BY source),
      r AS (SELECT *, row_number() OVER (ORDER BY size DESC, h, family) AS n, sum(size) OVER () AS total FROM f),
      g AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS family, CAST(0 AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS split, CAST(max(total) AS DECIMAL(18, 2)) * 0.70 AS a, CAST(max(total) AS DECIMAL(18, 2)) * 0.15 AS b, CAST(max(total) AS DECIMAL(18, 2)) * 0.15 AS c FROM r
        UNION ALL SELECT r.n, r.family, r.size, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'dev' ELSE 'test' END,
          CASE WHEN a >= b AND a >= c THEN a - r.size ELSE a END, CASE WHEN NOT (a >= b AND a >= c) AND b >= c THEN b - r.size ELSE b END, CASE WHEN NOT (a >= b AND a >= c) AND NOT b >= c THEN c - r.size ELSE c END
        FROM g JOIN r ON r.n = g.n + 1)
      SELECT family, size, split FROM g WHERE n > 0""",
    "query_categories": rf"""WITH q AS (SELECT query, lower(query) AS l, len(list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '')) AS w FROM (SELECT DISTINCT record_id, query FROM qmd_expansion_locations WHERE query IS NOT NULL))
      SELECT CASE WHEN w <= 2 THEN 'short_keyword' WHEN regexp_matches(query, '(?:^|\s)\p{{Lu}}') THEN 'named_entity' WHEN regexp_matches(l, '{"|".join(curation.TEMPORAL)}') THEN 'temporal' WHEN starts_with(l, 'how ') THEN 'how_to'
        WHEN starts_with(l, 'what ') THEN 'what_is' WHEN regexp_matches(l, '{"|".join(curation.COMPARING)}') THEN 'comparison' WHEN regexp_matches(l, '{"|".join(curation.PERSONAL)}') THEN 'personal' ELSE 'other' END AS category,
        CASE WHEN w <= 2 THEN 'short' WHEN w <= 5 THEN 'medium' ELSE 'long' END AS size, count(*) AS n FROM q GROUP BY 1, 2""",
    "negation_lost": _LINES + rf""", n AS (SELECT '{curation.NEGATION}' AS p),
      e AS (SELECT 'qmd_expansion_locations' AS table_name, record_id, query, unnest(output) AS x FROM qmd_expansion_locations WHERE record_id IS NOT NULL
        UNION ALL SELECT 'qmd_expansion_personal_entities', CAST(record_id AS VARCHAR), query, unnest(output) FROM qmd_expansion_personal_entities WHERE record_id IS NOT NULL
        UNION ALL SELECT 'qmd_expansion_sports', CAST(record_id AS VARCHAR), query, unnest(output) FROM qmd_expansion_sports WHERE record_id IS NOT NULL
        UNION ALL SELECT 'query_expansion_contract_v1', CAST(r.record_id AS VARCHAR), query, [kind, text] FROM rows_ r JOIN lines l ON r.record_id = l.record_id WHERE text IS NOT NULL AND r.record_id IS NOT NULL)
      SELECT DISTINCT table_name, record_id, x[2] AS text FROM e, n WHERE x[2] IS NOT NULL AND regexp_matches(lower(query), p) AND NOT regexp_matches(lower(x[2]), p)""",
}
SQL = {k: v for k, v in SQL.items() if v}
