"""Further registered queries: fused lexical lists, routing, paths, selection and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import chunking, curation, expansion, fusion, lexical, maintenance, metrics, retrieval
from ..sources.tables import table
from .search_queries import FIELDS, active_documents, bm25_sql
from .state_queries import _rankings

SUBS = [("0", "budget"), ("1", "exchange rate"), ("2", "ledger")]


def _matches(spark: SparkSession, d: str) -> DataFrame:
    docs = active_documents(spark, d)
    index = lexical.direct_index(docs, "doc_id", FIELDS, [q for _, q in SUBS])
    return lexical.search(spark, index, SUBS).withColumn("score", F.round("score", 9))


def fused_lists(spark: SparkSession, d: str) -> DataFrame:
    """A structured query of three lexical lines: their lists of twenty fused, the first counting twice, scored by rank."""
    top = lexical.top(_matches(spark, d), 20)
    lists = top.select(F.lit("q").alias("qid"), F.col("qid").cast("int").alias("list"), (F.col("rank") - 1).alias("rank0"), "doc")
    fused = fusion.plain_rank_score(fusion.reciprocal_rank_fusion(fusion.list_weights(lists, structured=True), 40))
    return fused.select(F.col("doc").alias("doc_id"), "rank", F.round("score", 9).alias("score"))


def best_of_lists(spark: SparkSession, d: str) -> DataFrame:
    """The best score of each document over the lists, of at least 0.3."""
    m = _matches(spark, d).withColumn("qid", F.lit("q"))
    return fusion.keep_best(m, least=0.3, limit=50).select(F.col("doc").alias("doc_id"), "score", "rank")


def strong_signals(spark: SparkSession, d: str) -> DataFrame:
    """Whether each lexical line's best match makes expansion needless."""
    return expansion.strong_signal(_matches(spark, d))


def parsed_paths(spark: SparkSession, d: str) -> DataFrame:
    """Virtual paths written in other ways, taken apart again."""
    docs = active_documents(spark, d).where("path is not null")
    odd = F.concat(F.lit("skein:////"), "source", F.lit("/"), "path", F.lit("?index=main"))
    return docs.select("doc_id", P.virtual_parts(odd).alias("v")).select("doc_id", "v.collection", "v.path", "v.index")


def encoded_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = active_documents(spark, d).where("title is not null")
    return docs.select("doc_id", P.encode_path(F.concat("path", F.lit("/"), "title")).alias("encoded"))


def path_owners(spark: SparkSession, d: str) -> DataFrame:
    """The collection with the longest root above each file."""
    docs = active_documents(spark, d).where("path is not null and source is not null")
    files = docs.select(F.concat(F.lit("/data/"), "source", F.lit("/"), "path").alias("path")).distinct()
    roots = docs.select("source").distinct().select(F.col("source").alias("collection"), F.concat(F.lit("/data/"), "source", F.lit("/")).alias("root"))
    nested = spark.createDataFrame([("handbook-notes", "/data/handbook/notes")], "collection string, root string")
    return retrieval.collection_of(files, roots.unionByName(nested))


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that documents are embedded as, by their digests."""
    docs = active_documents(spark, d).where("text is not null")
    return docs.select("doc_id", F.sha2(T.embedding_document(F.col("text"), F.col("title")), 256).alias("plain"), F.sha2(T.embedding_document(F.col("text"), F.col("title"), True), 256).alias("instructed"))


def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Passages embedded by a stand-in model: letter shares (no SQL twin: a model)."""

    def letters(texts: list[str]) -> list[list[float]]:
        return [[t.lower().count(c) / max(1, len(t)) for c in "aeioun"] for t in texts]

    chunks = chunking.chunk_documents(active_documents(spark, d), "doc_id", "text", "path")
    return maintenance.embed(chunks, letters, dim=6).select(F.col("id").alias("doc_id"), "seq", "embedding", "error")


def selected_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best input of each source and split that beats its raw metric."""
    rows = table(spark, d, "distill_records").where("input_id is not null and best_metric is not null and source_id is not null").select(F.concat_ws("|", "source_id", "split").alias("grp"), "best_metric", "raw_metric", "input_id").distinct()
    return curation.select_candidates(rows, "grp", ["best_metric"], "raw_metric", "input_id").select("grp", "input_id", "best_metric")


def judgement_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether recall at 3 gains over recall at 1 in the mean without a loss in any split."""
    m = metrics.query_metrics(*_rankings(spark, d)).withColumn("source", F.element_at(F.split("qid", r"\|"), 1))
    deltas = m.groupBy("source").agg(F.avg(F.col("recall_3") - F.col("recall_1")).alias("delta"))
    return metrics.gate(deltas).select(F.round("macro_delta", 9).alias("macro_delta"), F.round("worst", 9).alias("worst"), "passed")


def micro_scores(spark: SparkSession, d: str) -> DataFrame:
    """Micro precision, recall and F1 of the words of queries against those of their lexical entries, by category."""
    rows = table(spark, d, "qmd_expansion_locations").where("query is not null and category is not null").select("record_id", "query", "category", "output").distinct()
    lex = F.array_join(F.transform(F.filter("output", lambda e: F.get(e, F.lit(0)) == "lex"), lambda e: F.coalesce(F.get(e, F.lit(1)), F.lit(""))), " ")
    said, wanted = T.word_set(F.coalesce(lex, F.lit(""))), T.word_set(F.col("query"))
    counts = rows.select("category", F.size(F.array_intersect(said, wanted)).alias("hits"), F.size(said).alias("said"), F.size(wanted).alias("wanted"))
    m = metrics.micro(counts, ["category"])
    return m.select("category", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each distilled input."""
    from ..operators.ingest import latest

    rows = table(spark, d, "distill_records").where("input_id is not null and scored_at is not null").select("input_id", "scored_at").distinct()
    return latest(rows, ["input_id"], [F.desc("scored_at")])


_GATE = """
WITH q AS (SELECT split, split || '|' || coalesce(source_id, '') || '|' || query_id AS qid, corpus_id AS doc, max(score) AS score FROM qrels WHERE query_id IS NOT NULL AND corpus_id IS NOT NULL GROUP BY ALL),
r AS (SELECT split, qid, coalesce(score, 0) >= 1 AS rel, row_number() OVER (PARTITION BY qid ORDER BY sha256(doc), doc) AS rank FROM q),
m AS (SELECT split, qid, (count(*) FILTER (rel AND rank <= 3) - count(*) FILTER (rel AND rank <= 1)) / count(*) FILTER (rel) AS d FROM r GROUP BY split, qid HAVING count(*) FILTER (rel) > 0),
s AS (SELECT split, avg(d) AS delta FROM m GROUP BY split)
SELECT round(avg(delta), 9) AS macro_delta, round(min(delta), 9) AS worst, avg(delta) > 0 AND bool_and(delta >= -0.01) AS passed FROM s"""

_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"

QUERIES = {
    f.__name__: f
    for f in (fused_lists, best_of_lists, strong_signals, parsed_paths, encoded_paths, path_owners, embedding_texts, embedded_chunks, selected_candidates, judgement_gate, micro_scores, latest_rows)
}

SQL = {
    "fused_lists": bm25_sql(SUBS)
    + """, lists AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS rank0 FROM scored),
      f AS (SELECT doc_id, sum(CASE WHEN qid = (SELECT min(qid) FROM lists) THEN 2.0::DOUBLE ELSE 1.0 END / (61 + rank0)) AS base, min(rank0) AS best, min(CAST(qid AS INT) * 1000 + rank0) AS seen FROM lists WHERE rank0 < 20 GROUP BY doc_id),
      r AS (SELECT doc_id, row_number() OVER (ORDER BY round(base + CASE WHEN best = 0 THEN 0.05 WHEN best <= 2 THEN 0.02 ELSE 0 END::DOUBLE, 12) DESC, seen) AS rank FROM f)
      SELECT doc_id, CAST(rank AS INT) AS rank, round(1.0::DOUBLE / rank, 9) AS score FROM r WHERE rank <= 40""",
    "best_of_lists": bm25_sql(SUBS) + "SELECT doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT doc_id, max(score) AS score, row_number() OVER (ORDER BY max(score) DESC, doc_id) AS rank FROM scored GROUP BY doc_id HAVING max(score) >= 0.3) WHERE rank <= 50",
    "strong_signals": bm25_sql(SUBS)
    + """, t AS (SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS n FROM scored)
      SELECT qid, max(score) FILTER (n = 1) >= 0.85 AND max(score) FILTER (n = 1) - coalesce(max(score) FILTER (n = 2), 0) >= 0.15 AS strong FROM t GROUP BY qid""",
    "parsed_paths": "SELECT doc_id, source AS collection, path, 'main' AS \"index\" FROM documents WHERE active AND doc_id IS NOT NULL AND path IS NOT NULL",
    "encoded_paths": "SELECT doc_id, replace(url_encode(path || '/' || title), '%2F', '/') AS encoded FROM documents WHERE active AND doc_id IS NOT NULL AND title IS NOT NULL",
    "path_owners": """SELECT DISTINCT '/data/' || source || '/' || path AS path, CASE WHEN source = 'handbook' AND path LIKE 'notes/%' THEN 'handbook-notes' ELSE source END AS collection,
      CASE WHEN source = 'handbook' AND path LIKE 'notes/%' THEN substring(path, 7) ELSE path END AS relative FROM documents WHERE active AND doc_id IS NOT NULL AND path IS NOT NULL AND source IS NOT NULL""",
    "embedding_texts": """SELECT doc_id, sha256('title: ' || coalesce(nullif(title, ''), 'none') || ' | text: ' || text) AS plain, sha256(CASE WHEN coalesce(title, '') <> '' THEN title || chr(10) || text ELSE text END) AS instructed
      FROM documents WHERE active AND doc_id IS NOT NULL AND text IS NOT NULL""",
    "selected_candidates": """WITH t AS (SELECT DISTINCT concat_ws('|', source_id, split) AS grp, best_metric, raw_metric, input_id FROM distill_records WHERE input_id IS NOT NULL AND best_metric IS NOT NULL AND source_id IS NOT NULL)
      SELECT grp, input_id, best_metric FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY best_metric DESC, input_id DESC) AS n FROM t) WHERE n = 1 AND best_metric > raw_metric""",
    "judgement_gate": _GATE,
    "micro_scores": f"""WITH t AS (SELECT DISTINCT record_id, query, category, output FROM qmd_expansion_locations WHERE query IS NOT NULL AND category IS NOT NULL),
      w AS (SELECT category, {_WORDS.format("coalesce(array_to_string(list_transform(list_filter(output, lambda e: e[1] = 'lex'), lambda e: coalesce(e[2], '')), ' '), '')")} AS s, {_WORDS.format('query')} AS q FROM t),
      c AS (SELECT category, sum(len(list_intersect(s, q))) AS h, sum(len(s)) AS a, sum(len(q)) AS b FROM w GROUP BY category)
      SELECT category, round(h / a, 9) AS precision, round(h / b, 9) AS recall, round(2 * h / (a + b), 9) AS f1 FROM c""".replace("AS precision", 'AS "precision"'),
    "latest_rows": "SELECT input_id, max(scored_at) AS scored_at FROM distill_records WHERE input_id IS NOT NULL AND scored_at IS NOT NULL GROUP BY input_id",
}
