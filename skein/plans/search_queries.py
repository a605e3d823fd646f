"""Registered queries of search, fusion and retrieval, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import chunking, expansion, fusion, lexical, metrics, retrieval, vector
from ..session import materialize
from ..sources.tables import table

LEXICAL = [
    ("plain", "budget review"),
    ("phrase", '"exchange rate" ledger'),
    ("exclude", "court -appeal"),
    ("compound", "follow-up desk"),
    ("accents", "trésorerie"),
    ("cjk", "望遠鏡"),
]
#: Queries that the scope of :func:`bm25_scoped` answers at every size.
SCOPED = [("one", "ledger"), ("prefix", "budg"), ("exclude", "meeting -budget")]
FIELDS = {"path": "path", "title": "title", "body": "text"}


def active_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("active and doc_id is not null")


def _matches(spark: SparkSession, d: str, queries=LEXICAL) -> DataFrame:
    docs = active_documents(spark, d)
    index = lexical.direct_index(docs, "doc_id", FIELDS, [q for _, q in queries])
    return lexical.search(spark, index, queries)


def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best documents of each of several lexical queries."""
    m = _matches(spark, d).withColumn("score", F.round("score", 9))
    return lexical.top(m, 20).select("qid", F.col("doc").alias("doc_id"), "score", "rank")


def bm25_all(spark: SparkSession, d: str) -> DataFrame:
    """Every match with its score."""
    return _matches(spark, d).select("qid", F.col("doc").alias("doc_id"), F.round("score", 9).alias("score"))


def bm25_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Matches within a set of collections, scored by the statistics of all."""
    docs = active_documents(spark, d)
    queries = SCOPED
    index = lexical.direct_index(docs, "doc_id", FIELDS, [q for _, q in queries])
    scope = docs.where("source = 'handbook'").select(F.col("doc_id").alias("doc"))
    return lexical.search(spark, index, queries, scope).select("qid", F.col("doc").alias("doc_id"), F.round("score", 9).alias("score"))


def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The same over an index of stems that is written first (no SQL twin: the stemmer is procedural)."""
    docs = active_documents(spark, d)
    index = lexical.build_index(docs, "doc_id", FIELDS, stem=True)
    m = lexical.search(spark, index, LEXICAL[:3]).withColumn("score", F.round("score", 9))
    return lexical.top(m, 20).select("qid", F.col("doc").alias("doc_id"), "score", "rank")


def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and distinct tokens per collection."""
    docs = active_documents(spark, d).select(F.col("source").alias("collection"), F.explode(T.tokens(F.col("text"))).alias("term"))
    return docs.groupBy("collection").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("term").alias("terms"))


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency of every term in more than one document."""
    docs = active_documents(spark, d).select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return docs.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1")


def _fold_sql(c: str) -> str:
    return f"translate(lower({c}), '{T.MARKED}', '{T.BASES}')"


def tokens_sql(c: str) -> str:
    return rf"regexp_extract_all(regexp_replace({_fold_sql(f'coalesce({c}, {chr(39)}{chr(39)})')}, '([{T.CJK}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(queries=LEXICAL, scope: str = "true") -> str:
    rows, need = [], []
    for qid, q in queries:
        phrases = lexical.parse_query(q)
        need.append(f"('{qid}', {sum(not p.negative for p in phrases)})")
        for k, p in enumerate(phrases):
            for i, t in enumerate(p.terms):
                rows.append(f"('{qid}', {k}, {p.negative}, {len(p.terms)}, {i}, '{t}', {p.prefix and i == len(p.terms) - 1})")
    toks = ", ".join(f"{tokens_sql(c)} AS t_{f}" for f, c in FIELDS.items())
    each = " UNION ALL ".join(f"SELECT doc_id, source, '{f}' AS field, {lexical.FIELD_WEIGHTS[f]} AS w, unnest(t_{f}) AS term, generate_subscripts(t_{f}, 1) AS pos FROM toks" for f in FIELDS)
    return f"""
WITH wanted(qid, k, neg, size, off, want, prefix) AS (VALUES {', '.join(rows)}),
need(qid, required) AS (VALUES {', '.join(need)}),
toks AS MATERIALIZED (SELECT doc_id, source, {toks} FROM documents WHERE active AND doc_id IS NOT NULL),
lens AS (SELECT doc_id, len(t_path) + len(t_title) + len(t_body) AS len FROM toks),
stats AS (SELECT count(*) AS n, sum(len) / count(*) AS mean FROM lens),
post AS ({each}),
starts AS (SELECT qid, k, neg, size, doc_id, source, field, w, pos - off AS start FROM post JOIN wanted ON CASE WHEN prefix THEN starts_with(term, want) ELSE term = want END
           GROUP BY ALL HAVING count(DISTINCT off) = size),
freq AS (SELECT qid, k, neg, doc_id, source, sum(w) AS tf FROM starts GROUP BY ALL),
df AS (SELECT qid, k, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), {lexical.IDF_FLOOR}) AS idf FROM freq, stats WHERE NOT neg GROUP BY ALL),
summed AS (SELECT qid, doc_id, sum(idf * (tf * {lexical.K1 + 1}) / (tf + {lexical.K1} * (1 - {lexical.B} + {lexical.B} * len / mean))) AS s, count(*) AS matched
           FROM freq JOIN df USING (qid, k) JOIN lens USING (doc_id), stats WHERE NOT neg AND {scope} GROUP BY ALL),
scored AS (SELECT qid, doc_id, round(abs(s) / (1 + abs(s)), 9) AS score FROM summed JOIN need USING (qid) WHERE matched = required
           AND NOT EXISTS (SELECT 1 FROM freq f WHERE f.neg AND f.qid = summed.qid AND f.doc_id = summed.doc_id))
"""


# ---- vectors -------------------------------------------------------------------------------------


def knn(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest rows of each query (ids divisible by 20) among all rows."""
    e = table(spark, d, "embeddings")
    found = vector.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)
    return found.select("qid", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest rows of each query among those of label 3: the filter comes before the top-k."""
    e = table(spark, d, "embeddings")
    found = vector.nearest(e.where("vec_id % 20 = 0"), e.where("label = 3"), "vec_id", "embedding", 5)
    return found.select("qid", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


def knn_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Per query and label the nearest row, as passages are folded into documents."""
    e = table(spark, d, "embeddings")
    best = vector.nearest_groups(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", "label")
    return best.select("qid", "label", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Rows and mean self-distance per label."""
    e = table(spark, d, "embeddings")
    dist = vector.cosine_distance(F.col("embedding"), F.col("embedding"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(dist), 6).alias("self_distance"))


_KNN = """
WITH pairs AS (SELECT q.vec_id AS qid, e.vec_id, e.label, list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 {0})
"""
_KNN_TOP = "SELECT qid, vec_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), vec_id) AS rank FROM pairs) WHERE rank <= {0}"


# ---- fusion ---------------------------------------------------------------------------------------


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Three ranked lists per language: by length, by change time, by collection size."""
    docs = active_documents(spark, d).where("lang is not null and n_chars is not null").select("doc_id", "lang", "n_chars", "modified_at", "path")
    out = None
    for i, order in enumerate(([F.desc("n_chars"), F.col("doc_id")], [F.desc("modified_at"), F.col("doc_id")], [F.col("path"), F.col("doc_id")])):
        part = docs.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where("r <= 50")
        part = part.select(F.col("lang").alias("qid"), F.lit(i).alias("list"), (F.col("r") - 1).alias("rank0"), F.col("doc_id").alias("doc"), F.lit(i == 0).alias("original"))
        out = part if out is None else out.unionByName(part)
    return out


def rrf(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.reciprocal_rank_fusion(fusion.list_weights(_lists(spark, d), structured=False), 40)
    return fused.select("qid", F.col("doc").alias("doc_id"), F.round("score", 9).alias("score"), "best_rank", "rank")


def rrf_structured(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.reciprocal_rank_fusion(fusion.list_weights(_lists(spark, d).where("list > 0"), structured=True), 40)
    return fused.select("qid", F.col("doc").alias("doc_id"), F.round("score", 9).alias("score"), "best_rank", "rank")


def rrf_trace(spark: SparkSession, d: str) -> DataFrame:
    t = fusion.fusion_trace(fusion.list_weights(_lists(spark, d), structured=False))
    return t.select("qid", F.col("doc").alias("doc_id"), F.size("contributions").alias("lists"), F.round("base", 9).alias("base"), "bonus", F.round("total", 9).alias("total"))


def rerank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fusion ranks and a rerank score (here the share of the title's length) fused."""
    ranked = fusion.reciprocal_rank_fusion(fusion.list_weights(_lists(spark, d), structured=False), 40)
    docs = active_documents(spark, d).select(F.col("doc_id").alias("doc"), (F.length(F.coalesce("title", F.lit(""))) / 100).alias("rerank_score"))
    out = fusion.fuse_rerank(ranked.join(docs, "doc").withColumn("doc_key", F.col("doc")))
    return out.select("qid", F.col("doc").alias("doc_id"), "rerank_rank", F.round("score", 9).alias("score"))


_LISTS = """
WITH base AS (SELECT doc_id, lang, n_chars, modified_at, path FROM documents WHERE active AND doc_id IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL),
lists AS (
  SELECT lang AS qid, 0 AS list, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank0, doc_id, 2.0::DOUBLE AS weight FROM base
  UNION ALL SELECT lang, 1, row_number() OVER (PARTITION BY lang ORDER BY modified_at DESC NULLS LAST, doc_id) - 1, doc_id, {0} FROM base
  UNION ALL SELECT lang, 2, row_number() OVER (PARTITION BY lang ORDER BY path NULLS FIRST, doc_id) - 1, doc_id, 1.0 FROM base),
cut AS (SELECT * FROM lists WHERE rank0 < 50 {1}),
fused AS (SELECT qid, doc_id, sum(weight / (60 + rank0 + 1)) AS base, min(rank0) AS best_rank, count(*) AS lists, min(list * 1000 + rank0) AS seen FROM cut GROUP BY ALL),
scored AS (SELECT *, CASE WHEN best_rank = 0 THEN 0.05 WHEN best_rank <= 2 THEN 0.02 ELSE 0 END::DOUBLE AS bonus FROM fused),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(base + bonus, 12) DESC, seen) AS rank FROM scored)
"""
_RRF = "SELECT qid, doc_id, round(base + bonus, 9) AS score, CAST(best_rank AS INT) AS best_rank, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 40"


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval without models: pinned sub-queries, fusion, best passage, reranking by word overlap."""
    from .hybrid import Store

    store = Store.of_documents(active_documents(spark, d))
    return store.query(["lex: budget review", "lex: exchange rate", "lex: ledger"], limit=10)


# ---- documents --------------------------------------------------------------------------------------


def virtual_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = active_documents(spark, d)
    return docs.select(
        "doc_id",
        P.virtual_path(F.col("source"), F.col("path")).alias("virtual_path"),
        P.display_path(F.col("source"), F.col("path")).alias("display_path"),
        T.docid(F.col("hash")).alias("docid"),
    )


def titles(spark: SparkSession, d: str) -> DataFrame:
    return active_documents(spark, d).where("text is not null").select("doc_id", T.title_of(F.col("text"), F.col("path")).alias("heading"))


def body_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines 3 to 7 of each body, numbered."""
    docs = active_documents(spark, d).where("text is not null")
    return docs.select("doc_id", retrieval.body_lines(F.col("text"), 3, 5, numbered=True).alias("lines"))


def capped_bodies(spark: SparkSession, d: str) -> DataFrame:
    docs = active_documents(spark, d).where("text is not null")
    capped = T.capped_body(F.col("text"), 4096)
    return docs.groupBy("source").agg(F.sum(F.length(capped)).alias("chars"), F.count_if(F.octet_length("text") > 4096).alias("capped"))


def glob_matches(spark: SparkSession, d: str) -> DataFrame:
    docs = active_documents(spark, d).withColumnRenamed("source", "collection")
    return retrieval.match_glob(docs, "{docs,notes}/**/*-[0-9]*.md").select("doc_id", "collection", "path")


def joined_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Documents joined with their content by hash; sizes per collection."""
    docs = active_documents(spark, d).select("source", "hash")
    body = table(spark, d, "documents").where("hash is not null").select("hash", F.length("text").alias("n")).dropDuplicates(["hash"])
    return docs.join(body, "hash").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chars"))


def resolved_refs(spark: SparkSession, d: str) -> DataFrame:
    """Each document's own docid, path and file name resolved again: tier and number of hits."""
    docs = active_documents(spark, d).select(F.col("doc_id").alias("doc"), F.col("source").alias("collection"), "path", "hash").where("hash is not null and path is not null")
    refs = docs.select(F.explode(F.array(F.concat(F.lit("#"), F.substring("hash", 1, 6)), "path", F.element_at(F.split("path", "/"), -1))).alias("ref")).distinct()
    return retrieval.resolve_refs(refs, docs).select("ref", "tier", "found", F.col("doc").alias("doc_id"))


def similar_paths(spark: SparkSession, d: str) -> DataFrame:
    """The nearest paths of some misspelt ones."""
    refs = spark.createDataFrame([("note/walk_tree-219.md",), ("Archive/read_slise-625.md",), ("docs/merge_key-376.md",), ("inbox/none.md",)], "ref string")
    return retrieval.similar_paths(refs, active_documents(spark, d))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Context texts of each document, from general to special."""
    docs = active_documents(spark, d).select(F.col("doc_id").alias("doc"), F.col("source").alias("collection"), "path").where("path is not null")
    ctx = spark.createDataFrame(
        [(None, "", "all notes"), ("handbook", "", "the handbook"), ("handbook", "no", "starts with no"), ("handbook", "notes/", "meeting notes"), (None, "docs/", "manuals")],
        "collection string, prefix string, text string",
    )
    return retrieval.contexts_of(docs, ctx).select(F.col("doc").alias("doc_id"), F.array_join("contexts", " / ").alias("context"))


_CONTEXTS = """
WITH ctx(collection, prefix, text) AS (VALUES (NULL, '', 'all notes'), ('handbook', '', 'the handbook'), ('handbook', 'no', 'starts with no'), ('handbook', 'notes/', 'meeting notes'), (NULL, 'docs/', 'manuals'))
SELECT doc_id, string_agg(c.text, ' / ' ORDER BY (c.collection IS NOT NULL), length(prefix), prefix) AS context FROM documents d
JOIN ctx c ON (c.collection IS NULL OR c.collection = d.source) AND starts_with(d.path, c.prefix) WHERE d.active AND doc_id IS NOT NULL AND path IS NOT NULL GROUP BY doc_id"""


def snippet_lines(spark: SparkSession, d: str) -> DataFrame:
    """Best line and its hits for a query, in SQL expressions."""
    docs = active_documents(spark, d).where("text is not null")
    best = retrieval.best_line(F.col("text"), "budget ledger review")
    return docs.select("doc_id", best.alias("b")).where("b.score > 0").select("doc_id", (1 - F.col("b.k")).alias("line"), F.col("b.score").alias("hits"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = active_documents(spark, d)
    return retrieval.snippets(docs, "doc_id", "text", "budget ledger review", intent="money planning")


def formatted(name: str):
    make = {"csv": retrieval.as_csv, "xml": retrieval.as_xml, "files": retrieval.as_files, "md": retrieval.as_markdown}[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = active_documents(spark, d).where("hash is not null")
        rows = docs.select(
            F.col("doc_id").cast("string").alias("docid"),
            (F.length("path") / 64).alias("score"),
            P.virtual_path(F.col("source"), F.col("path")).alias("file"),
            "title",
            F.when(F.col("source") == "handbook", F.lit('the "handbook", all of it')).alias("context"),
            F.lit(1).alias("line"),
            F.col("text").alias("snippet"),
        )
        return make(rows)

    return run


_RESULTS = """
WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS docid, length(path) / 64 AS score, 'skein://' || source || '/' || path AS file, title,
  CASE WHEN source = 'handbook' THEN 'the "handbook", all of it' END AS context, text AS snippet FROM documents WHERE active AND doc_id IS NOT NULL AND hash IS NOT NULL)
"""


def _csv(c: str) -> str:
    return f"CASE WHEN regexp_matches(coalesce({c}, ''), '[,\"\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE coalesce({c}, '') END"


def _xml(c: str) -> str:
    out = f"coalesce({c}, '')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def slugs(spark: SparkSession, d: str) -> DataFrame:
    docs = active_documents(spark, d).where("path is not null")
    return docs.select("doc_id", P.slug(F.col("path")).alias("slug"))


def passages(spark: SparkSession, d: str) -> DataFrame:
    """Structure-aware passages of every active document (no SQL twin: the cut search is procedural)."""
    return chunking.chunk_documents(active_documents(spark, d), "doc_id", "text", "path").select(F.col("id").alias("doc_id"), "seq", "pos", "n_chars", F.sha2("chunk", 256).alias("chunk_hash"))


def passage_cover(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose passages begin at 0, end with the text and leave no gap: all of them."""
    docs = active_documents(spark, d)
    c = chunking.chunk_documents(docs, "doc_id", "text", "path")
    w = W.partitionBy("id").orderBy("seq")
    gaps = c.withColumn("before", F.coalesce(F.lag(F.col("pos") + F.col("n_chars")).over(w), F.lit(0))).groupBy("id").agg(F.max(F.col("pos") - F.col("before")).alias("gap"), F.max(F.col("pos") + F.col("n_chars")).alias("end"), F.min("pos").alias("start"))
    joined = gaps.join(docs.select(F.col("doc_id").alias("id"), F.length("text").alias("n")), "id")
    return joined.where("gap <= 0 and start = 0 and end = n").select(F.col("id").alias("doc_id"), F.col("n").alias("n_chars"))


def best_passages(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk_documents(active_documents(spark, d), "doc_id", "text", "path")
    return chunking.best_passage(c, "budget ledger review", ["money"]).select(F.col("id").alias("doc_id"), "seq", "pos", "score")


# ---- expansions -----------------------------------------------------------------------------------


def expansion_lines(spark: SparkSession, d: str) -> DataFrame:
    """Parsed lines of generated output, with their problems."""
    rows = table(spark, d, "query_expansion_contract_v1").dropDuplicates(["record_id"])
    lines = expansion.parsed_lines(F.col("raw_model_output"))
    return rows.select("record_id", F.explode(lines).alias("l")).select("record_id", "l.line", "l.kind", "l.text", "l.problem")


def expansion_status(spark: SparkSession, d: str) -> DataFrame:
    """Share of usable output by model."""
    rows = table(spark, d, "query_expansion_contract_v1").dropDuplicates(["record_id"])
    status = expansion.artifact_status(expansion.parsed_lines(F.col("raw_model_output")), F.lit(None).cast("string"))
    return metrics.status_rates(rows.select(F.coalesce("model", F.lit("?")).alias("model"), status.alias("status")), ["model"])


def expansion_queries(spark: SparkSession, d: str) -> DataFrame:
    """Sub-queries to run: usable lines or the fallback, without copies of the query and repeats."""
    rows = table(spark, d, "query_expansion_contract_v1").dropDuplicates(["record_id"]).where("query is not null")
    out = expansion.with_fallback(expansion.usable(expansion.parsed_lines(F.col("raw_model_output"))), F.col("query"))
    flat = rows.select("record_id", "query", F.posexplode(out).alias("i", "e")).select("record_id", "query", "i", "e.kind", "e.text")
    return expansion.distinct_subqueries(flat, ["record_id"], "i").select("record_id", "kind", "text")


def expansion_strict(spark: SparkSession, d: str) -> DataFrame:
    """Training outputs without their lexical lines that are exactly one passage and then one or two questions."""
    rows = table(spark, d, "qmd_expansion_locations").where("record_id is not null").select("record_id", "output").distinct()
    lines = expansion.normal_output(F.filter("output", lambda e: F.lower(F.trim(F.get(e, F.lit(0)))) != "lex"))
    return rows.select("record_id", F.size(expansion.strict_output(expansion.parsed_lines(lines))).alias("n")).where("n > 0")


_LINES = r"""
WITH rows_ AS (SELECT DISTINCT record_id, query, raw_model_output AS raw, model FROM query_expansion_contract_v1),
split AS (SELECT record_id, unnest(string_split(regexp_replace(raw, '^\s+|\s+$', '', 'g'), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(raw, '^\s+|\s+$', '', 'g'), chr(10)), 1) AS line
          FROM rows_ WHERE regexp_matches(coalesce(raw, ''), '\S')),
bare AS (SELECT record_id, line, regexp_replace(x, '\r$', '') AS x FROM split),
cut AS (SELECT record_id, line, x, instr(x, ':') AS p_, trim(substring(x, 1, greatest(instr(x, ':') - 1, 0))) AS k, regexp_replace(substring(x, instr(x, ':') + 1), '^\s+|\s+$', '', 'g') AS t FROM bare),
lines AS (SELECT record_id, CAST(line AS INT) AS line, CASE WHEN p_ > 0 AND k IN ('lex', 'vec', 'hyde') THEN k END AS kind,
   CASE WHEN p_ > 0 AND k IN ('lex', 'vec', 'hyde') AND t <> '' THEN t END AS text,
   CASE WHEN p_ = 0 OR k NOT IN ('lex', 'vec', 'hyde') THEN 'invalid_line' WHEN t = '' THEN 'empty_text' WHEN NOT regexp_matches(x, '^(lex|vec|hyde): \S') THEN 'invalid_line' END AS problem FROM cut)
"""

QUERIES = {
    f.__name__: f
    for f in (
        bm25_top, bm25_all, bm25_scoped, bm25_stemmed, token_statistics, term_frequencies, knn, knn_filtered, knn_by_label, vector_norms, rrf, rrf_structured, rrf_trace,
        rerank_fusion, hybrid, virtual_paths, titles, body_lines, capped_bodies, glob_matches, joined_bodies, resolved_refs, similar_paths, contexts, snippet_lines,
        snippets, slugs, passages, passage_cover, best_passages, expansion_lines, expansion_status, expansion_queries, expansion_strict,
    )
}
QUERIES |= {f"format_{n}": formatted(n) for n in ("csv", "xml", "files", "md")}

SQL = {
    "bm25_top": bm25_sql() + "SELECT qid, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 20",
    "bm25_all": bm25_sql() + "SELECT qid, doc_id, score FROM scored",
    "bm25_scoped": bm25_sql(SCOPED, "source = 'handbook'") + "SELECT qid, doc_id, score FROM scored",
    "token_statistics": f"SELECT source AS collection, count(*) AS n_tokens, count(DISTINCT term) AS terms FROM (SELECT source, unnest({tokens_sql('text')}) AS term FROM documents WHERE active AND doc_id IS NOT NULL) GROUP BY source",
    "term_frequencies": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tokens_sql('text')})) AS term FROM documents WHERE active AND doc_id IS NOT NULL) GROUP BY term HAVING count(*) > 1",
    "knn": _KNN.format("") + _KNN_TOP.format(10),
    "knn_filtered": _KNN.format("AND e.label = 3") + _KNN_TOP.format(5),
    "knn_by_label": _KNN.format("") + "SELECT qid, label, vec_id, d AS distance FROM (SELECT *, round(distance, 6) AS d, row_number() OVER (PARTITION BY qid, label ORDER BY round(distance, 9), vec_id) AS r FROM pairs) WHERE r = 1",
    "vector_norms": "SELECT label, count(*) AS n, abs(round(avg(list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6)) AS self_distance FROM embeddings GROUP BY label",
    "rrf": _LISTS.format("1.0", "") + _RRF,
    "rrf_structured": _LISTS.format("2.0", "AND list > 0") + _RRF,
    "rrf_trace": _LISTS.format("1.0", "") + "SELECT qid, doc_id, CAST(lists AS INT) AS lists, round(base, 9) AS base, bonus, round(base + bonus, 9) AS total FROM scored",
    "rerank_fusion": _LISTS.format("1.0", "")
    + """SELECT qid, doc_id, CAST(rr AS INT) AS rerank_rank, round((1.0 / (60 + rank) + 1.0 / (60 + rr)) / (2.0 / 61), 9) AS score FROM
    (SELECT r.*, row_number() OVER (PARTITION BY qid ORDER BY length(coalesce(title, '')) DESC, rank) AS rr FROM ranked r JOIN documents USING (doc_id) WHERE rank <= 40)""",
    "virtual_paths": "SELECT doc_id, 'skein://' || source || '/' || path AS virtual_path, source || '/' || path AS display_path, substring(hash, 1, 6) AS docid FROM documents WHERE active AND doc_id IS NOT NULL",
    "titles": r"""WITH t AS (SELECT doc_id, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS kind, trim(regexp_extract(text, '(?:^|[\r\n])##?[ \t]+(\S[^\r\n]*)', 1)) AS a, trim(regexp_extract(text, '(?:^|[\r\n])##[ \t]+(\S[^\r\n]*)', 1)) AS b,
      regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^.]+$', '') AS name FROM documents WHERE active AND doc_id IS NOT NULL AND text IS NOT NULL)
      SELECT doc_id, CASE WHEN kind IN ('md', 'markdown', 'mdx') AND a <> '' THEN CASE WHEN a IN ('Notes', '📝 Notes') AND b <> '' THEN b ELSE a END ELSE name END AS heading FROM t""",
    "body_lines": "SELECT doc_id, array_to_string(list_transform(list_slice(string_split(text, chr(10)), 3, 7), lambda x, i: CAST(i + 2 AS VARCHAR) || ': ' || x), chr(10)) AS lines FROM documents WHERE active AND doc_id IS NOT NULL AND text IS NOT NULL",
    "capped_bodies": "SELECT source, sum(CASE WHEN strlen(text) <= 4096 THEN length(text) ELSE length(substring(text, 1, 4096)) END) AS chars, count(*) FILTER (strlen(text) > 4096) AS capped FROM documents WHERE active AND doc_id IS NOT NULL AND text IS NOT NULL GROUP BY source",
    "glob_matches": r"SELECT doc_id, source AS collection, path FROM documents WHERE active AND doc_id IS NOT NULL AND regexp_matches(path, '^(docs|notes)/([^/]+/)*[^/]*-[0-9][^/]*\.md$')",
    "joined_bodies": "SELECT d.source, count(*) AS documents, sum(n) AS chars FROM documents d JOIN (SELECT hash, any_value(length(text)) AS n FROM documents WHERE hash IS NOT NULL GROUP BY hash) USING (hash) WHERE active AND doc_id IS NOT NULL GROUP BY d.source",
    "resolved_refs": """WITH d AS (SELECT doc_id, source, path, hash FROM documents WHERE active AND doc_id IS NOT NULL AND hash IS NOT NULL AND path IS NOT NULL),
      refs AS (SELECT DISTINCT '#' || substring(hash, 1, 6) AS ref FROM d UNION SELECT path FROM d UNION SELECT list_last(string_split(path, '/')) FROM d),
      hits AS (SELECT ref, 1 AS tier, doc_id FROM refs JOIN d ON substring(hash, 1, 6) = substring(ref, 2) AND ref LIKE '#%'
        UNION ALL SELECT ref, 3, doc_id FROM refs JOIN d ON ref = source || '/' || path UNION ALL SELECT ref, 4, doc_id FROM refs JOIN d ON ref = path
        UNION ALL SELECT ref, 5, doc_id FROM refs JOIN (SELECT doc_id, list_last(string_split(path, '/')) AS s, path FROM d) ON ref = s AND path <> s
        UNION ALL SELECT ref, 5, doc_id FROM refs JOIN (SELECT doc_id, path, unnest(list_transform(range(2, len(string_split(path, '/'))), lambda i: array_to_string(list_slice(string_split(path, '/'), i, 99), '/'))) AS s FROM d) ON ref = s)
      SELECT ref, tier, count(DISTINCT doc_id) AS found, min(doc_id) AS doc_id FROM hits WHERE tier = (SELECT min(tier) FROM hits h WHERE h.ref = hits.ref) GROUP BY ref, tier""",
    "similar_paths": """WITH refs(ref) AS (VALUES ('note/walk_tree-219.md'), ('Archive/read_slise-625.md'), ('docs/merge_key-376.md'), ('inbox/none.md')),
      s AS (SELECT ref, path, CAST(levenshtein(lower(ref), lower(path)) AS INT) AS distance FROM refs, (SELECT DISTINCT path FROM documents WHERE active AND doc_id IS NOT NULL))
      SELECT ref, path, distance FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY distance, path) AS n FROM s WHERE distance <= 3) WHERE n <= 5""",
    "contexts": _CONTEXTS,
    "snippet_lines": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE active AND doc_id IS NOT NULL AND text IS NOT NULL),
      s AS (SELECT doc_id, line, CAST(contains(lower(x), 'budget') AS INT) + CAST(contains(lower(x), 'ledger') AS INT) + CAST(contains(lower(x), 'review') AS INT) AS hits FROM l)
      SELECT doc_id, CAST(line AS INT) AS line, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, line) AS n FROM s) WHERE n = 1 AND hits > 0""",
    "passage_cover": "SELECT doc_id, length(text) AS n_chars FROM documents WHERE active AND doc_id IS NOT NULL AND text IS NOT NULL",
    "expansion_lines": _LINES + "SELECT * FROM lines",
    "expansion_status": _LINES
    + """SELECT coalesce(model, '?') AS model, count(*) AS n, avg(CAST(s = 'ok' AS DOUBLE)) AS ok_rate, avg(CAST(s = 'format_error' AS DOUBLE)) AS format_error_rate, 0.0::DOUBLE AS generation_error_rate FROM
      (SELECT model, CASE WHEN count(line) = 0 OR count(problem) > 0 THEN 'format_error' ELSE 'ok' END AS s FROM rows_ LEFT JOIN lines USING (record_id) GROUP BY record_id, model) GROUP BY 1""",
    "expansion_queries": _LINES
    + """, kept AS (SELECT r.record_id, query, kind, text FROM rows_ r JOIN lines l ON r.record_id = l.record_id WHERE text IS NOT NULL),
      all_ AS (SELECT * FROM kept UNION ALL SELECT record_id, query, 'hyde', 'Information about ' || query FROM rows_ WHERE record_id NOT IN (SELECT record_id FROM kept)
        UNION ALL SELECT record_id, query, unnest(['lex', 'vec']), query FROM rows_ WHERE record_id NOT IN (SELECT record_id FROM kept))
      SELECT DISTINCT record_id, kind, text FROM all_ WHERE query IS NOT NULL AND trim(text) <> trim(query)""",
    "expansion_strict": r"""WITH r AS (SELECT DISTINCT record_id, output FROM qmd_expansion_locations WHERE record_id IS NOT NULL),
      k AS (SELECT record_id, list_filter(list_transform(output, lambda e: {'k': lower(trim(e[1])), 't': trim(e[2])}), lambda e: e.k IN ('hyde', 'vec') AND coalesce(e.t, '') <> '') AS o FROM r),
      c AS (SELECT record_id, len(list_filter(o, lambda e: e.k = 'hyde')) AS h, len(list_filter(o, lambda e: e.k = 'vec')) AS v, len(list_filter(o, lambda e: contains(e.t, chr(10)))) AS broken FROM k)
      SELECT record_id, CAST(h + v AS INT) AS n FROM c WHERE h = 1 AND v BETWEEN 1 AND 2 AND broken = 0""",
    "slugs": r"""WITH p AS (SELECT doc_id, string_split(replace(path, '___', '/'), '/') AS s FROM documents WHERE active AND doc_id IS NOT NULL AND path IS NOT NULL),
      e AS (SELECT doc_id, s[:-2] AS folders, s[-1] AS last, regexp_extract(s[-1], '(\.[A-Za-z0-9]+)$', 1) AS ext FROM p)
      SELECT doc_id, array_to_string(list_append(list_filter(list_transform(folders, lambda x: regexp_replace(regexp_replace(x, '[^\p{L}\p{N}$]+', '-', 'g'), '^-+|-+$', '', 'g')), lambda x: x <> ''),
        regexp_replace(regexp_replace(substring(last, 1, length(last) - length(ext)), '[^\p{L}\p{N}$]+', '-', 'g'), '^-+|-+$', '', 'g') || ext), '/') AS slug FROM e""",
    "format_csv": _RESULTS + f"SELECT docid, '#' || docid || ',' || printf('%.4f', floor(score * 10000 + 0.5) / 10000) || ',' || {_csv('file')} || ',' || {_csv('title')} || ',' || {_csv('context')} || ',1,' || {_csv('snippet')} AS row FROM r",
    "format_files": _RESULTS + "SELECT docid, '#' || docid || ',' || printf('%.2f', score) || ',' || file || CASE WHEN context IS NULL THEN '' ELSE ',\"' || replace(context, '\"', '\"\"') || '\"' END AS row FROM r",
    "format_xml": _RESULTS
    + f"""SELECT docid, '<file docid="#' || docid || '" name="' || {_xml('file')} || '"' || CASE WHEN title IS NULL THEN '' ELSE ' title="' || {_xml('title')} || '"' END ||
      CASE WHEN context IS NULL THEN '' ELSE ' context="' || {_xml('context')} || '"' END || '>' || chr(10) || {_xml('snippet')} || chr(10) || '</file>' AS row FROM r""",
    "format_md": _RESULTS
    + """SELECT docid, '---' || chr(10) || '# ' || coalesce(title, file) || chr(10) || chr(10) || '**docid:** `#' || docid || '`' || chr(10) ||
      CASE WHEN context IS NULL THEN '' ELSE '**context:** ' || context || chr(10) END || chr(10) || snippet || chr(10) AS row FROM r""",
}
