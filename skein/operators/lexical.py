"""Fielded BM25 over a positional inverted index.

The index is two tables: postings ``(term, doc, field, pos)``, written clustered by term so that a
query reads the row groups of its terms only, and document lengths. A query, or a whole table of
queries, is parsed into phrases; all of them are answered by one pass: the query's terms are joined
with the postings, occurrences of a phrase are the starts ``pos - offset`` that all of its terms
share, and frequencies, scores, conjunction and exclusion are plain aggregations. No self-joins.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import BASES, MARKED, tokens
from ..session import broadcast_rows, materialize
from .stemming import porter_stem

#: BM25 parameters, weights of path, title and body, floor of the idf.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
FIELD_WEIGHTS = {"path": 1.5, "title": 4.0, "body": 1.0}

_FOLD = str.maketrans(MARKED, BASES)
_CJK = re.compile(r"[㐀-䶿一-鿿豈-﫿぀-ヿㇰ-ㇿ가-힯]")


@dataclass(frozen=True)
class Phrase:
    """Adjacent terms; ``prefix``: the last one matches longer terms too; ``negative``: excludes."""

    terms: tuple[str, ...]
    prefix: bool = False
    negative: bool = False


def _plain_tokens(text: str) -> list[str]:
    folded = _CJK.sub(lambda m: f" {m[0]} ", text.lower().translate(_FOLD))
    out, now = [], ""
    for ch in folded + " ":
        if unicodedata.category(ch)[0] in "LN":
            now += ch
        elif now:
            out.append(now)
            now = ""
    return out


def check_lexical(query: str) -> str | None:
    """Why a lexical query is refused, if it is."""
    if "\n" in query or "\r" in query:
        return "a lexical query must be a single line"
    if query.count('"') % 2:
        return "a lexical query has an unmatched double quote"
    return None


def check_semantic(query: str) -> str | None:
    """Why a semantic query is refused, if it is: it must not use exclusion."""
    return "exclusion is for lexical queries only" if re.search(r'(?:^|\s)-[\w"]', query) else None


def parse_query(query: str) -> list[Phrase]:
    """Phrases of ``"exact words"``, ``plain`` (prefix match), ``com-pound`` (phrase), each after an
    optional ``-`` (exclusion). Without a positive phrase there is nothing to search."""
    found = []
    for m in re.finditer(r'(-?)(?:"([^"]*)(?:"|$)|([^\s"]+))', query.strip()):
        quoted = m[2] is not None
        terms = tuple(_plain_tokens(m[2] if quoted else m[3]))
        if terms:
            single = not quoted and len(terms) == 1 and not re.search(r"[^\w']", m[3], re.UNICODE) and not _CJK.search(m[3])
            found.append(Phrase(terms, single, bool(m[1])))
    return found if any(not p.negative for p in found) else []


def postings(docs: DataFrame, doc: str, fields: dict[str, str], stem: bool = False) -> DataFrame:
    """``term, doc, field, pos`` of the columns ``fields`` (field name -> column)."""
    arrays = [F.struct(F.lit(name).alias("field"), tokens(F.col(col)).alias("terms")) for name, col in fields.items()]
    per_field = docs.select(F.col(doc).alias("doc"), F.explode(F.array(*arrays)).alias("f"))
    out = per_field.select("doc", F.col("f.field").alias("field"), F.posexplode("f.terms").alias("pos", "term")).select("term", "doc", "field", "pos")
    if not stem:
        return out
    stems = out.select("term").distinct().mapInPandas(_stem_batches, "term string, stem string")
    return out.join(stems, "term").select(F.col("stem").alias("term"), "doc", "field", "pos")


def _stem_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(stem=[porter_stem(t) for t in pdf["term"]])


def lengths(docs: DataFrame, doc: str, fields: dict[str, str]) -> DataFrame:
    """``doc, len``: tokens of all fields."""
    return docs.select(F.col(doc).alias("doc"), sum(F.size(tokens(F.col(c))) for c in fields.values()).alias("len"))


@dataclass
class LexicalIndex:
    """Postings and lengths; ``n`` documents of ``mean`` tokens."""

    postings: DataFrame
    lengths: DataFrame
    n: int
    mean: float
    stem: bool = False


def _stats(lens: DataFrame) -> tuple[int, float]:
    row = lens.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("t")).first()
    return row["n"], (row["t"] or 0) / max(1, row["n"])


def build_index(docs: DataFrame, doc: str, fields: dict[str, str], path: str | None = None, stem: bool = False) -> LexicalIndex:
    """Index of ``docs``. With ``path`` it is written there, clustered by term, and read back."""
    spark = docs.sparkSession
    post, lens = postings(docs, doc, fields, stem), lengths(docs, doc, fields)
    if path is None:
        post = materialize(post.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc"), "postings")
        lens = materialize(lens, "lengths")
    else:
        post.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
        lens.write.mode("overwrite").parquet(f"{path}/lengths")
        spark.createDataFrame([(stem,)], "stem boolean").write.mode("overwrite").parquet(f"{path}/kind")
        return open_index(spark, path)
    return LexicalIndex(post, lens, *_stats(lens), stem)


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    """An index that :func:`build_index` has written; nothing is read yet but its statistics. Postings are clustered by
    term, so a search reads the row groups of its terms only."""
    post, lens = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
    return LexicalIndex(post, lens, *_stats(lens), spark.read.parquet(f"{path}/kind").first()["stem"])


def direct_index(docs: DataFrame, doc: str, fields: dict[str, str], queries: list[str]) -> LexicalIndex:
    """An index of the given queries' terms only, straight from the documents: one scan in which each text
    is cut into tokens once; its length and the wanted tokens are all that is kept."""
    terms = {t for q in queries for p in parse_query(q) for t in p.terms}
    starts = sorted({p.terms[-1] for q in queries for p in parse_query(q) if p.prefix})
    whole = sorted(terms - set(starts))

    def wanted(t: Column) -> Column:
        hit = t.isin(whole) if whole else F.lit(False)
        for x in starts:
            hit = hit | t.startswith(x)
        return hit

    cut = docs.select(F.col(doc).alias("doc"), *[tokens(F.col(c)).alias(f"t_{f}") for f, c in fields.items()])

    def hits(field: str) -> Column:
        placed = F.transform(F.col(f"t_{field}"), lambda t, i: F.when(wanted(t), F.struct(t.alias("term"), F.lit(field).alias("field"), i.alias("pos"))))
        return F.filter(placed, lambda x: x.isNotNull())

    kept = cut.select("doc", sum(F.size(f"t_{f}") for f in fields).alias("len"), F.concat(*[hits(f) for f in fields]).alias("hits"))
    kept = materialize(kept, "direct_index")
    post = kept.select("doc", F.explode("hits").alias("h")).select("h.term", "doc", "h.field", "h.pos")
    return LexicalIndex(post, kept.select("doc", "len"), *_stats(kept))


def search(spark: SparkSession, index: LexicalIndex, queries: list[tuple[str, str]], scope: DataFrame | None = None) -> DataFrame:
    """``qid, doc, score`` of every match of each (qid, query); ``scope`` (``doc``) restricts the matches.

    Document frequencies are those of the whole index, whatever the scope. ``score`` is
    ``s / (1 + s)`` of the BM25 sum ``s``.
    """
    rows, need = [], []
    for qid, text in queries:
        if bad := check_lexical(text):
            raise ValueError(bad)
        phrases = parse_query(text)
        need.append((qid, sum(not p.negative for p in phrases)))
        for k, p in enumerate(phrases):
            for i, t in enumerate(p.terms):
                rows.append((qid, k, p.negative, len(p.terms), i, porter_stem(t) if index.stem else t, p.prefix and i == len(p.terms) - 1))
    schema = "qid string, k int, negative boolean, size int, offset int, want string, prefix boolean"
    wanted = broadcast_rows(spark.createDataFrame(rows, schema), len(rows))
    post = index.postings
    # The condition on the terms alone reaches the scan of a written index.
    literal = F.lit(False)
    for w, prefix in sorted({(r[5], r[6]) for r in rows}):
        literal = literal | (F.col("term").startswith(w) if prefix else F.col("term") == w)
    if len(rows) <= 1000:
        post = post.where(literal)
    exact = post.join(wanted.where("not prefix"), F.col("term") == F.col("want"))
    longer = post.join(wanted.where("prefix"), F.col("term").startswith(F.col("want"))) if any(r[6] for r in rows) else None
    hits = exact if longer is None else exact.unionByName(longer)
    starts = hits.groupBy("qid", "k", "negative", "size", "doc", "field", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count_distinct("offset").alias("got"))
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in FIELD_WEIGHTS.items()], F.lit(1.0))
    freq = starts.where("got = size").groupBy("qid", "k", "negative", "doc").agg(F.sum(weight).alias("tf"))
    df = freq.where("not negative").groupBy("qid", "k").agg(F.count(F.lit(1)).alias("df"))
    df = df.select("qid", "k", F.greatest(F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR)).alias("idf"))
    df = broadcast_rows(df, len(rows))
    excluded = freq.where("negative").select("qid", "doc").distinct()
    if scope is not None:
        freq = freq.join(scope, "doc", "left_semi")
    positive = freq.where("not negative").join(df, ["qid", "k"]).join(index.lengths, "doc")
    part = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(index.mean)))
    summed = positive.groupBy("qid", "doc").agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("matched"))
    required = broadcast_rows(spark.createDataFrame(need, "qid string, required int"), len(need))
    kept = summed.join(required, "qid").where("matched = required")
    if any(r[2] for r in rows):
        kept = kept.join(excluded, ["qid", "doc"], "left_anti")
    return kept.select("qid", "doc", (F.abs("s") / (1 + F.abs("s"))).alias("score"))


def top(matches: DataFrame, limit: int, tie: Column | str = "doc") -> DataFrame:
    """The ``limit`` best documents of each query with ``rank`` from 1; ties by ``tie``."""
    order = W.partitionBy("qid").orderBy(F.desc("score"), tie)
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
