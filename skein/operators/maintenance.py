"""State of collections, embedding work, clean-up."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

#: Share of documents without vectors and days without change that warn; cache entries kept; occupancy below which vectors are repacked.
WARN_SHARE, WARN_DAYS, CACHE_KEEP, REPACK_BELOW = 0.1, 14, 1000, 0.9


def collection_stats(documents: DataFrame) -> DataFrame:
    """``collection, documents, active, last_modified``, latest first."""
    return documents.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("active")).alias("active"), F.max(F.when(F.col("active"), F.col("modified_at"))).alias("last_modified"))


def pending_embeddings(documents: DataFrame, vectors: DataFrame, model: str | None = None) -> DataFrame:
    """``hash, chunks, expected`` of active content without its complete set of vectors (``hash, seq, total_chunks``)."""
    kept = vectors if model is None else vectors.where(F.col("model") == model)
    have = kept.groupBy("hash").agg(F.count_distinct("seq").alias("chunks"), F.max("total_chunks").alias("expected"))
    need = documents.where("active and hash is not null").select("hash").distinct()
    return need.join(have, "hash", "left").where("chunks is null or chunks < expected")


def partial_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors of documents whose set is complete."""
    full = vectors.groupBy("hash").agg(F.count_distinct("seq").alias("n"), F.max("total_chunks").alias("t")).where("n = t").select("hash")
    return vectors.join(full, "hash", "left_semi")


def vector_rows(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per chunk and active collection of its content."""
    return vectors.join(documents.where("active").select("hash", "collection").distinct(), "hash")


def missing_rows(vectors: DataFrame, documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``hash, seq, collection`` that a collection lacks although another one has the content's vectors."""
    want = vector_rows(vectors, documents).select("hash", "seq", "collection")
    return want.join(rows.select("hash", "seq", "collection"), ["hash", "seq", "collection"], "left_anti")


def orphaned_vectors(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors whose content no active document has."""
    return vectors.join(documents.where("active").select("hash").distinct(), "hash", "left_anti")


def orphaned_content(content: DataFrame, documents: DataFrame, keep_inactive: bool) -> DataFrame:
    """Content that no document refers to. Clean-up keeps what inactive documents still refer to
    (``keep_inactive``); the status count ignores those."""
    held = documents if keep_inactive else documents.where("active")
    return content.join(held.where("hash is not null").select("hash").distinct(), "hash", "left_anti")


def exclusive_hashes(documents: DataFrame, collection: str) -> DataFrame:
    """Content hashes that occur in this collection only."""
    by = documents.where("active and hash is not null").groupBy("hash").agg(F.count_distinct("collection").alias("n"), F.min("collection").alias("c"))
    return by.where((F.col("n") == 1) & (F.col("c") == collection)).select("hash")


def health(documents: DataFrame, vectors: DataFrame, now: Column) -> DataFrame:
    """``documents, pending, days_stale, warn_pending, warn_stale``."""
    base = documents.where("active").agg(F.count(F.lit(1)).alias("documents"), F.max("modified_at").alias("last"))
    late = pending_embeddings(documents, vectors).agg(F.count(F.lit(1)).alias("pending"))
    both = base.crossJoin(late)  # one row each
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp("last")) / 86400)
    return both.select("documents", "pending", days.alias("days_stale"), (F.col("pending") >= WARN_SHARE * F.col("documents")).alias("warn_pending"), (days >= WARN_DAYS).alias("warn_stale"))


def cleanup_preview(content: DataFrame, documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """``kind, rows``: what a clean-up would remove."""
    one = lambda k, df: df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("rows"))
    return one("inactive_documents", documents.where("not active")).unionByName(one("orphaned_content", orphaned_content(content, documents, True))).unionByName(one("orphaned_vectors", orphaned_vectors(vectors, documents)))


def keep_newest(cache: DataFrame, keep: int = CACHE_KEEP) -> DataFrame:
    """The newest rows of a cache."""
    return cache.orderBy(F.desc("created_at"), "hash").limit(keep)


def rename_collection(documents: DataFrame, old: str, new: str) -> DataFrame:
    return documents.withColumn("collection", F.when(F.col("collection") == old, new).otherwise(F.col("collection")))


def without_context(documents: DataFrame, contexts: DataFrame) -> DataFrame:
    """``collection, top``: first path segments of active documents that no context of the collection covers."""
    top = documents.where("active").select("collection", F.element_at(F.split("path", "/"), 1).alias("top")).distinct()
    have = contexts.where("collection is not null").select("collection", F.element_at(F.split(F.regexp_replace("prefix", "^/+", ""), "/"), 1).alias("top")).distinct()
    whole = have.where("top = ''").select("collection")
    return top.join(have, ["collection", "top"], "left_anti").join(whole, "collection", "left_anti")


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a table, whatever the order of its rows: the rows' digests are summed as eight numbers of 32 bits (so partial sums
    combine before the shuffle and no task holds a list), and the sums and the number of rows are hashed."""
    digest = F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in columns]), 256)
    d = rows.select(digest.alias("d"))
    parts = [F.sum(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(8)]
    sums = d.agg(F.count(F.lit(1)).alias("n"), *parts)
    return sums.select(F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(8)]), 256).alias("fingerprint"))


def embed(chunks: DataFrame, embed_texts, text_col: str = "chunk", dim: int | None = None) -> DataFrame:
    """Adds ``embedding`` and ``error`` by ``embed_texts(texts) -> vectors or exceptions``, once per distinct
    text, in Arrow batches; a failed batch is tried again text by text and failures stay as rows."""
    @F.pandas_udf("embedding array<float>, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(t):
            try:
                return list(map(float, embed_texts([t])[0])), None
            except Exception as e:  # noqa: BLE001
                return None, str(e)[:200]

        try:
            got = [(list(map(float, v)), None) for v in embed_texts(texts.tolist())]
        except Exception:  # noqa: BLE001
            got = [one(t) for t in texts]
        if dim is not None:
            got = [(v, e) if v is None or len(v) == dim else (None, f"dimension {len(v)} instead of {dim}") for v, e in got]
        return pd.DataFrame(got, columns=["embedding", "error"])

    distinct = chunks.select(text_col).distinct().withColumn("r", run(text_col)).select(text_col, "r.*")
    return chunks.join(distinct, text_col)


#: Tries of a failed text, and the share of failures that ends a run.
ATTEMPTS, ABORT_SHARE = 3, 0.8


def embed_with_retry(chunks: DataFrame, embed_texts, text_col: str = "chunk", dim: int | None = None, attempts: int = ATTEMPTS, abort_share: float = ABORT_SHARE) -> DataFrame:
    """:func:`embed`, after which only the failed texts are tried again, up to ``attempts`` times in all; failures stay as rows.

    Ends with an error if more than ``abort_share`` of the texts fail at first, as then the model and not the text is at fault.
    """
    got = materialize(embed(chunks, embed_texts, text_col, dim), "embedded")
    row = got.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("bad")).first()
    if row["n"] and row["bad"] > abort_share * row["n"]:
        raise RuntimeError(f"{row['bad']} of {row['n']} texts could not be embedded")
    for _ in range(attempts - 1):
        failed = got.where("error is not null")
        if failed.isEmpty():
            break
        again = embed(failed.drop("embedding", "error"), embed_texts, text_col, dim)
        got = materialize(got.where("error is null").unionByName(again), "embedded")
    return got


#: Ids of one block of :func:`batches`; a task cuts one block.
BLOCK_IDS = 1 << 16


def batches(rows: DataFrame, order: str, size_col: str, partition: list[str], max_rows: int = 64, max_bytes: int = 64 << 20, block: int = BLOCK_IDS) -> DataFrame:
    """``partition, block, order, batch``: consecutive rows, a new batch where one more row would exceed the count or the summed size.

    Each cut depends on the one before, so rows are cut in blocks of ``block`` consecutive integers of ``order``,
    which bounds what a task holds however many rows a partition has; a batch never spans two blocks.
    """
    kinds = dict(rows.dtypes)
    keyed = rows.select(*partition, F.floor(F.col(order) / block).cast("long").alias("block"), order, F.greatest(F.col(size_col), F.lit(0)).cast("long").alias("__size"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out, count, used, number = [], 0, 0, 0
        for size in pdf["__size"]:
            if count and (count >= max_rows or used + size > max_bytes):
                count, used, number = 0, 0, number + 1
            out.append(number)
            count, used = count + 1, used + size
        return pdf.drop(columns="__size").assign(batch=out)

    layout = ", ".join([*(f"{c} {kinds[c]}" for c in partition), "block long", f"{order} {kinds[order]}", "batch long"])
    return keyed.groupBy(*partition, "block").applyInPandas(run, layout)


def self_check(vectors: DataFrame, chunks: DataFrame, embed_texts, n: int = 20, seed: int = 3, tolerance: float = 1e-4) -> DataFrame:
    """``hash, seq, distance, mismatch`` of a random sample of stored vectors embedded again at their saved place.

    vectors: ``hash, seq, embedding``; chunks: ``hash, seq, chunk``.
    """
    from .vector import cosine_distance

    sample = vectors.orderBy(F.rand(seed)).limit(n).withColumnRenamed("embedding", "stored").join(chunks, ["hash", "seq"])
    fresh = embed(sample, embed_texts)
    d = F.coalesce(cosine_distance(F.col("stored"), F.col("embedding")), F.lit(float("inf")))
    return fresh.select("hash", "seq", d.alias("distance"), (d > tolerance).alias("mismatch"))
