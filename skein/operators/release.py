"""Preparation and audit of a release of queries, judgements and documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_query


def prepare_source(judged: DataFrame, queries: DataFrame, holdouts: DataFrame) -> DataFrame:
    """``source_id, qid, query, state`` of every query with a relevant judgement: ``missing_query``, ``empty_query``,
    ``exact_holdout_collision`` or ``admitted``, the first that holds.

    judged: ``source_id, qid`` (relevant ones); queries: ``source_id, qid, query``; holdouts: ``text`` (normalised).
    """
    known = queries.where("qid is not null").groupBy("source_id", "qid").agg(F.min("query").alias("query"), F.lit(True).alias("__known"))
    held = holdouts.where("text <> ''").select(F.col("text").alias("__t")).distinct().withColumn("__held", F.lit(True))
    rows = judged.where("qid is not null and source_id is not null").distinct().join(known, ["source_id", "qid"], "left").withColumn("__t", normal_query(F.coalesce("query", F.lit(""))))
    met = rows.join(held, "__t", "left")
    state = F.when(F.col("__known").isNull(), "missing_query").when(F.col("__t") == "", "empty_query").when(F.col("__held"), "exact_holdout_collision").otherwise("admitted")
    return met.select("source_id", "qid", "query", state.alias("state"))


def release_audit(queries: DataFrame, judgements: DataFrame, documents: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """``check, rows``: how many rows break each rule; a sound release has none.

    queries: ``id, text, split, source``; judgements: ``split, query_id, doc, score``; documents: ``doc``; families: ``id, family``.
    Every check is an aggregate or an anti-join on its key.
    """
    q = queries.withColumn("__t", normal_query(F.col("text")))
    spread = lambda rows, key: rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1")
    repeated = lambda key: q.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy("split", key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    one = lambda name, df: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("rows"))
    per_source = q.where("split = 'train' and source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    checks = [
        one("duplicate_id", repeated("id")),
        one("duplicate_text", repeated("__t")),
        one("id_across_splits", spread(q, "id")),
        one("text_across_splits", spread(q, "__t")),
        one("dangling_query", judgements.join(q.select(F.col("id").alias("query_id"), "split").distinct(), ["split", "query_id"], "left_anti")),
        one("dangling_document", judgements.join(documents.select("doc").distinct(), "doc", "left_anti")),
        one("not_binary", judgements.where("score is null or score not in (0, 1)")),
        per_source.agg(F.lit("unbalanced_source").alias("check"), F.coalesce(F.sum("n") - F.min("n") * F.count(F.lit(1)), F.lit(0)).alias("rows")),
    ]
    if families is not None:
        checks.append(one("family_across_splits", spread(q.join(families, "id"), "family")))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def tree_hash(rows: DataFrame, path: str, digest: str) -> str:
    """SHA-256 over the lines ``path NUL digest`` in byte order of the paths.

    The digest is one chain, so it cannot be split; the sorted lines stream through the driver partition by partition, and none is kept.
    """
    chain = hashlib.sha256()
    for r in rows.select(F.col(path).alias("p"), F.col(digest).alias("d")).where("p is not null and d is not null").orderBy("p", "d").toLocalIterator():
        chain.update(f"{r['p']}\0{r['d']}\n".encode())
    return chain.hexdigest()


def size_label(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    x = n.cast("double")
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", x / (1 << 10))).when(n < 1 << 30, F.format_string("%.1f MB", x / (1 << 20))).otherwise(F.format_string("%.1f GB", x / (1 << 30)))


def span_label(seconds: Column) -> Column:
    """A duration as seconds, minutes and seconds, or hours and minutes."""
    s = seconds.cast("double")
    whole = lambda c: F.floor(c).cast("string")
    short = F.concat(F.floor(s + 0.5).cast("string"), F.lit("s"))
    return F.when(s < 60, short).when(s < 3600, F.concat(whole(s / 60), F.lit("m "), F.floor(s % 60 + 0.5).cast("string"), F.lit("s"))).otherwise(F.concat(whole(s / 3600), F.lit("h "), whole(s % 3600 / 60), F.lit("m")))


def age_label(then: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit up to days."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(f"{u} ago"))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))
