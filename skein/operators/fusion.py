"""Fusion of ranked lists: reciprocal ranks, explain traces, rerank fusion.

Lists are rows ``qid, list, rank0, doc, weight`` (``rank0`` from 0) with optional attributes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The smoothing constant and the bonuses of first and second or third places.
K, FIRST_BONUS, NEXT_BONUS = 60, 0.05, 0.02


def list_weights(lists: DataFrame, structured: bool) -> DataFrame:
    """Weight 2 for the original query's lists, or in a structured query for the first list that is
    not empty; 1 for the others. Plain lists need a boolean column ``original``."""
    if structured:
        first = F.min("list").over(W.partitionBy("qid"))
        return lists.withColumn("weight", F.when(F.col("list") == first, 2.0).otherwise(1.0))
    return lists.withColumn("weight", F.when(F.col("original"), 2.0).otherwise(1.0))


def reciprocal_rank_fusion(lists: DataFrame, limit: int | None = None) -> DataFrame:
    """``qid, doc, score, best_rank, rank``: weighted sums of ``1 / (K + rank0 + 1)`` plus the bonus of the
    best rank; equal scores keep the order of first appearance."""
    share = F.col("weight") / (F.lit(K) + F.col("rank0") + 1)
    fused = lists.groupBy("qid", "doc").agg(F.sum(share).alias("base"), F.min("rank0").alias("best_rank"), F.min(F.struct("list", "rank0")).alias("seen"))
    bonus = F.when(F.col("best_rank") == 0, FIRST_BONUS).when(F.col("best_rank") <= 2, NEXT_BONUS).otherwise(0.0)
    scored = fused.select("qid", "doc", (F.col("base") + bonus).alias("score"), "best_rank", "seen")
    order = W.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "seen")
    ranked = scored.withColumn("rank", F.row_number().over(order)).drop("seen")
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def fusion_trace(lists: DataFrame) -> DataFrame:
    """``qid, doc, contributions, base, bonus, total``; contributions in list order with ranks from 1."""
    share = F.col("weight") / (F.lit(K) + F.col("rank0") + 1)
    one = F.struct(F.col("list").alias("list"), (F.col("rank0") + 1).alias("rank"), F.col("weight").alias("weight"), share.alias("share"))
    by = lists.groupBy("qid", "doc").agg(F.sort_array(F.collect_list(one)).alias("contributions"), F.sum(share).alias("base"), F.min("rank0").alias("best"))
    bonus = F.when(F.col("best") == 0, FIRST_BONUS).when(F.col("best") <= 2, NEXT_BONUS).otherwise(0.0)
    return by.select("qid", "doc", "contributions", "base", bonus.alias("bonus"), (F.col("base") + bonus).alias("total"))


def fuse_rerank(ranked: DataFrame, candidates: int = 40) -> DataFrame:
    """Candidates with ``rank`` (fusion) and ``rerank_score``: ordered by rerank score, then rank, and scored by
    both reciprocal ranks against the best possible."""
    first = F.coalesce(F.col("rank"), F.lit(candidates))
    order = W.partitionBy("qid").orderBy(F.desc("rerank_score"), first)
    ordered = ranked.withColumn("rerank_rank", F.row_number().over(order))
    score = (1 / (F.lit(K) + first) + 1 / (F.lit(K) + F.col("rerank_rank"))) / (2.0 / (K + 1))
    return ordered.withColumn("score", score)


def plain_rank_score(ranked: DataFrame) -> DataFrame:
    """Scores without reranking: the reciprocal of the fusion rank."""
    return ranked.withColumn("score", 1 / F.col("rank"))


def keep_best(results: DataFrame, by: str = "doc", least: float = 0.0, limit: int | None = None) -> DataFrame:
    """One row per query and document with the largest score, of at least ``least``, best first."""
    best = results.groupBy("qid", by).agg(F.max("score").alias("score")).where(F.col("score") >= least)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), by)))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def rerank(candidates: DataFrame, score_texts, text_col: str = "chunk") -> DataFrame:
    """Scores each distinct (query, chunk) once by ``score_texts(queries, texts) -> scores`` (an Arrow
    batch function) and joins the scores back; a missing score is 0."""
    @F.pandas_udf("double")
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(score_texts(q.tolist(), t.tolist()), dtype=float)

    distinct = candidates.select("query", text_col).distinct().withColumn("rerank_score", scored("query", text_col))
    return candidates.join(distinct, ["query", text_col], "left").fillna(0.0, ["rerank_score"])
