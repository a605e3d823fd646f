"""Retrieval quality over judged rankings.

Rankings are ``qid, rank, doc`` (rank from 1, distinct documents); judgements ``qid, doc`` list the
relevant documents. Queries without a relevant document are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10, 20, 30)


def _hits(rankings: DataFrame, relevant: DataFrame) -> DataFrame:
    expected = relevant.groupBy("qid").agg(F.count_distinct("doc").alias("expected"))
    found = rankings.join(relevant.distinct(), ["qid", "doc"]).select("qid", "rank")
    return expected.join(found, "qid", "left")


def _within(c: int) -> Column:
    return F.sum(F.when(F.col("rank") <= c, 1).otherwise(0))


def query_metrics(rankings: DataFrame, relevant: DataFrame, k: int = 10, cutoffs: tuple = CUTOFFS) -> DataFrame:
    """Per query: ``precision_k`` (hits over the smaller of k and expected), ``recall``, ``recall_c``, ``mrr``,
    ``f1``, ``mrr_10`` and binary ``ndcg_10``."""
    gain = F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    aggs = [F.count("rank").alias("hits"), _within(k).alias("hits_k"), F.min("rank").alias("first"), gain.alias("dcg"), *[_within(c).alias(f"h{c}") for c in cutoffs]]
    by = _hits(rankings, relevant).groupBy("qid", "expected").agg(*aggs)
    e = F.col("expected")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(e, F.lit(10))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    precision, recall = F.col("hits_k") / F.least(F.lit(k), e), F.col("hits") / e
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    first = F.coalesce(1 / F.col("first"), F.lit(0.0))
    return by.select(
        "qid",
        precision.alias(f"precision_{k}"),
        recall.alias("recall"),
        *[(F.col(f"h{c}") / e).alias(f"recall_{c}") for c in cutoffs],
        first.alias("mrr"),
        F.when(F.col("first") <= 10, first).otherwise(0.0).alias("mrr_10"),
        f1.alias("f1"),
        (F.col("dcg") / ideal).alias("ndcg_10"),
    )


def macro(metrics: DataFrame, by: list[str] = ()) -> DataFrame:
    """Means of all metrics over the queries, and their number."""
    names = [c for c in metrics.columns if c not in {"qid", *by}]
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(c) for c in names])


def hit_rates(rankings: DataFrame, expected: DataFrame, ks: tuple = (1, 3, 5)) -> DataFrame:
    """Share of queries of each difficulty with the expected document among the first k.

    expected: ``qid, doc, difficulty``."""
    best = expected.join(rankings, ["qid", "doc"], "left").groupBy("qid", "difficulty").agg(F.min("rank").alias("rank"))
    return best.groupBy("difficulty").agg(F.count(F.lit(1)).alias("queries"), *[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks])


def micro(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Micro precision, recall and F1 from ``hits, said, wanted``."""
    s = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("hits", "said", "wanted")])
    return s.select(*by, (F.col("hits") / F.col("said")).alias("precision"), (F.col("hits") / F.col("wanted")).alias("recall"), (2 * F.col("hits") / (F.col("said") + F.col("wanted"))).alias("f1"))


def status_rates(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Shares of ``ok``, ``format_error`` and ``generation_error`` in ``status``."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col("status") == s).cast("double")).alias(f"{s}_rate") for s in ("ok", "format_error", "generation_error")])


def gate(deltas: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``passed``: the mean delta over sources is positive and no source loses more than the tolerance."""
    return deltas.agg(F.avg("delta").alias("macro_delta"), F.min("delta").alias("worst"), ((F.avg("delta") > 0) & F.every(F.col("delta") >= -tolerance)).alias("passed"))


def paired_bootstrap(deltas: DataFrame, rounds: int = 1000, seed: int = 13) -> DataFrame:
    """``macro_delta, low, high``: percentile interval of the macro mean of ``source, delta`` rows.

    Each round draws every row Poisson(1) times, by a generator seeded with the row's id, so the draw does not depend on where the
    row lies. A task adds up the rounds of its rows in arrays and sends one pair of arrays per source.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for source, delta, key in zip(pdf["source"], pdf["delta"], pdf["key"]):
                times = np.random.Generator(np.random.Philox(key=int(key) & (1 << 64) - 1)).poisson(1.0, rounds)
                total = sums.setdefault(source, (np.zeros(rounds), np.zeros(rounds)))
                total[0][:] += delta * times
                total[1][:] += times
        yield pd.DataFrame({"source": pd.Series(list(sums), dtype=object), "s": pd.Series([v[0] for v in sums.values()], dtype=object), "n": pd.Series([v[1] for v in sums.values()], dtype=object)})

    keyed = deltas.where("delta is not null").select("source", F.col("delta").cast("double").alias("delta"), F.xxhash64(F.lit(seed), "qid").alias("key"))
    kind = dict(deltas.dtypes)["source"]
    parts = keyed.mapInPandas(draw, f"source {kind}, s array<double>, n array<double>")
    per = parts.select("source", F.posexplode(F.arrays_zip("s", "n")).alias("round", "x")).groupBy("round", "source").agg((F.sum("x.s") / F.nullif(F.sum("x.n"), F.lit(0.0))).alias("m"))
    rounds_ = per.groupBy("round").agg(F.avg("m").alias("m"))
    real = deltas.groupBy("source").agg(F.avg("delta").alias("m")).agg(F.avg("m").alias("macro_delta"))
    return rounds_.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high")).crossJoin(real)  # one row each
