"""Benchmark of a store's backends over judged queries."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..session import materialize
from .hybrid import Store

BACKENDS = ("bm25", "vector", "hybrid", "full")


def run_backend(store: Store, backend: str, query: str, limit: int) -> DataFrame:
    """``doc, rank`` of one backend: lexical, vector, fused without or with reranking."""
    if backend == "bm25":
        return store.search_lexical(query, limit).select("doc", "rank")
    if backend == "vector":
        return store.search_vector(query, limit, 0.0).select("doc", "rank")
    return store.query(query, limit, reranked=backend == "full").select("doc", "rank")


def benchmark(store: Store, queries: list[tuple[str, str]], relevant: DataFrame, backends: tuple = BACKENDS, limit: int = 30) -> DataFrame:
    """``backend, qid, seconds, failed`` and all metrics of each query; a query that fails has no metrics.

    queries: (qid, text), a benchmark's stated list; relevant: ``qid, doc``. Vector backends are left out of a store without vectors.
    """
    spark = store.spark
    use = [b for b in backends if b != "vector" or (store.vectors is not None and store.embed)]
    rows, out = [], None
    for b in use:
        rankings = None
        for qid, text in queries:
            began = time.perf_counter()
            try:
                got = materialize(run_backend(store, b, text, limit).withColumn("qid", F.lit(qid)), "benchmark")
                rankings = got if rankings is None else rankings.unionByName(got)
                rows.append((b, qid, time.perf_counter() - began, False))
            except ValueError:
                rows.append((b, qid, time.perf_counter() - began, True))
        if rankings is not None:
            part = metrics.query_metrics(rankings.select("qid", "rank", "doc"), relevant).withColumn("backend", F.lit(b))
            out = part if out is None else out.unionByName(part)
    times = spark.createDataFrame(rows, "backend string, qid string, seconds double, failed boolean")
    if out is None:
        return times
    return times.join(out, ["backend", "qid"], "left")


def summary(results: DataFrame) -> DataFrame:
    """Means per backend; failed queries count as failures only."""
    names = [c for c in results.columns if c not in ("backend", "qid", "failed")]
    ok = [F.avg(F.when(~F.col("failed"), F.col(c))).alias(c) for c in names]
    return results.groupBy("backend").agg(F.count(F.lit(1)).alias("queries"), F.count_if("failed").alias("failures"), *ok)
