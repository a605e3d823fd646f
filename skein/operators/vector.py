"""Exact nearest neighbours by cosine distance.

Query vectors (a stated set) meet all rows in blocks: each Arrow batch of rows is multiplied with a
block of queries by NumPy and only the best ``k`` of each batch leave it; the rest is a window with a
group limit. The query side is broadcast in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

#: Query vectors held by a task at once.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; infinite for a zero vector or unequal lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(fine, 1 - dot(a, b) / norms).otherwise(F.lit(float("inf")))


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.stack(rows.to_list()).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(ids: np.ndarray, vecs: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["v"].notna()]
            if not len(pdf):
                continue
            rows, key = _unit(pdf["v"]), pdf["id"].to_numpy()
            distance = 1 - vecs @ rows.T
            zero = ~rows.any(1)
            distance[:, zero] = np.inf
            n = min(k, distance.shape[1])
            # the n-th distance and all ties with it, so that the tie rule can be applied later
            edge = np.partition(distance, n - 1, axis=1)[:, n - 1 : n]
            q, r = np.nonzero(distance <= edge + 1e-12)
            yield pd.DataFrame({"qid": ids[q], "id": key[r], "distance": distance[q, r]})

    return run


#: Rows that a task holds while all query blocks pass.
ROW_BLOCK = 50_000


def _searched(queries: DataFrame, side: DataFrame, id_col: str, vector_col: str, block: int, make, schema: str) -> DataFrame:
    """``make(ids, vectors)`` over the rows for all query vectors, in one pass over the rows.

    One block of queries travels with the task; more are written once, and each task opens them file by file beside its block of rows,
    so neither side goes through the driver and no scan is repeated.
    """
    source = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    few = source.limit(block + 1).collect()
    if not few:
        return side.sparkSession.createDataFrame([], schema)
    if len(few) <= block:
        return side.mapInPandas(make(np.array([x["id"] for x in few]), _unit(pd.Series([x["v"] for x in few]))), schema)
    paths = sorted(materialize(source, "queries").inputFiles())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= ROW_BLOCK:
                yield from passed(pd.concat(held))
                held = []
        if held:
            yield from passed(pd.concat(held))

    def passed(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for path in paths:
            system, inner = pafs.FileSystem.from_uri(path)
            with system.open_input_file(inner) as f:
                for part in pq.ParquetFile(f).iter_batches(block):
                    q = part.to_pandas()
                    yield from make(q["id"].to_numpy(), _unit(q["v"]))(iter([rows]))

    return side.mapInPandas(run, schema)


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``qid, id, distance, rank``: the ``k`` nearest rows of each query; ties by id."""
    kind = dict(rows.dtypes)[id_col]
    schema = f"qid {kind}, id {kind}, distance double"
    side = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    found = _searched(queries, side, id_col, vector_col, block, lambda ids, vecs: _best(ids, vecs, k), schema)
    order = W.partitionBy("qid").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best_groups(ids: np.ndarray, vecs: np.ndarray, k: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["v"].notna() & pdf["g"].notna()]
            if not len(pdf):
                continue
            pdf = pdf.sort_values(["g", "id"])
            groups, starts = np.unique(pdf["g"].to_numpy(), return_index=True)
            rows, key = _unit(pdf["v"]), pdf["id"].to_numpy()
            distance = np.round(1 - vecs @ rows.T, 9)
            distance[:, ~rows.any(1)] = np.inf
            low = np.minimum.reduceat(distance, starts, axis=1)
            # the first (smallest) id that reaches its group's minimum
            hit = distance == np.repeat(low, np.diff([*starts, len(key)]), axis=1)
            first = np.minimum.reduceat(np.where(hit, np.arange(len(key)), len(key)), starts, axis=1)
            n = len(groups) if k is None else min(k, len(groups))
            edge = np.partition(low, n - 1, axis=1)[:, n - 1 : n]
            q, g = np.nonzero(low <= edge)
            yield pd.DataFrame({"qid": ids[q], "g": groups[g], "id": key[first[q, g]], "distance": low[q, g]})

    return run


def nearest_groups(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, group_col: str, k: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """``qid, <group>, id, distance, rank``: groups (documents) by their nearest row (passage); the ``k`` nearest
    or all. A batch sends only its own best groups, so passages are folded before anything moves."""
    types = dict(rows.dtypes)
    schema = f"qid {dict(queries.dtypes)[id_col]}, g {types[group_col]}, id {types[id_col]}, distance double"
    side = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(group_col).alias("g"))
    found = _searched(queries, side, id_col, vector_col, block, lambda ids, vecs: _best_groups(ids, vecs, k), schema)
    best = found.groupBy("qid", "g").agg(F.min(F.struct("distance", "id")).alias("m")).select("qid", F.col("g").alias(group_col), "m.id", "m.distance")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("distance", group_col)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)
