"""Filling fixed-capacity containers with items (problem 7).

An item of more than the capacity is cut into full containers and a rest; all other items stay
whole. Items are spread over shards by hash, each of a bounded number of items, and packed there
by vector best-fit in order of decreasing size: a container has a residual of tokens, of documents
and of attention cost (the sum of the squared lengths); an item may go where all three suffice.
Among those containers the one with the largest score is taken:

``norm``  the smallest weighted norm of what would be left;
``dot``   the largest weighted dot product of demand and residual.

The weights are the shard's mean demand for each resource relative to its capacity, so a resource
that hardly matters hardly weighs. The limits in use bind, each by itself: 32 documents keep short items from
crowding one container, and a cost of three quarters of the square of the capacity keeps a long item from company that it
would leave room for. An item whose own cost is beyond the limit has a container to itself. Each shard leaves a few containers open at its end, a share that
its size bounds (one in some thousands).

Defined cases: items of size 0 (null or empty texts) take no room and have no container; an item
as large as the capacity fills one; ties go to the older container; repeated ids are separate
items; containers depend on ids and texts only, not on how the table is partitioned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SHARD_ITEMS = 20_000


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int, max_cost: float, rule: str = "norm") -> np.ndarray:
    """Container number of each item; ``sizes`` must be in decreasing order and within the capacity."""
    limits = np.array([capacity, max_docs, max_cost], float)
    demand = np.stack([sizes, np.ones(len(sizes)), sizes.astype(float) ** 2], 1) / limits
    if len(sizes) and demand[:, 0].max() > 1 + 1e-12:
        raise ValueError("an item exceeds a container's capacity")
    weight = demand.mean(0) if len(sizes) else np.ones(3)
    left = np.empty((3, 1024))
    names = np.empty(1024, np.int64)
    out = np.empty(len(sizes), np.int64)
    live, made = 0, 0
    smallest = demand[-1] if len(sizes) else None
    eps = 1e-12
    for i, d in enumerate(demand):
        if d[2] > 1 + eps:
            out[i] = made
            made += 1
            continue
        room = left[:, :live]
        fits = np.flatnonzero((room[0] >= d[0] - eps) & (room[1] >= d[1] - eps) & (room[2] >= d[2] - eps))
        if len(fits):
            r = room[:, fits]
            if rule == "dot":
                score = (weight[0] * d[0]) * r[0] + (weight[1] * d[1]) * r[1] + (weight[2] * d[2]) * r[2]
            else:
                score = -(weight[0] * (r[0] - d[0]) ** 2 + weight[1] * (r[1] - d[1]) ** 2 + weight[2] * (r[2] - d[2]) ** 2)
            k = fits[np.argmax(score)]
        else:
            if live == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], 1)
                names = np.concatenate([names, np.empty_like(names)])
            k = live
            left[:, k], names[k] = 1.0, made
            live += 1
            made += 1
        left[:, k] -= d
        out[i] = names[k]
        if (left[:, k] < smallest - eps).any():  # nothing fits there any more
            left[:, k : live - 1], names[k : live - 1] = left[:, k + 1 : live].copy(), names[k + 1 : live].copy()
            live -= 1
    return out


def pieces_of(items: DataFrame, capacity: int) -> DataFrame:
    """``id, key, piece, start_token, n_tokens``: items over the capacity cut into full ones and a rest."""
    n = F.col("n_tokens")
    last = F.when(n > 0, F.ceil(n / capacity).cast("int") - 1).otherwise(0)
    cut = items.select("id", "key", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut.select("id", "key", "piece", start.alias("start_token"), F.least(n - start, F.lit(capacity)).cast("int").alias("n_tokens"))


#: Limits of a container: tokens, documents, and the sum of squared lengths.
#: The last is a share of the square of the capacity.
CAPACITY, MAX_DOCS, COST_SHARE = 2048, 32, 0.75


def pack(items: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: float | None = None, rule: str = "norm", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``id, piece, start_token, n_tokens, container`` for ``items`` (``id, key, n_tokens``; ``key`` is a hash of id and text)."""
    cost = COST_SHARE * capacity**2 if max_cost is None else float(max_cost)
    kind = dict(items.dtypes)["id"]
    pieces = materialize(pieces_of(items, capacity), "p7_pieces")
    filled = pieces.where("n_tokens > 0")
    shards = max(1, -(-filled.count() // shard_items))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "key", "piece"], ascending=[False, True, True])
        number = best_fit(pdf["n_tokens"].to_numpy(), capacity, max_docs, cost, rule)
        return pdf[["id", "piece", "start_token", "n_tokens"]].assign(container=number + (np.int64(pdf["shard"].iloc[0]) << 32))

    sharded = filled.withColumn("shard", F.pmod(F.xxhash64("key", "piece"), F.lit(shards)).cast("int"))
    packed = sharded.groupBy("shard").applyInPandas(run, f"id {kind}, piece int, start_token long, n_tokens int, container long")
    rest = pieces.where("n_tokens = 0").select("id", "piece", "start_token", "n_tokens", F.lit(None).cast("long").alias("container"))
    return packed.unionByName(rest)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``containers, pieces, tokens, unused_share, most_pieces, most_cost``; the cost of containers that hold several
    pieces, as a share of the limit."""
    filled = packed.where("container is not null")
    n = F.col("n_tokens").cast("double")
    per = filled.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("k"), F.sum(n * n).alias("cost"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("k").alias("pieces"),
        F.sum("used").alias("tokens"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
        F.max("k").alias("most_pieces"),
        (F.max(F.when(F.col("k") > 1, F.col("cost"))) / (COST_SHARE * capacity**2)).alias("most_cost"),
    )


def compare_rules(items: DataFrame) -> DataFrame:
    """The report of each rule, ``rule`` beside it."""
    items = materialize(items, "p7_items")
    reports = [fill_report(pack(items, rule=r)).withColumn("rule", F.lit(r)) for r in ("norm", "dot")]
    return reports[0].unionByName(reports[1])
