"""Samples with target category proportions (problem 5).

Of each input only the latest row counts; inputs outside the target strata are left out, the rest
is the pool. The sample is ``share`` of the pool. Each stratum needs the larger of its ``min_rows``
and its target share of the sample, rounded down; what the pool lacks is reported, never hidden.

Method: the pool's category moments are aggregated distributedly to one count per stratum (there are as many as
target rows); every moment of every Newton step is a function of these counts. Calibration is exponential tilting truncated at
bounds: the expected rows of stratum k are ``t_k exp(x_k lambda)``, held between the need (or the pool, if smaller) and the
pool, where ``t_k`` is its target and ``x_k`` marks its category in each of the target columns. Newton's method on the dual
finds the lambda for which the totals of each category and of the sample are met, so that what a floor or a
small pool takes from one stratum comes from or goes to strata of the same categories first. Totals that the bounds rule out
are met as nearly as they can be (a small ridge on the dual); the size of the sample is always met, unless the floors alone exceed it.
The expected rows over the pool's are the inclusion probabilities. The pivotal method draws with them:
within a stratum's hash buckets, then among the at most one undecided unit per bucket, then among those per stratum, so each
stratum gets its expected rows rounded down or up, and the sample its size. Strata taken whole or not at all
are never undecided and need no draw. The report counts what was really drawn.

Defined cases: null ids are no inputs; a null ``scored_at`` is older than any time; rows of the
same input and time are ordered by their values; null or unknown strata are outside the pool; an
empty pool gives an empty sample and a report in which each stratum with a minimum falls short;
extra columns are ignored.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_rows, materialize


def plain(c: Column) -> Column:
    """Lower case without white space at the ends."""
    return F.regexp_replace(F.lower(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def numbered_targets(targets: DataFrame, strata: list[str]) -> list[dict]:
    """The target rows in a fixed order; their number is the number of strata, not of data rows."""
    rows = targets.select(*[F.col(s) for s in strata], *[plain(F.col(s)).alias(f"k{i}") for i, s in enumerate(strata)], "target_share", "min_rows")
    return [r.asDict() for r in rows.dropna(subset=strata).dropDuplicates([f"k{i}" for i in range(len(strata))]).orderBy(*strata).collect()]


def pool_of(df: DataFrame, targets: list[dict], strata: list[str], id_col: str, time_col: str) -> DataFrame:
    """``id, stratum`` of each input whose latest row lies in a target stratum."""
    spark = df.sparkSession
    latest = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.struct(F.col(time_col), *[F.col(s) for s in strata])).alias("row"))
    keyed = latest.select("id", *[plain(F.col("row")[s]).alias(f"k{i}") for i, s in enumerate(strata)])
    keys = spark.createDataFrame(
        [(i, *[t[f"k{j}"] for j in range(len(strata))]) for i, t in enumerate(targets)],
        "stratum int, " + ", ".join(f"k{j} string" for j in range(len(strata))),
    )
    return keyed.join(broadcast_rows(keys, len(targets)), [f"k{j}" for j in range(len(strata))]).select("id", "stratum")


def needs(targets: list[dict], counts: dict[int, int], share: Decimal) -> tuple[int, list[int]]:
    """Sample size and the rows each stratum needs."""
    size = int(Decimal(sum(counts.values())) * share)
    return size, [max(int(t["min_rows"] or 0), math.floor(Decimal(repr(float(t["target_share"] or 0))) * size)) for t in targets]


def tilt(moments: np.ndarray, totals: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, ridge: float = 0.0, steps: int = 100) -> np.ndarray:
    """Expected rows ``start * exp(moments @ lambda)``, held between ``low`` and ``high``, that meet ``totals``, by Newton steps on the dual.

    moments: strata x categories. A step is halved until the dual decreases; ``ridge`` bounds
    lambda where the totals cannot be met.
    """
    lam = np.zeros(moments.shape[1])
    low = np.maximum(low, 1e-9)  # keeps the logarithm finite
    first, last = np.log(low / start), np.log(high / start)

    def rows(x: np.ndarray) -> np.ndarray:
        e = np.clip(moments @ x, first, last)
        return start * np.exp(np.clip(e, -700, 700))

    def dual(x: np.ndarray) -> float:
        e = moments @ x
        inner = np.clip(np.clip(e, first, last), -700, 700)
        return float((start * np.exp(inner) + np.where(e > last, high * (e - last), 0) + np.where(e < first, low * (e - first), 0)).sum() - totals @ x + ridge / 2 * x @ x)

    for _ in range(steps):
        q, e = rows(lam), moments @ lam
        gradient = moments.T @ q - totals + ridge * lam
        if np.abs(gradient).max(initial=0) < 1e-9 * max(1.0, np.abs(totals).max(initial=1)):
            break
        inside = (e > first) & (e < last)
        hessian = (moments * (q * inside)[:, None]).T @ moments + (ridge + 1e-9) * np.eye(len(lam))
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        step /= max(1.0, np.abs(step).max() / 5)
        now, scale = dual(lam), 1.0
        while scale > 1e-6 and dual(lam - scale * step) > now:
            scale /= 2
        lam = lam - scale * step
    return rows(lam)


def expected_rows(targets: list[dict], counts: dict[int, int], need: list[int], size: int, columns: list[str]) -> np.ndarray:
    """The calibrated expected rows of each stratum; they sum to ``size`` where the bounds allow it."""
    pool = np.array([counts.get(i, 0) for i in range(len(targets))], float)
    low = np.minimum(pool, np.array(need, float))
    share = np.array([float(t["target_share"] or 0) for t in targets])
    out = low.copy()
    free = (share > 0) & (pool > low)
    if low.sum() >= size or not free.any():
        return out
    size = min(size, int(low[~free].sum() + pool[free].sum()))
    start = share * size / share.sum()
    categories = sorted({(c, t[c]) for t in targets for c in columns})
    moments = np.array([[float(t[c] == v) for c, v in categories] for t in targets])
    fixed = out[~free]
    totals = moments.T @ start - moments[~free].T @ fixed
    q = tilt(moments[free], totals, start[free], low[free], pool[free], ridge=1e-6 * size)
    # last, the sample's own total exactly, from where the categories' totals are
    q = np.clip(q, np.maximum(low[free], 1e-9), pool[free])
    out[free] = tilt(np.ones((int(free.sum()), 1)), np.array([size - fixed.sum()]), q, low[free], pool[free])
    return out


def probabilities(rows: np.ndarray, counts: dict[int, int]) -> dict[int, float]:
    """Inclusion probability of each stratum; whole numbers of rows are kept whole."""
    near = np.where(np.abs(rows - np.rint(rows)) < 1e-6, np.rint(rows), rows)
    return {i: min(1.0, float(q) / counts[i]) for i, q in enumerate(near) if q > 0}


def _duel(a: tuple, b: tuple, u: float) -> tuple[list[tuple], tuple | None]:
    """One pivotal step of two undecided units (id, p): decided winners, and who stays undecided."""
    s = a[1] + b[1]
    if s < 1 - 1e-9:
        kept = b if u * s < b[1] else a
        return [], (kept[0], s, *kept[2:])
    winner, other = (a, b) if u * max(2 - s, 1e-12) < 1 - b[1] else (b, a)
    rest = s - 1
    return [winner], (other[0], rest, *other[2:]) if rest > 1e-9 else None


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})


def _pivotal(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sequential duels of the units in the order of their hashes; the last row may stay undecided."""
    pdf = pdf.sort_values(["u", "id"])
    won, held = [], None
    for key, prob, u, stratum in zip(*(pdf[c].tolist() for c in ("id", "p", "duel", "stratum"))):
        unit = (key, prob, stratum)
        if held is None:
            held = unit
            continue
        winners, held = _duel(held, unit, u)
        won += [(w[0], w[2], 1.0) for w in winners]
    if held is not None:
        whole = held[1] > 1 - 1e-6
        if held[1] > 1e-6:
            won.append((held[0], held[2], 1.0 if whole else held[1]))
    return _frame(won, ["id", "stratum", "p"])


#: Units of a bucket in which one task duels.
BUCKET = 100_000


def draw(pool: DataFrame, p: dict[int, float], counts: dict[int, int], seed: int = 17) -> DataFrame:
    """``id, stratum`` of the sampled units. Deterministic: units are ordered and decided by
    hashes of their ids, so a task that is run again decides alike, however the pool is partitioned."""
    spark = pool.sparkSession
    u = lambda name: ((F.xxhash64(F.lit(seed), F.lit(name), "id").bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52)))
    kind = dict(pool.dtypes)["id"]
    sure = pool.where(F.col("stratum").isin([i for i, x in p.items() if x >= 1])).select("id", "stratum")
    undecided = [(i, x, -(-counts[i] // BUCKET)) for i, x in p.items() if x < 1]
    if not undecided:
        return sure
    chance = broadcast_rows(spark.createDataFrame(undecided, "stratum int, p double, buckets int"), len(undecided))
    units = pool.join(chance, "stratum").select("id", "stratum", "p", F.pmod(F.xxhash64(F.lit(seed), "id"), "buckets").alias("bucket"))
    layout = f"id {kind}, stratum int, p double"
    first = units.withColumn("u", u("order")).withColumn("duel", u("duel")).groupBy("stratum", "bucket").applyInPandas(_pivotal, layout)
    first = materialize(first, "p5_first")
    second = first.where("p < 1").withColumn("u", u("second")).withColumn("duel", u("last")).groupBy("stratum").applyInPandas(_pivotal, layout)
    second = materialize(second, "p5_second")
    # at most one unit of each stratum is left; their chances sum to a whole number
    third = second.where("p < 1").withColumn("u", u("third")).withColumn("duel", u("end")).withColumn("bucket", F.lit(0)).groupBy("bucket").applyInPandas(_pivotal, layout)
    return sure.unionByName(first.unionByName(second).where("p >= 1").select("id", "stratum")).unionByName(third.where("p > 0.5").select("id", "stratum"))


def balanced_sample(
    df: DataFrame,
    targets: DataFrame,
    strata: list[str] = ["source_id", "selection_status"],  # noqa: B006
    id_col: str = "input_id",
    time_col: str = "scored_at",
    share: str = "0.2",
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(sample, report). Sample: the id and the stratum as the targets write it. Report, a row per
    target stratum: ``pool_rows``, ``need``, ``expected`` (calibrated rows), ``sampled`` (rows drawn),
    ``missing`` (need beyond the rows drawn)."""
    spark = df.sparkSession
    goal = numbered_targets(targets, strata)
    pool = materialize(pool_of(df, goal, strata, id_col, time_col), "p5_pool")
    counts = {r["stratum"]: r["count"] for r in pool.groupBy("stratum").count().collect()}
    size, need = needs(goal, counts, Decimal(share))
    rows = expected_rows(goal, counts, need, size, strata)
    chosen = materialize(draw(pool, probabilities(rows, counts), counts, seed), "p5_drawn")
    names = spark.createDataFrame(
        [(i, *[t[s] for s in strata], counts.get(i, 0), need[i], float(rows[i])) for i, t in enumerate(goal)],
        "stratum int, " + ", ".join(f"{s} string" for s in strata) + ", pool_rows long, need long, expected double",
    )
    sample = chosen.join(broadcast_rows(names.select("stratum", *strata), len(goal)), "stratum").select(F.col("id").alias(id_col), *strata)
    drawn = chosen.groupBy("stratum").agg(F.count(F.lit(1)).alias("sampled"))
    report = names.join(drawn, "stratum", "left").fillna(0, ["sampled"]).withColumn("missing", F.greatest(F.col("need") - F.col("sampled"), F.lit(0)))
    return sample, report.drop("stratum")
