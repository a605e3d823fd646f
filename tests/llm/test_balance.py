from decimal import Decimal

import numpy as np

from skein.llm import balance

TARGETS = [("S1", "win", 0.5, 5), ("S1", "tie", 0.3, 5), ("S2", "win", 0.1999, 5), ("S2", "tie", 0.0001, 7)]


def setup(spark, sizes, extra=()):
    rows, k = [], 0
    for (s, t, *_), n in zip(TARGETS, sizes):
        for i in range(n):
            rows.append((f"i{k}", f" {s.lower()}\t" if k % 2 else s, t.upper() if k % 3 else t, k, "x"))
            k += 1
    df = spark.createDataFrame(rows + list(extra), "input_id string, source_id string, selection_status string, scored_at int, stratum string")
    return df, spark.createDataFrame(TARGETS, "source_id string, selection_status string, target_share double, min_rows int")


def test_shares_minimum_and_gaps(spark):
    df, targets = setup(spark, (600, 300, 97, 3))
    sample, report = balance.balanced_sample(df, targets)
    rep = {(r["source_id"], r["selection_status"]): r for r in report.collect()}
    got = {(r["source_id"], r["selection_status"]): r["count"] for r in sample.groupBy("source_id", "selection_status").count().collect()}
    assert rep["S2", "tie"]["missing"] == 4 and got["S2", "tie"] == 3
    assert rep["S1", "win"]["need"] == 100 and rep["S1", "tie"]["need"] == 60
    assert sum(got.values()) == 202 and all(got[k] == r["sampled"] and abs(got[k] - r["expected"]) < 1 for k, r in rep.items())
    assert sample.select("input_id").distinct().count() == 202  # the minimum of the small stratum comes on top
    again = balance.balanced_sample(df.repartition(7), targets)[0]
    assert {r["input_id"] for r in again.collect()} == {r["input_id"] for r in sample.collect()}


def test_latest_row_counts(spark):
    extra = [("i0", "S2", "tie", 10**6, "x"), ("i0", "S2", "tie", 10**6, "x"), ("i1", "nowhere", "win", 10**6, "x"), (None, "S1", "win", 1, "x"), ("i2", None, None, None, "x")]
    df, targets = setup(spark, (50, 30, 10, 3), extra)
    _, report = balance.balanced_sample(df, targets)
    pool = {(r["source_id"], r["selection_status"]): r["pool_rows"] for r in report.collect()}
    assert pool == {("S1", "win"): 48, ("S1", "tie"): 30, ("S2", "win"): 10, ("S2", "tie"): 4}


def test_empty_pool(spark):
    df, targets = setup(spark, (0, 0, 0, 0))
    sample, report = balance.balanced_sample(df, targets)
    assert sample.count() == 0 and report.where("missing > 0").count() == 4


def test_newton_meets_margins():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.eye(3).repeat(2, 0), np.tile(np.eye(2), (3, 1))], 1)
    start = rng.integers(50, 500, 6).astype(float)
    want = x.T @ (start * np.array([0.7, 1.5, 0.9, 1.1, 1.4, 0.8]))
    q = balance.tilt(x, want, start, np.zeros(6) + 1e-9, np.full(6, 1e6))
    assert np.allclose(x.T @ q, want, rtol=1e-6)
    assert np.allclose(np.log(q / start), x @ np.linalg.lstsq(x, np.log(q / start), rcond=None)[0])


GRID = [{"source_id": a, "selection_status": b, "target_share": 1 / 6, "min_rows": 0} for a in "xy" for b in "123"]


def test_calibration_keeps_the_categories_totals():
    """A pool that is too small is made up for by strata of its categories; without the dual all others would get the same."""
    counts = {0: 40, 1: 1000, 2: 1000, 3: 1000, 4: 1000, 5: 1000}
    q = balance.expected_rows(GRID, counts, [0] * 6, 600, ["source_id", "selection_status"])
    assert abs(q.sum() - 600) < 1e-6 and abs(q[0] - 40) < 1e-6
    assert abs(q[:3].sum() - 300) < 0.1 and abs(q[0] + q[3] - 200) < 0.1
    assert q[1] > 120 and q[3] > 150 and q[4] < 80


def test_calibration_where_totals_are_impossible():
    counts = {0: 40, 1: 50, 2: 60, 3: 1000, 4: 1000, 5: 1000}
    q = balance.expected_rows(GRID, counts, [0, 0, 0, 0, 0, 300], 600, ["source_id", "selection_status"])
    assert abs(q.sum() - 600) < 1e-6 and q[5] >= 300 - 1e-9 and (q <= np.array(list(counts.values())) + 1e-9).all()
    assert balance.expected_rows(GRID, {}, [0] * 6, 0, ["source_id"]).sum() == 0


def test_draw_has_the_size_and_the_chances(spark):
    pool = spark.range(3000).selectExpr("concat('i', id) as id", "cast(id % 3 as int) as stratum")
    counts = {0: 1000, 1: 1000, 2: 1000}
    p = {0: 1.0, 1: 0.1234, 2: 0.3336}
    hits = np.zeros(3)
    for seed in range(4):
        got = {r["stratum"]: r["count"] for r in balance.draw(pool, p, counts, seed).groupBy("stratum").count().collect()}
        assert got[0] == 1000 and got[1] in (123, 124) and got[2] in (333, 334) and sum(got.values()) == 1457
        hits += [got[k] for k in range(3)]


def test_needs_round_down_exactly():
    assert balance.needs([{"target_share": 0.29, "min_rows": 1}], {0: 500}, Decimal("0.2")) == (100, [29])
