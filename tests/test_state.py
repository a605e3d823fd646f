import pytest
from pyspark.sql import functions as F

from skein.operators import curation, ingest, maintenance, metadata, metrics

E = metadata.ENTRY_SCHEMA


@pytest.fixture(scope="module")
def entries(spark):
    rows = []
    for doc, values in {
        1: {"tag": ["a", "b"], "n": 5.0, "ok": True},
        2: {"tag": ["B"], "n": 7.5},
        3: {"n": "seven", "ok": False},
        4: {},
    }.items():
        rows += [(doc, *e) for e in metadata.entries_of(values)]
    return spark.createDataFrame(rows, "doc long, " + E)


CASES = [
    ({"operator": "eq", "field": "tag", "value": "b"}, {1}),
    ({"operator": "eq", "field": "tag", "value": "b", "caseInsensitive": True}, {1, 2}),
    ({"operator": "ne", "field": "tag", "value": "a"}, {2}),
    ({"operator": "nin", "field": "n", "value": [5]}, {2}),
    ({"operator": "in", "field": "n", "value": [5, 7.5]}, {1, 2}),
    ({"operator": "gt", "field": "n", "value": 6}, {2}),
    ({"operator": "lte", "field": "n", "value": "z"}, {3}),
    ({"operator": "all", "field": "tag", "value": ["a", "b"]}, {1}),
    ({"operator": "exists", "field": "ok", "value": False}, {2, 4}),
    ({"operator": "exists", "field": "ok", "value": True}, {1, 3}),
    ({"operator": "type", "field": "n", "value": "string"}, {3}),
    ({"operator": "not", "operand": {"operator": "eq", "field": "ok", "value": True}}, {2, 3, 4}),
    ({"operator": "contains", "field": "n", "value": "eve"}, {3}),
    ({"operator": "prefix", "field": "n", "value": "SE"}, set()),
    ({"operator": "suffix", "field": "n", "value": "EN", "caseInsensitive": True}, {3}),
    ({"operator": "and", "operands": [{"operator": "gte", "field": "n", "value": 5}, {"operator": "eq", "field": "ok", "value": True}]}, {1}),
    ({"operator": "or", "operands": [{"operator": "eq", "field": "n", "value": 7.5}, {"operator": "eq", "field": "ok", "value": False}]}, {2, 3}),
]


def test_filters(spark, entries):
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc long")
    for predicate, want in CASES:
        assert {r["doc"] for r in metadata.filter_documents(docs, entries, predicate).collect()} == want, predicate


@pytest.mark.parametrize(
    "bad",
    [
        {"operator": "gt", "field": "a", "value": True}, {"operator": "in", "field": "a", "value": []}, {"operator": "in", "field": "a", "value": [1, "x"]}, {"operator": "eq", "field": "a", "value": 1, "x": 2},
        {"operator": "contains", "field": "a", "value": ""}, {"operator": "eq", "field": "a", "value": 1, "caseInsensitive": True}, {"operator": "nope", "field": "a"}, {"operator": "and", "operands": []},
        {"operator": "eq", "field": "a", "value": None}, {"operator": "eq", "field": "a", "value": float("nan")}, {"operator": "exists", "field": "a", "value": "yes"}, [], {"operator": "not"},
    ],
)
def test_refused_filters(bad):
    with pytest.raises(metadata.FilterError):
        metadata.parse_filter(bad)


def test_filter_limits():
    deep = {"operator": "eq", "field": "a", "value": 1}
    for _ in range(16):
        deep = {"operator": "not", "operand": deep}
    with pytest.raises(metadata.FilterError):
        metadata.parse_filter(deep)
    with pytest.raises(metadata.FilterError):
        metadata.parse_filter({"operator": "all", "field": "key", "value": ["a"]}, entry=True)


def test_every_value_is_found_by_eq(spark, entries):
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc long")
    for r in metadata.value_counts(entries).collect():
        value = {"string": str, "number": float, "boolean": lambda v: v == "true"}[r["value_type"]](r["value"])
        assert metadata.filter_documents(docs, entries, {"operator": "eq", "field": r["key"], "value": value}).count() == r["documents"]


def test_extraction(spark):
    rows = [
        (1, "---\nskein:\n  metadata:\n    a: [x, y, x]\n    b: 2\n    c: true\n---\nbody", "a.md"),
        (2, "---\nskein:\n  metadata:\n    a: [x, 1]\n---\n", "a.md"),
        (3, "---\nother: 1\n---\n", "a.md"),
        (4, "---\nskein:\n  metadata:\n    a: x\n---\n", "a.txt"),
        (5, None, "a.md"),
        (6, "﻿---\r\nskein:\r\n  metadata:\r\n    a: x\r\n...\r\nbody", "b.MD"),
        (7, "---\nskein: [\n---\n", "a.md"),
    ]
    got = {r["doc"]: r for r in metadata.extract_metadata(spark.createDataFrame(rows, "d long, t string, p string"), "d", "t", "p", "skein").collect()}
    assert [(e["key"], e["ordinal"], e["text_value"]) for e in got[1]["entries"]][:2] == [("a", 0, "x"), ("a", 1, "y")] and len(got[1]["entries"]) == 4
    assert got[2]["error"] and not got[2]["entries"] and got[7]["error"]
    assert all(not got[i]["entries"] and not got[i]["error"] for i in (3, 4, 5)) and got[6]["entries"][0]["text_value"] == "x"


def test_scan_and_upsert(spark):
    s = spark.createDataFrame([("c", "a", 1, 5, "h1"), ("c", "b", 2, 5, "h2"), ("c", "d", 3, 6, "h4")], "collection string, path string, mtime int, size int, hash string")
    m = spark.createDataFrame([("c", "a", 1, 5, "h1"), ("c", "b", None, 5, "h2"), ("c", "d", 1, 5, "h3"), ("c", "e", 1, 1, "h5")], "collection string, path string, mtime int, size int, hash string")
    assert {r["path"]: r["change"] for r in ingest.classify(s, m).collect()} == {"a": "unchanged", "b": "touched", "d": "updated", "e": "removed"}
    cols = "collection string, path string, title string, hash string, created_at int, modified_at int, active boolean"
    old = spark.createDataFrame([("c", "a", "t", "h", 1, 1, False), ("c", "b", "t", "h", 1, 1, True)], cols)
    new = spark.createDataFrame([("c", "a", "T", "H", 9, 9, False)], cols)
    got = {r["path"]: r for r in ingest.upsert_documents(old, new).collect()}
    assert got["a"]["active"] and got["a"]["created_at"] == 1 and got["a"]["hash"] == "H" and got["b"]["hash"] == "h"
    gone = {r["path"]: r["active"] for r in ingest.deactivate_unseen(old, new, "c").collect()}
    assert gone == {"a": False, "b": False}


def test_files(spark, tmp_path):
    for p, body in {"a.md": "# Hi", "sub/b.md": "x", ".hid/c.md": "x", "node_modules/d.md": "x", "e.txt": "x"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    got = ingest.scan_files(spark, str(tmp_path))
    assert {r["path"] for r in got.select("path").collect()} == {"a.md", "sub/b.md"}
    gated = ingest.gate(got.select("path", "size", F.decode("content", "UTF-8").alias("body")), limit=3)
    assert {r["path"]: r["verdict"] for r in gated.collect()} == {"a.md": "too_large", "sub/b.md": "ok"}


def test_stream_keeps_latest(spark, tmp_path):
    from skein.streaming.incremental import latest_from_stream

    d = tmp_path / "t.parquet"
    spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("j", 1, "x"), (None, 9, "n")], "k string, t int, v string").repartition(3).write.parquet(str(d))
    got = {r["k"]: r["v"] for r in latest_from_stream(spark, str(d), ["k"], "t", ["v"]).collect()}
    assert got == {"k": "c", "j": "x"}


def test_vectors_and_cleanup(spark):
    docs = spark.createDataFrame([("c", "a", "h1", True), ("d", "a", "h1", True), ("c", "b", "h2", False), ("c", "e", "h3", True)], "collection string, path string, hash string, active boolean")
    vec = spark.createDataFrame([("h1", 0, 2), ("h1", 1, 2), ("h3", 0, 2), ("h9", 0, 1)], "hash string, seq int, total_chunks int")
    assert {r["hash"] for r in maintenance.pending_embeddings(docs, vec).collect()} == {"h3"}
    assert maintenance.partial_vectors(vec).count() == 3 and maintenance.vector_rows(vec, docs).count() == 5
    assert {r["hash"] for r in maintenance.orphaned_vectors(vec, docs).collect()} == {"h9"}
    content = spark.createDataFrame([("h1",), ("h2",), ("h7",)], "hash string")
    assert {r["hash"] for r in maintenance.orphaned_content(content, docs, True).collect()} == {"h7"}
    assert {r["hash"] for r in maintenance.orphaned_content(content, docs, False).collect()} == {"h2", "h7"}
    assert {r["hash"] for r in maintenance.exclusive_hashes(docs, "c").collect()} == {"h3"}


def test_embedding_failures_stay_as_rows(spark):
    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("x", 1), ("x", 2), ("bad", 3), ("long", 4)], "chunk string, id int")
    got = {r["id"]: (r["embedding"], r["error"]) for r in maintenance.embed(df, model, dim=2).collect()}
    assert got[1] == got[2] == ([1.0, 1.0], None) and got[3] == (None, "no") and got[4][0] == [4.0, 1.0]


def test_metrics_by_hand(spark):
    rank = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c"), ("r", 1, "z")], "qid string, rank int, doc string")
    rel = spark.createDataFrame([("q", "b"), ("q", "c"), ("q", "x"), ("r", "y")], "qid string, doc string")
    m = {r["qid"]: r for r in metrics.query_metrics(rank, rel).collect()}
    assert m["q"]["precision_10"] == pytest.approx(2 / 3) and m["q"]["recall_1"] == 0 and m["q"]["mrr"] == 0.5 and m["r"]["mrr"] == 0
    import math

    dcg, ideal = 1 / math.log2(3) + 1 / math.log2(4), 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert m["q"]["ndcg_10"] == pytest.approx(dcg / ideal)
    assert metrics.gate(spark.createDataFrame([("a", 0.02), ("b", -0.005)], "source string, delta double")).first()["passed"]


def brute_near(texts):
    import re

    def sets(t):
        return set(re.findall(r"\w+", t.lower())), {t[i : i + 3] for i in range(max(1, len(t) - 2))}

    out = set()
    for i, a in enumerate(sorted(texts)):
        for b in sorted(texts)[i + 1 :]:
            (wa, ga), (wb, gb) = sets(a), sets(b)
            if len(wa & wb) / len(wa | wb) >= 0.8 or len(ga & gb) / len(ga | gb) >= 0.85:
                out.add((a, b))
    return out


def test_near_pairs_are_exact(spark):
    import random

    rng = random.Random(6)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"ab", "abc", "abcd"}
    df = spark.createDataFrame([(t, t) for t in texts], "id string, text string")
    assert {(r["a"], r["b"]) for r in curation.near_pairs(df).collect()} == brute_near(texts)


def test_near_pairs_of_a_template_take_no_time(spark):
    """Texts of one template whose items are all frequent: exact, and few pairs are listed."""
    import random

    from skein.operators import setjoin

    rng = random.Random(8)
    part = [a + b + c for a in "bdfgklmnprstv" for b in "aeiou" for c in "nrl"][::4]
    name = lambda: "".join(rng.choice(part) for _ in range(3))
    texts = sorted({f"opening hours of the {name()} {name()} bell tower in winter" for _ in range(3000)})
    texts += [t.replace("opening", "openings") for t in texts[::50]] + [t[:25] + "x" + t[26:] for t in texts[::40]] + ["a", "ab"]
    df = spark.createDataFrame([(t, t) for t in texts], "key string, text string")
    listed = {(r["a"], r["b"]) for r in setjoin.candidates(df, None, 0.8, 0.85).select("a", "b").collect()}
    assert len(listed) < 20_000
    near = {(r["a"], r["b"]) for r in curation.near_pairs(df.withColumnRenamed("key", "id")).collect()}
    some = texts[::150] + texts[-150:]
    assert {p for p in near if p[0] in some and p[1] in some} == brute_near(set(some)) and len(near) >= 130
    across = {(r["a"], r["b"]) for r in curation.near_pairs(df.withColumnRenamed("key", "id"), spark.createDataFrame([(t, t) for t in some], "id string, text string")).collect()}
    assert across == {(x, y) for p in near for x, y in (p, p[::-1]) if y in some} | {(t, t) for t in some}


def test_near_pairs_of_mixed_sizes(spark):
    import random

    rng = random.Random(9)
    texts = set()
    for _ in range(60):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randint(0, 9)) for _ in range(rng.choice([1, 2, 5, 12, 40, 90]))]
        texts.add(" ".join(words))
        for _ in range(3):
            again = [w for w in words if rng.random() > 0.08] + (["more"] if rng.random() < 0.4 else [])
            texts.add(" ".join(again) or "x")
    df = spark.createDataFrame([(t, t) for t in texts], "id string, text string")
    assert {(r["a"], r["b"]) for r in curation.near_pairs(df).collect()} == brute_near(texts)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in curation.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_every_query_has_a_family(spark):
    rows = [("a", "how to prune an old apple tree in spring"), ("b", "how to prune an old apple tree in the spring"), ("c", "something else"), ("c", "something else"), ("d", None), ("e", "third thing"), ("f", "fourth thing"), ("g", " "), (None, "x")]
    q = spark.createDataFrame(rows, "id string, text string")
    judged = spark.createDataFrame([("c", "d1"), ("d", "d1"), ("e", "d2"), ("f", "d3"), (None, "d2")], "id string, doc string")
    contents = spark.createDataFrame([("d2", "same"), ("d3", "same"), ("d1", None)], "doc string, hash string")
    got = [tuple(r) for r in curation.query_families(q, judged, contents).collect()]
    assert len(got) == 7
    family = {i: f for i, _, f in got}
    groups = {}
    for i, f in family.items():
        groups.setdefault(f, set()).add(i)
    assert sorted(map(sorted, groups.values())) == [["a", "b"], ["c", "d"], ["e", "f"], ["g"]]
    assert family["d"] == "something else" and family["a"] == rows[0][1]
    apart = {r["id"]: r["family"] for r in curation.query_families(q, judged.where("false")).collect()}
    assert len(apart) == 7 and len(set(apart.values())) == 6


def test_registered_families_hold_every_record(spark):
    import __spark_entry__ as e
    from skein.sources.tables import table

    d = "/root/testdata/sf0.001"
    want = {r[0] for r in table(spark, d, "qmd_expansion_locations").where("record_id is not null").select("record_id").distinct().collect()}
    got = [r["record_id"] for r in e.queries()["query_families"](spark, d).select("record_id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_families_go_to_the_split_that_lacks_most(spark):
    import hashlib

    for sizes in ([100] + [1] * 200, [7, 7, 7, 3, 3, 1], [1 + i * i % 9 for i in range(150)], [40, 40] + [2] * 60):
        fam = [(f"f{i}", n) for i, n in enumerate(sizes)]
        total = sum(sizes)
        lack = {"train": total * 14, "dev": total * 3, "test": total * 3}
        want = {}
        for f, n in sorted(fam, key=lambda x: (-x[1], hashlib.sha256(f"\0{5}\0{x[0]}".encode()).hexdigest())):
            want[f] = max(lack, key=lack.get)
            lack[want[f]] -= 20 * n
        got = {r["family"]: r["split"] for r in curation.split_families(spark.createDataFrame(fam, "family string, size long"), "5").collect()}
        assert got == want


def test_negation_is_looked_for_in_expansions(spark, tmp_path):
    from skein.plans import state_queries

    rows = [(1, "hotels without a pool", [["lex", "hotels pool"], None]), (2, "hotels without a pool", [["lex", "hotels"], ["vec", "hotels that have no pool"]]), (3, "hotels with a pool", [["lex", "hotels"]]), (4, "not open on Monday", None), (5, None, [["lex", "x"]])]
    for name in ("qmd_expansion_locations", "qmd_expansion_personal_entities", "qmd_expansion_sports"):
        spark.createDataFrame(rows + rows[:1], "record_id long, query string, output array<array<string>>").write.parquet(str(tmp_path / f"{name}.parquet"))
    raw = [(1, "not on sale", "lex: on sale"), (2, "not on sale", "lex: not on sale"), (3, "on sale", None)]
    spark.createDataFrame(raw, "record_id long, query string, raw_model_output string").write.parquet(str(tmp_path / "query_expansion_contract_v1.parquet"))
    got = sorted((r["table_name"], r["record_id"], r["text"]) for r in state_queries.negation_lost(spark, str(tmp_path)).collect())
    tables = ("qmd_expansion_locations", "qmd_expansion_personal_entities", "qmd_expansion_sports")
    assert got == sorted([(t, i, x) for t in tables for i, x in (("1", "hotels pool"), ("2", "hotels"))] + [("query_expansion_contract_v1", "1", "on sale")])


def test_bootstrap_draws_as_often_as_the_reference(spark, monkeypatch):
    from skein.plans import state_queries

    drawn = []
    monkeypatch.setattr(state_queries.metrics, "paired_bootstrap", lambda deltas, rounds=1000, seed=13: drawn.append(rounds))
    state_queries.bootstrap_interval(spark, "/root/testdata/sf0.001")
    assert drawn == [2000]


def test_splits_and_quotas(spark):
    fam = spark.createDataFrame([(f"f{i}", 1 + i % 5) for i in range(300)], "family string, size int")
    s = {r["split"]: r["n"] for r in curation.split_families(fam).groupBy("split").agg(F.sum("size").alias("n")).collect()}
    assert abs(s["train"] / 900 - 0.7) < 0.03 and abs(s["test"] / 900 - 0.15) < 0.03
    q = curation.largest_remainder(spark.createDataFrame([("a", 10), ("b", 10), ("c", 13)], "s string, n long"), 10)
    assert {r["s"]: r["quota"] for r in q.collect()} == {"a": 3, "b": 3, "c": 4}


def test_ledger_and_lengths(spark):
    rows = spark.createDataFrame([("k", "A"), ("k", "a"), ("l", "x"), ("l", "y"), ("m", "z"), ("n", "s"), ("n", "s"), ("o", ""), ("o", "")], "k string, r string")
    got = {r["k"]: r["state"] for r in curation.conflict_ledger(rows, "k", F.col("r"), F.nullif(F.lower("r"), F.lit(""))).collect()}
    assert got == {"k": "format_only", "l": "conflict", "m": "unique", "n": "identical", "o": "invalid"}
    st = curation.length_stats(spark.range(100).selectExpr("cast(id as int) as n"), F.col("n")).first()
    assert (st["p50"], st["p95"], st["p99"], st["sum"]) == (50, 95, 99, 4950)


def test_self_check(spark):
    vec = spark.createDataFrame([("h", 0, [1.0, 0.0]), ("h", 1, [0.0, 1.0])], "hash string, seq int, embedding array<float>")
    chunks = spark.createDataFrame([("h", 0, "a"), ("h", 1, "b")], "hash string, seq int, chunk string")
    got = {r["seq"]: r["mismatch"] for r in maintenance.self_check(vec, chunks, lambda ts: [[2.0, 0.0] for _ in ts]).collect()}
    assert got == {0: False, 1: True}


def test_family_selection(spark):
    fam = spark.createDataFrame([(f"f{i}", 10, i % 2 == 0) for i in range(10)], "family string, size int, used boolean")
    got = curation.select_families(fam, 54, "s").collect()
    assert len(got) == 5 and not any(r["used"] for r in got)
    assert len(curation.select_families(fam, 76, "s").collect()) == 8


def test_pairs_of_sets_are_found_at_any_size_and_share(monkeypatch):
    """Keys, maps and tables of the set join against brute force, with parts of any size."""
    import numpy as np

    from skein.operators import setjoin

    rng = np.random.default_rng(12)
    lists = []
    for size in (1, 2, 3, 4, 5, 6, 8, 11, 15, 22, 30, 45, 90):
        for _ in range(3):
            base = rng.integers(0, 10 * size, size)
            lists += [base] + [np.append(base[rng.random(size) > lost], rng.integers(0, 10 * size, more)) for lost, more in ((0.02, 0), (0.1, 1), (0.0, size // 8), (0.3, size // 3))]
    lists += [np.zeros(0, np.int64), np.arange(3), np.arange(3)]
    lists = [np.unique(x).astype(np.int64) for x in lists]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    item = setjoin._mix(np.concatenate(lists).view(np.uint64))
    n = np.bincount((item >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
    rank = np.empty(1 << 16, np.uint64)
    rank[np.argsort(n, kind="stable")] = np.arange(1 << 16, dtype=np.uint64)
    sets = [set(x.tolist()) for x in lists]
    for least in (0.5, 0.8, 0.85, 1.0):
        want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if x and y and len(x) >= len(y) and len(x & y) >= least * len(x | y)}
        for step, table, part in ((1 << 18, 1 << 12, 1_000_000), (3_000, 8, 300)):
            for k, v in (("STEP", step), ("TABLE", table), ("SLICE", part)):
                monkeypatch.setattr(setjoin, k, v)
            s = setjoin.Sets(len(lists), owner, item, rank, 40_000, 16)
            assert s.n.tolist() == [len(x) for x in sets]
            index = setjoin._opened({"w_n": s.n.astype(np.int32), "w_maps": s.maps, "w_rare": s.rare, "w_entry": setjoin._packed(np.sort(s.as_smaller(least))), "group": None}, "w")
            codes = setjoin.matches(index | {"n": s.n.astype(np.int32)}, np.sort(s.as_larger(least)), index, least)
            got = {(int(c) >> 32, int(c) & 0xFFFFFFFF) for part in codes for c in part}
            assert want <= got and len(got) < 2 * len(want) + 20


def test_texts_of_templates_are_hardly_listed_unless_similar(spark):
    """Templates whose words are rarer than parts of the names: what shares the template alone is not passed on."""
    import random

    from skein.operators import setjoin

    rng = random.Random(13)
    part = "gri ras fen gor pel bri hul tol nim eth tif xan jor ren lun tam ves ygg dov und".split()
    name = lambda k: "".join(rng.choice(part) for _ in range(k))
    forms = ["best time of day to photograph the {} {} gorge in winter", "legends told about the {} {} gorge by local fishermen in winter", "guided tour of the {} {} gorge in a foreign language in winter"]
    texts = sorted({rng.choice(forms).format(name(3), name(4)) for _ in range(6000)})
    texts += [t.replace(" gorge", " groge") for t in texts[::60]]
    df = spark.createDataFrame([(t, t) for t in texts], "key string, text string")
    listed = {(min(p), max(p)) for p in setjoin.candidates(df, None, 0.8, 0.85).select("a", "b").collect()}
    near = {(r["a"], r["b"]) for r in curation.near_pairs(df.withColumnRenamed("key", "id")).collect()}
    assert near <= listed and len(near) >= 100
    assert len(listed) <= 1.2 * len(near)


def test_keys_are_looked_up_once_for_a_group_of_shards(tmp_path, monkeypatch):
    """Shards, groups, blocks and tables of any size give all pairs, and shards are not opened one by one."""
    import random

    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from skein.operators import setjoin

    rng = random.Random(14)
    part = "gri ras fen gor pel bri hul tol nim eth".split()
    texts = [f"opening hours of the {''.join(rng.choices(part, k=3))} bell tower" for _ in range(150)]
    texts = sorted({*texts, *(t[:24] + "x" + t[25:] for t in texts[::3]), *(t + " today" for t in texts[::4]), "a", "ab"})
    ids = {w: i * 7919 for i, w in enumerate(sorted({w for t in texts for w in t.split()}))}
    rows = pa.RecordBatch.from_pydict({"text": texts, "w": pa.array([[ids[w] for w in t.split()] for t in texts], pa.list_(pa.int64()))})
    batches = lambda: [rows.slice(i, 30) for i in range(0, len(rows), 30)]
    seen = {(k, b): n for x in setjoin._count(["g", "w"])(batches()) for k, b, n in zip(*x.to_pydict().values())}
    ranks = {k: (np.argsort(np.argsort([seen.get((k, b), 0) for b in range(1 << 16)], kind="stable")).astype(np.uint64), 60_000) for k in "wg"}
    calls = []
    plain = setjoin.matches
    monkeypatch.setattr(setjoin, "matches", lambda *x: calls.append(1) or plain(*x))
    for shard, group, task, block in ((40, 10_000, 10_000, 16), (25, 60, 70, 50)):
        for k, v in (("SHARD_ROWS", shard), ("GROUP_ROWS", group), ("TASK_ROWS", task), ("BLOCK_ROWS", block)):
            monkeypatch.setattr(setjoin, k, v)
        path = str(tmp_path / f"{shard}.parquet")
        shards = list(setjoin._build(ranks, {"w": 0.8, "g": 0.85})(batches()))
        pq.write_table(pa.Table.from_batches(shards), path)
        assert len(shards) >= 4
        calls.clear()
        got = {(min(p), max(p)) for x in setjoin._stream(["file://" + path], ranks, {"w": 0.8, "g": 0.85}, True)(batches()) for p in zip(x.column("a").to_pylist(), x.column("b").to_pylist())}
        want = brute_near(texts)
        assert want <= got and len(want) > 40 and all(a != b for a, b in got)
        if group > len(texts):
            assert len(calls) == sum(1 << setjoin.RANGE_BITS[k] for k in "wg")


def test_components_of_few_edges_take_one_task(spark, monkeypatch):
    import random

    rng = random.Random(15)
    for kind, make in (("string", lambda: f"n{rng.randrange(80)}\U0001f600"), ("long", lambda: rng.randrange(80))):
        edges = spark.createDataFrame([(make(), make()) for _ in range(60)], f"a {kind}, b {kind}")
        written = []
        with monkeypatch.context() as m:
            m.setattr(curation, "materialize", lambda df, name: written.append(name) or plain(df, name))
            plain = __import__("skein.session", fromlist=["x"]).materialize
            once = {tuple(r) for r in curation.components(edges).collect()}
            assert written == ["cc"]
            m.setattr(curation, "TASK_EDGES", 0)
            assert once == {tuple(r) for r in curation.components(edges).collect()} and len(written) > 2
    assert curation.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_families_of_records_with_several_texts(spark):
    import hashlib

    text = [hashlib.sha256(bytes([i])).hexdigest()[:24] for i in range(40)]
    rows = [(i, t) for i in range(40) for t in ([text[i]] + (["0 words of two records"] if i in (3, 4) else []) + ([None] if i in (5, 6) else []))]
    judged = spark.createDataFrame([(8, "d"), (9, "d")], "id long, doc string")
    got = {r["id"]: (r["query"], r["family"]) for r in curation.query_families(spark.createDataFrame(rows + rows[:9], "id long, text string"), judged).collect()}
    want = {i: (t, t) for i, t in enumerate(text)}
    want |= {i: ("0 words of two records",) * 2 for i in (3, 4)} | {i: (text[i], min(text[8:10])) for i in (8, 9)}
    assert got == want
