import pytest
from pyspark.sql import functions as F

from skein.functions import paths as P
from skein.functions import text as T
from skein.operators import catalog, contract, curation, ingest, maintenance, release
from skein.operators.expansion import SubQuery
from skein.plans.hybrid import Store, render_metadata

DOCS = [
    (1, "notes", "a.md", "Budget reviews", "h1", "The budget reviews are due", "2030-01-01 00:00:00", True),
    (2, "notes", "b.md", "Garden", "h2", "Planting in spring", "2030-01-02 00:00:00", True),
    (3, "docs", "c.md", "Garden walls", "h3", "Walls and gardens in old towns", "2030-01-03 00:00:00", True),
]


def documents(spark):
    return spark.createDataFrame(DOCS, "doc long, collection string, path string, title string, hash string, body string, modified_at string, active boolean").withColumn("modified_at", F.to_timestamp("modified_at"))


def docs_of(df):
    return {r["doc"] for r in df.collect()}


def test_store_searches_stems_and_reopens_its_index(spark, tmp_path):
    s = Store(documents(spark))
    assert docs_of(s.search_lexical("budget review")) == {1} and docs_of(s.search_lexical("reviewing")) == {1}
    s.index(str(tmp_path / "index"))
    again = Store(documents(spark))
    again.open_index(str(tmp_path / "index"))
    assert docs_of(again.search_lexical("gardens")) == {2, 3} and docs_of(again.search_lexical("gardens", collections=["docs"])) == {3}
    # equal scores go by path
    assert again.query("vec: nothing here").count() == 0


def test_expansions_probe_cache_and_pins(spark):
    asked = []

    def expand(q):
        asked.append(q)
        return f"lex: {q}\nlex: walls\nlex: walls\nhyde: about"

    s = Store(documents(spark), expand=expand)
    assert s.expansions("garden") == [SubQuery("lex", "walls"), SubQuery("hyde", "about")] and s.expansions("garden") and asked == ["garden"]
    assert docs_of(s.query("spring planting", reranked=False)) == {2, 3}  # expanded by "walls"
    assert docs_of(s.query("spring planting", reranked=False, pinned=[SubQuery("lex", "budget")])) == {1, 2}
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 0, [0.6, 0.8])], "doc long, chunk long, embedding array<double>")
    v = Store(documents(spark), vectors, embed=lambda ts: [[0.0, 1.0] if t == "garden" else [1.0, 0.0] for t in ts], expand=lambda q: "vec: other\nlex: skipped")
    got = [(r["doc"], round(r["score"], 6)) for r in v.vector_query("garden", least=0.0).orderBy("rank").collect()]
    assert got[-1] == (3, 0.8) and {g[0] for g in got} == {1, 2, 3} and all(abs(g[1] - 1) < 1e-6 for g in got[:2])
    assert Store(documents(spark)).vector_query("garden").count() == 0


def test_listing_of_metadata(spark):
    rows = [(1, [("tag", 0, "string", "a", None, None), ("tag", 1, "string", "b", None, None), ("year", 0, "number", None, 2030.0, None)]), (2, [("tag", 0, "string", "a", None, None), ("year", 0, "number", None, 2032.0, None)])]
    kind = "doc long, entries array<struct<key:string,ordinal:int,value_type:string,text_value:string,number_value:double,boolean_value:boolean>>"
    extracted = spark.createDataFrame(rows, kind).withColumn("version", F.lit(1)).withColumn("error", F.lit(None).cast("string"))
    s = Store(documents(spark), extracted=extracted)
    listing = s.list_metadata(catalog.Window(key_limit=1))
    assert (listing["documents"], listing["total_keys"], listing["remaining_keys"]) == (2, 2, 1)
    text = render_metadata(listing)
    assert text.startswith("tag  string[]  2 of 2 documents") and "  a (2)" in text and text.endswith("1 more key")
    assert "median 2031" in render_metadata(s.list_metadata()) and render_metadata(s.list_metadata(catalog.Window(key_offset=9))).startswith("No keys at this offset")
    got = {r["doc"]: r["metadata"] for r in s.query("lex: garden\nlex: budget", reranked=False).collect()}
    assert got[1] == '{"tag":["a","b"],"year":2030.0}' and got[3] is None
    for bad in ({"key_limit": 0}, {"key_offset": -1}, {"sort": "size"}, {"min_count": 0}, {"value_limit": True}):
        with pytest.raises(ValueError):
            catalog.Window(**bad)


def test_catalog_of_collections(spark):
    c = catalog.Catalog.from_config({"collections": {"a": {"path": "/x/a", "context": {"": "root"}}, "b": {"path": "/x/b", "includeByDefault": False}}, "global_context": "g"})
    assert c.scope() == ["a"] and c.scope([" b ", ""]) == ["b"]
    with pytest.raises(ValueError):
        c.scope(["zzz"])
    with pytest.raises(ValueError):
        c.set_context("zzz", "", "t")
    c.rename("b", "c")
    assert c.remove_context(None) == 2 and c.contexts(spark).count() == 0 and set(c.collections) == {"a", "c"}
    with pytest.raises(ValueError):
        catalog.Catalog.from_config({"collections": {"a": {}}})


def test_reindex_counts_and_state(spark):
    doc = "collection string, path string, title string, hash string, created_at timestamp, modified_at timestamp, active boolean"
    state = {
        "documents": spark.createDataFrame([], doc),
        "content": spark.createDataFrame([], "hash string, doc string, created_at timestamp"),
        "manifest": spark.createDataFrame([], "collection string, path string, mtime timestamp, size long, hash string"),
    }
    kind = "path string, mtime string, size long, body string"
    scan = lambda rows: spark.createDataFrame(rows, kind).withColumn("mtime", F.to_timestamp("mtime"))
    first = [("a.md", "2030-01-01 00:00:00", 5, "alpha"), ("b.md", "2030-01-01 00:00:00", 4, "beta"), ("c.md", "2030-01-01 00:00:00", 2, "  "), ("d.md", "2030-01-01 00:00:00", 1 << 40, "x")]
    out = ingest.reindex(scan(first), **state, collection="n", scanned_at="2030-01-02 00:00:00")
    assert tuple(out.pop("counters").first()) == (2, 0, 0, 0, 2)
    second = [("a.md", "2030-01-01 00:00:00", 5, "not read again"), ("b.md", "2030-01-03 00:00:00", 5, "beta2")]
    nxt = ingest.reindex(scan(second), **out, collection="n", scanned_at="2030-01-04 00:00:00")
    assert tuple(nxt.pop("counters").first()) == (0, 1, 1, 0, 0)
    last = ingest.reindex(scan(second[:1]), **nxt, collection="n", scanned_at="2030-01-05 00:00:00")
    assert tuple(last["counters"].first()) == (0, 0, 1, 1, 0)
    assert {(r["path"], r["active"]) for r in last["documents"].collect()} == {("a.md", True), ("b.md", False)} and last["content"].count() == 3


def test_missing_root_and_containment(spark, tmp_path):
    assert catalog.root_exists(spark, str(tmp_path)) and not catalog.root_exists(spark, str(tmp_path / "none"))
    df = spark.createDataFrame([("/r/a/../../etc", False), ("/r/./a", True), ("/rx/a", False), ("/r", True), ("/r/../r/b", True)], "p string, want boolean")
    assert df.where(catalog.contained(F.col("p"), F.lit("/r/")) != F.col("want")).count() == 0


def test_embedding_is_tried_again(spark, tmp_path):
    flag = str(tmp_path / "seen")

    def model(texts):
        import os

        if "bad" in texts and len(texts) == 1 and not os.path.exists(flag):
            open(flag, "w").close()
            raise ValueError("once")
        if "bad" in texts and len(texts) > 1 or "worse" in texts:
            raise ValueError("always")
        return [[1.0, 2.0] for _ in texts]

    df = spark.createDataFrame([("good",), ("bad",), ("worse",)], "chunk string")
    got = {r["chunk"]: r["error"] for r in maintenance.embed_with_retry(df, model).collect()}
    assert got == {"good": None, "bad": None, "worse": "always"}
    with pytest.raises(RuntimeError):
        maintenance.embed_with_retry(df.where("chunk = 'worse'"), model)


def test_slugs(spark):
    want = {"README.md": "README.md", "MyFile.MD": "MyFile.MD", "a/b/c/d.md": "a/b/c/d.md", "file (1).md": "file-1.md", "a  -  b.md": "a-b.md", "x___y z.md": "x/y-z.md", "🐘.md": "1f418.md", "🐘🎉 day/ok.md": "1f418-1f389-day/ok.md", "$id.md": "$id.md"}
    df = spark.createDataFrame([(k,) for k in want], "p string")
    assert {r["p"]: r["s"] for r in df.select("p", P.slug(F.col("p")).alias("s")).collect()} == want


def test_contract_codes(spark):
    long = " ".join(["word"] * 40)
    rows = [
        (1, "q", None, [["lex", "a b"], ["vec", "one two three four"], ["hyde", long]]),
        (2, " ", " ", None),
        (3, "q /only:lex", None, [["lex", "a"]]),
        (4, "q", None, [["lex", '"a'], ["lex", "-a"], ["vec", "One  two three four"], ["vec", "one two three four"], ["x", "y"], ["lex"], ["hyde", ""], None]),
        (5, "q", None, [["lex", "how to how to"], ["vec", "latest words of 2031 <think>"], ["vec", "a\nb c d e"], ["vec", "w x y z"], ["vec", "k l m n"]]),
    ]
    df = contract.check_targets(spark.createDataFrame(rows, "id int, query string, intent string, output array<array<string>>"))
    got = {r["id"]: ({c["code"] for c in r["errors"]}, {c["code"] for c in r["warnings"]}, r["valid"], r["quarantined"]) for r in df.collect()}
    assert got[1] == (set(), set(), True, False)
    assert got[2][0] == {"TRAIN_EMPTY_QUERY", "TRAIN_EMPTY_INTENT", "TRAIN_EMPTY_OUTPUT", "TRAIN_MISSING_LEX", "TRAIN_MISSING_VEC"}
    assert got[3][0] == {"TRAIN_ONLY_MODE"} and got[3][3]
    assert got[4][0] == {"TRAIN_LEX_UNMATCHED_QUOTE", "TRAIN_LEX_NO_POSITIVE_TERM", "TRAIN_DUPLICATE_OUTPUT", "TRAIN_INVALID_OUTPUT_TYPE", "TRAIN_INVALID_OUTPUT_PAIR", "TRAIN_EMPTY_OUTPUT_TEXT"}
    assert got[5][0] == {"TRAIN_CHAT_TEMPLATE_LEAK", "TRAIN_MULTILINE_OUTPUT", "TRAIN_TOO_MANY_VEC"} and got[5][1] == {"WARN_TEMPLATE_FINGERPRINT", "WARN_TIME_SENSITIVE"}


def test_render_and_labels(spark):
    row = spark.range(1).select(
        curation.render_document(F.lit("T"), F.lit("a\r\nb"), F.lit(False)).alias("plain"),
        curation.render_document(F.lit("7"), F.lit("x ````y"), F.lit(True)).alias("code"),
        release.size_label(F.lit(1536)).alias("size"), release.span_label(F.lit(3700)).alias("span"),
        T.term_jaccard(F.lit("the quick fox"), F.lit("quick the fix")).alias("j"), T.term_jaccard(F.lit("the"), F.lit("x")).alias("none"),
    ).first()
    assert row["plain"] == "# T\n\na\nb\n" and row["code"] == "# 7\n\n`````\nx ````y\n`````\n"
    assert (row["size"], row["span"], round(row["j"], 6), row["none"]) == ("1.5 KB", "1h 1m", 0.333333, 0.0)
    assert T.canonical_json({"b": [1, {"z": None, "a": "é"}], "a": True}) == '{"a":true,"b":[1,{"a":"é","z":null}]}'


def test_batches_restart_the_sum(spark):
    df = spark.createDataFrame([(i, "x", s) for i, s in enumerate([6, 5, 5, 9, 1, 20, 1])], "id long, p string, size long")
    got = [r["batch"] for r in maintenance.batches(df, "id", "size", ["p"], 64, 10).orderBy("id").collect()]
    assert got == [0, 1, 1, 2, 2, 3, 4]


def test_vectors_in_many_query_blocks(spark, monkeypatch):
    import numpy as np

    from skein.operators import vector

    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    want = sorted(map(tuple, vector.nearest(df, df, "id", "v", 3).select("qid", "id", "rank").collect()))
    monkeypatch.setattr(vector, "ROW_BLOCK", 7)
    assert sorted(map(tuple, vector.nearest(df, df.repartition(3), "id", "v", 3, block=8).select("qid", "id", "rank").collect())) == want


def test_similar_paths_by_keys(spark, monkeypatch):
    import random

    from skein.operators import retrieval

    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("ab/") for _ in range(rng.randint(1, 20))) for _ in range(150)} | {""})
    docs = spark.createDataFrame([(t,) for t in texts], "path string")
    refs = spark.createDataFrame([(t[:-1] + "ab",) for t in texts[::9]] + [(None,)], "ref string")
    want = sorted(map(tuple, retrieval.similar_paths(refs, docs).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 1)
    assert want and sorted(map(tuple, retrieval.similar_paths(refs, docs).collect())) == want


def test_medians(spark):
    from skein.operators import metadata

    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), ("b", 1e308), ("b", 1.7e308), ("c", 5.0)]
    df = spark.createDataFrame([(k, "number", v) for k, v in rows], "key string, value_type string, number_value double")
    assert {r["key"]: r["median"] for r in metadata.number_ranges(df).collect()} == {"a": 2.0, "b": 1.35e308, "c": 5.0}
