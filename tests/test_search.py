import math

import numpy as np
import pytest

from skein.functions import paths, text
from skein.operators import chunking, expansion, fusion, lexical, retrieval, stemming, vector
from skein.plans.hybrid import Store

DOCS = [
    (1, "notes", "notes/apple-pie.md", "Apple pie", "Bake the apple pie. Apple slices, sugar."),
    (2, "notes", "notes/pear.md", "Pear tart", "A pear tart with apple jam and PIO-1384 code."),
    (3, "docs", "docs/tokyo.md", "東京", "東京都は大きい。 Trésorerie"),
    (4, "docs", "docs/empty.md", "Nothing", ""),
    (5, "docs", "docs/code.md", "Multi agent", "The multi-agent memory of agents; sports."),
]
FIELDS = {"path": "path", "title": "title", "body": "text"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, source string, path string, title string, text string").selectExpr("*", "sha2(text, 256) as hash", "true as active", "timestamp'2030-01-01' as modified_at", "doc_id as doc")


def found(spark, docs, query, **kw):
    index = lexical.direct_index(docs, "doc_id", FIELDS, [query])
    return {r["doc"]: r["score"] for r in lexical.search(spark, index, [("q", query)], **kw).collect()}


@pytest.mark.parametrize(
    "query, want",
    [
        ("apple", {1, 2}), ("app", {1, 2}), ('"app"', set()), ('"apple pie"', {1}), ("apple -tart", {1}), ("pio-1384", {2}), ("1384-pio", set()), ("東京", {3}), ("京東", set()),
        ("tresorerie", {3}), ("multi-agent memory", {5}), ("memory -sports", set()), ("-apple", set()), ("apple pear", {2}), ("APPLE", {1, 2}),
    ],
)
def test_query_semantics(spark, docs, query, want):
    if not lexical.parse_query(query):
        assert want == set()
    else:
        assert set(found(spark, docs, query)) == want


def test_bm25_by_hand(spark, docs):
    got = found(spark, docs, '"pear"')[2]
    lens = [sum(len(lexical._plain_tokens(x)) for x in d[2:]) for d in DOCS]
    tf = 1.5 + 4 + 1
    idf = max(math.log((5 - 1 + 0.5) / 1.5), 1e-6)
    s = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens[1] / (sum(lens) / 5)))
    assert got == pytest.approx(s / (1 + s))


def test_written_index_agrees(spark, docs, tmp_path):
    index = lexical.build_index(docs, "doc_id", FIELDS, str(tmp_path / "ix"))
    for q in ("apple", '"apple pie"', "multi-agent memory", "apple -tart"):
        a = {r["doc"]: round(r["score"], 9) for r in lexical.search(spark, index, [("q", q)]).collect()}
        assert a == {k: round(v, 9) for k, v in found(spark, docs, q).items()}
    plan = lexical.search(spark, index, [("q", '"pear"')])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "pear" in plan


def test_scope_keeps_corpus_statistics(spark, docs):
    scope = docs.where("doc_id = 2").selectExpr("doc_id as doc")
    assert found(spark, docs, "apple", scope=scope) == {2: pytest.approx(found(spark, docs, "apple")[2])}


def test_refused_queries():
    assert lexical.check_lexical('a "b') and lexical.check_lexical("a\nb") and not lexical.check_lexical('"a b"')
    assert lexical.check_semantic("find -this") and not lexical.check_semantic("real-time")


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "motoring": "motor", "happy": "happi", "adoption": "adopt", "formaliti": "formal", "controlling": "control", "sky": "sky", "générale": "générale"}
    assert {w: stemming.porter_stem(w) for w in want} == want


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {}
    for r in vector.nearest(df.where("id < 5"), df, "id", "v", 4, block=2).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["id"]
    m = np.array([r[1] for r in rows[:60]], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(5):
        assert [got[q][k] for k in (1, 2, 3, 4)] == list(np.argsort(1 - m @ m[q], kind="stable")[:4])


def test_fusion_and_trace(spark):
    rows = [("q", 0, 0, "a"), ("q", 0, 1, "b"), ("q", 1, 0, "b"), ("q", 1, 1, "c")]
    lists = spark.createDataFrame(rows, "qid string, list int, rank0 int, doc string").selectExpr("*", "list = 0 as original")
    w = fusion.list_weights(lists, False)
    fused = {r["doc"]: (r["rank"], r["score"]) for r in fusion.reciprocal_rank_fusion(w).collect()}
    assert fused["a"] == (2, pytest.approx(2 / 61 + 0.05)) and fused["b"] == (1, pytest.approx(2 / 62 + 1 / 61 + 0.05)) and fused["c"][1] == pytest.approx(1 / 62 + 0.02)
    for r in fusion.fusion_trace(w).collect():
        assert r["total"] == pytest.approx(fused[r["doc"]][1]) and sum(c["share"] for c in r["contributions"]) == pytest.approx(r["base"])


def test_rerank_scores_equal_texts_once(spark):
    df = spark.createDataFrame([("q", "x", 1), ("q", "x", 2), ("q", "y", 3)], "query string, chunk string, id int")
    out = fusion.rerank(df, lambda q, t: [len(set(t)) if len(t) else 0] * len(t))
    assert out.count() == 3 and out.where("rerank_score is null").count() == 0


def test_passages():
    body = "# A\n" + "text line here\n" * 60 + "\n## B\n" + "more words\n" * 300
    got = chunking.passages(body, 1000, 150, 300)
    assert got[0][0] == 0 and got[-1][0] + len(got[-1][1]) == len(body)
    for (p, t), (q, _) in zip(got, got[1:]):
        assert len(t) <= 1000 and q in (p + len(t) - 150, p + len(t))
    assert any(body[p + len(t) :].startswith("\n## B") for p, t in got)
    assert chunking.passages("short") == [(0, "short")]
    fenced = "x\n" * 300 + "```\n" + "code\n\n" * 60 + "```\n" + "y\n" * 300
    region = chunking.fences(fenced)[0]
    assert all(not region[0] < p + len(t) < region[1] for p, t in chunking.passages(fenced, 900, 0, 400)[:-1])


def test_passages_by_tokens():
    got = chunking.passages_by_tokens("word " * 3000, lambda t: len(t) // 2, 300, 40, 60)
    assert all(n <= 300 for _, _, n in got) and got[-1][0] + len(got[-1][1]) == 15000


def test_syntax_points():
    code = "import os\n\n\nclass A:\n    def f(self):\n        pass\n\n\ndef g():\n    pass\n"
    assert [s for _, s in chunking.syntax_points(code, "a.py")] == [60, 100, 90]
    assert chunking.syntax_points("package x\n\nfunc main() {\n}\n", "m.go") == [(10, 90)]
    assert chunking.syntax_points("anything", "x.txt") == []


def test_snippets():
    body = "one\ntwo apple\nthree\nfour\nfive"
    line, shown, before, after, n = retrieval.snippet(body, "apple")
    assert (line, before, after, n) == (2, 0, 1, 4) and shown.startswith("@@ -1,4 @@ (0 before, 1 after)\none\ntwo apple")
    assert retrieval.snippet(body, "absent", at=0)[0] == 1
    long = "\n".join(f"line {i}" for i in range(1000))
    assert retrieval.snippet(long, "absent", at=5000, length=100)[0] == long[:5000].count("\n") + 1
    assert retrieval.snippet("a" * 2000, "a", 100)[1].endswith("...")


def test_references(spark, docs):
    d = docs.selectExpr("doc_id as doc", "source as collection", "path", "hash")
    short = docs.where("doc_id = 1").first()["hash"][:6]
    refs = spark.createDataFrame([(f"#{short}",), ("skein://notes/notes/pear.md:12",), ("docs/docs/code.md",), ("docs/code.md",), ("pear.md",), ("none.md",)], "ref string")
    got = {r["ref"]: (r["tier"], r["doc"]) for r in retrieval.resolve_refs(refs, d).collect()}
    assert got == {f"#{short}": (1, 1), "skein://notes/notes/pear.md:12": (2, 2), "docs/docs/code.md": (3, 5), "docs/code.md": (4, 5), "pear.md": (5, 2)}


def test_globs_and_slugs(spark):
    assert paths.split_masks("**/*.{md,mdx}, a[,]b ,") == ["**/*.{md,mdx}", "a[,]b"]
    import re

    assert re.match(paths.glob_regex("**/*.{md,mdx}"), "a/b/c.mdx") and not re.match(paths.glob_regex("*.md"), "a/b.md")
    df = spark.createDataFrame([("My Notes___Über (1).MD",), ("a/.hidden/x.md",), ("a/node_modules/x.md",), ("ok/x.md",)], "p string")
    got = [tuple(r) for r in df.select(paths.slug(df.p), paths.scannable(df.p, ["ok/*"])).collect()]
    assert got[0] == ("My-Notes/Über-1.MD", True) and [g[1] for g in got] == [True, False, False, False]


def test_expansion_lines(spark):
    raw = "lex: a b\nvec:  c\nbad\nhyde:\nlex: d\r"
    df = spark.createDataFrame([(raw, "q"), ("", "q"), (None, "q"), ("hyde: h\nvec: v", "q")], "raw string, q string")
    lines = expansion.parsed_lines(df.raw)
    rows = df.select(lines.alias("l"), expansion.with_fallback(expansion.usable(lines), df.q).alias("o"), expansion.strict_output(lines).alias("s")).collect()
    assert [x["problem"] for x in rows[0]["l"]] == [None, "invalid_line", "invalid_line", "empty_text", None]
    assert [(x["kind"], x["text"]) for x in rows[0]["o"]] == [("lex", "a b"), ("vec", "c"), ("lex", "d")]
    assert [x["kind"] for x in rows[1]["o"]] == ["hyde", "lex", "vec"] == [x["kind"] for x in rows[2]["o"]]
    assert len(rows[3]["s"]) == 2 and not rows[0]["s"]


def test_query_documents():
    assert expansion.parse_document("just words") is None and expansion.parse_document("expand: words") is None
    subs, intent = expansion.parse_document("intent: why\nlex: a\nvec: b")
    assert intent == "why" and [q.kind for q in subs] == ["lex", "vec"]
    for bad in ("intent: x", "lex: a\nplain", "intent: a\nintent: b\nlex: c", "vec: -x", 'lex: "a', "lex:"):
        with pytest.raises(ValueError):
            expansion.parse_document(bad)


def test_store(spark, docs):
    e = {"apple": [1.0, 0.0], "pear": [0.0, 1.0]}
    vectors = spark.createDataFrame([(1, 10, [1.0, 0.1]), (1, 11, [0.5, 0.5]), (2, 20, [0.1, 1.0])], "doc long, chunk long, embedding array<double>")
    s = Store.of_documents(docs, embed=lambda ts: [e.get(t, [0.5, 0.5]) for t in ts])
    s.vectors = vectors
    assert [r["doc"] for r in s.search_vector("pear", least=0.0).orderBy("rank").collect()] == [2, 1]
    got = s.query("lex: apple\nvec: apple", limit=2).orderBy("rank").collect()
    assert got[0]["doc"] == 1 and len(got) == 2
    assert [r["doc"] for r in s.query(["lex: apple"], collections=["notes"], reranked=False).orderBy("rank").collect()][0] == 1
    assert {r["doc"] for r in s.get(["pear.md"]).select("doc").collect()} == {2} and s.multi_get("docs/*.md").count() == 3


def test_text_functions(spark):
    df = spark.createDataFrame([("ÀB c", "## Notes\n## Real\n", "x/a.md"), ("Z", "plain", "x/b.txt")], "a string, b string, p string")
    got = df.select(text.ascii_fold(df.a), text.fold(df.a), text.title_of(df.b, df.p), text.csv_field(df.b)).collect()
    assert tuple(got[0]) == ("Àb c", "ab c", "Notes", '"## Notes\n## Real\n"') and got[1][2] == "b"


def test_benchmark_harness(spark, docs):
    from skein.plans import harness

    relevant = spark.createDataFrame([("1", 1), ("2", 2)], "qid string, doc long")
    got = harness.benchmark(Store.of_documents(docs), [("1", "apple pie"), ("2", "pear"), ("3", 'bad "quote')], relevant, ("bm25", "vector", "full"), 5)
    s = {r["backend"]: r for r in harness.summary(got).collect()}
    assert set(s) == {"bm25", "full"} and s["bm25"]["recall"] == 1.0 and s["bm25"]["failures"] == 1 and s["full"]["queries"] == 3
