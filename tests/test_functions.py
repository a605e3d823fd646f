import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skein.functions import paths, text
from skein.operators import chunking, lexical, retrieval
from skein.session import broadcast_rows, plan_bytes


def test_tokens_agree_with_the_query_side(spark):
    samples = ["Ünïcödé Straße PIO-1384", "東京タワー tower", "a_b c'd", "ＡＢ １２", "한국어 x", "", "İstanbul ΣΑΣ", "tab\tnew\nline"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for r in df.select("s", text.tokens(df.s).alias("t")).collect():
        assert list(r["t"]) == lexical._plain_tokens(r["s"]), r["s"]


def test_jaccard_and_grams(spark):
    df = spark.createDataFrame([("ab", "abc"), ("", ""), ("abcd", "bcde")], "a string, b string")
    got = [r[0] for r in df.select(text.jaccard(text.gram_set(df.a), text.gram_set(df.b))).collect()]
    assert got == [0.0, 1.0, 1 / 3]


def test_intents_and_queries(spark):
    df = spark.createDataFrame([("Looking for  the (API) notes, SQL!", "  Find /only:lex  THIS "), (None, None)], "i string, q string")
    got = df.select(text.intent_terms(df.i), text.normal_query(df.q)).collect()
    assert got[0][0] == ["api", "sql"] and got[0][1] == "find this" and got[1][0] is None


def test_paths(spark):
    df = spark.createDataFrame([("skein:////c/a b/x.md?index=i",), ("//c/y.md",), ("plain",)], "p string")
    got = [r[0] for r in df.select(paths.virtual_parts(df.p)).collect()]
    assert tuple(got[0]) == ("c", "a b/x.md", "i") and tuple(got[1]) == ("c", "y.md", None) and got[2] is None
    enc = spark.createDataFrame([("a b/ü",)], "p string")
    assert enc.select(paths.encode_path(enc.p)).first()[0] == "a%20b/%C3%BC"
    m = spark.createDataFrame([("skein://c/d/x.md", "d/X.md"), ("ad/x.md", "d/x.md")], "a string, b string")
    assert [r[0] for r in m.select(paths.paths_match(m.a, m.b)).collect()] == [True, False]
    like = spark.createDataFrame([("50%_#",)], "s string")
    assert like.select(text.like_escape(like.s)).first()[0] == "50#%#_##"


def test_docids(spark):
    df = spark.createDataFrame([("#abc123",), ("'ABCDEF0'",), ("abc12",), ("xyz123",)], "d string")
    assert [tuple(r) for r in df.select(paths.normal_docid(df.d), paths.is_docid(df.d)).collect()] == [("abc123", True), ("ABCDEF0", True), ("abc12", False), ("xyz123", False)]


def test_formats(spark):
    row = ("abcdef", 0.40625, "skein://c/a&b.md", 'T "q"', None, 3, "one,two\n<x>")
    df = spark.createDataFrame([row], "docid string, score double, file string, title string, context string, line int, snippet string")
    assert retrieval.as_csv(df).first()["row"] == '#abcdef,0.4063,skein://c/a&b.md,"T ""q""",,3,"one,two\n<x>"'
    assert "<file docid=\"#abcdef\" name=\"skein://c/a&amp;b.md\" title=\"T &quot;q&quot;\">\none,two\n&lt;x&gt;\n</file>" == retrieval.as_xml(df).first()["row"]
    assert retrieval.as_files(df).first()["row"] == "#abcdef,0.41,skein://c/a&b.md"
    assert '"score":0.41' in retrieval.as_json(df).first()["row"]


def test_contexts_and_owners(spark):
    docs = spark.createDataFrame([(1, "c", "talks/x.md"), (2, "c", "y.md"), (3, "d", "talk")], "doc long, collection string, path string")
    ctx = spark.createDataFrame([(None, "", "g"), ("c", "talk", "t"), ("c", "", "root")], "collection string, prefix string, text string")
    got = {r["doc"]: list(r["contexts"]) for r in retrieval.contexts_of(docs, ctx).collect()}
    assert got == {1: ["g", "root", "t"], 2: ["g", "root"], 3: ["g"]}
    assert {r["doc"]: r["text"] for r in retrieval.nearest_context(docs, ctx).collect()} == {1: "t", 2: "root", 3: "g"}


def test_read_limits(spark):
    df = spark.createDataFrame([("x" * 70_000,), ("ok",)], "body string")
    rows = retrieval.read_many(df).collect()
    assert rows[0]["body"] is None and rows[0]["skipped"] == "file too large (68KB > 64KB)" and rows[1]["skipped"] is None
    assert df.limit(1).select(retrieval.body_lines(df.body, 1, 1)).first()[0] == "x" * 70_000


def test_broadcast_bounds(spark):
    small = spark.range(10)
    assert plan_bytes(small) < 1000 and "ResolvedHint" not in broadcast_rows(small, 10**9)._jdf.queryExecution().analyzed().toString()


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab #-`\n1.*😀", max_size=600))
def test_passages_lose_nothing(body):
    got = chunking.passages(body, 80, 12, 30)
    end = 0
    for p, t in got:
        assert body[p : p + len(t)] == t and p <= end and len(t) <= 80
        end = p + len(t)
    assert end == len(body)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet='ab -"東\'_.', max_size=30))
def test_any_lexical_query_parses(q):
    for p in lexical.parse_query(q):
        assert p.terms and all(re.fullmatch(r"\w+", t) for t in p.terms)
