import unicodedata

from skein.llm import canonical

SCHEMA = "record_id long, query string, output array<array<string>>, root string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def pairs(spark, rows):
    return {(r["record_id"], r["copy_id"]) for r in canonical.copy_pairs(frame(spark, rows)).collect()}


def test_formatting_copies(spark):
    rows = [
        (5, "Straße Café", [["lex", "a b"], ["vec", "c"]]),
        (3, "STRASSE café!", [["VEC", " C. "], ["lex", "A-B"]]),
        (9, "strasse " + unicodedata.normalize("NFD", "café"), [["lex", "a​b"], ["vec", "c"]]),
        (4, "strasse cafe", [["lex", "a b"], ["vec", "c"]]),  # accents count
        (6, "straße café", [["vec", "a b"], ["lex", "c"]]),  # types count
        (7, "straße café", [["lex", "ab"], ["lex", "ab"], ["vec", "c"]]),  # entries count
    ]
    assert pairs(spark, rows) == {(3, 5), (3, 9)}


def test_null_and_empty_are_no_cases(spark):
    rows = [(1, None, [["lex", "a"]]), (2, None, [["lex", "a"]]), (3, "q", None), (4, "q", None), (5, "q", []), (6, "q", []), (7, "q", [[None, None]]), (8, "Q", [["", ""]])]
    assert pairs(spark, rows) == {(7, 8)}


def test_identical_rows_and_long_texts(spark):
    long = "wort " * 20_000
    rows = [(i, long, [["lex", "x"]]) for i in range(20)] + [(100, long.upper(), [["lex", "X"]])]
    assert pairs(spark, rows) == {(0, i) for i in range(1, 20)} | {(0, 100)}
    g = canonical.collapse_copies(frame(spark, rows)).collect()
    assert [(r["record_id"], r["n_copies"]) for r in g] == [(0, 21)]


def test_empty_table(spark):
    assert pairs(spark, []) == set()


def test_hot_groups_take_the_broadcast_path(spark):
    from skein.session import heavy_split_join

    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 99)], "k string, v int")
    groups = spark.createDataFrame([("hot", 50, "H"), ("cold", 1, "C")], "k string, n long, g string")
    out = heavy_split_join(rows, groups, "k", "n", 51, share=10, least=10).collect()
    assert len(out) == 51 and {r["g"] for r in out} == {"H", "C"}
