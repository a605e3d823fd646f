import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skein.llm import split


def pieces(spark, docs, **kw):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, doc string")
    out = {}
    for r in split.split_texts(df, "doc", **kw).collect():
        out.setdefault(r["id"], []).append(r)
    return {i: sorted(v, key=lambda r: r["seq"]) for i, v in out.items()}


def test_pieces_cover_and_overlap(spark):
    rng = random.Random(3)
    words = ["ab", "cde.", "longer", "\n", "\n\n", "# head", "。", "é", "😀"]
    docs = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 30, 200, 900)] + ["x" * 1000, "y " * 400, "z" * 95 + " " + "w" * 400]
    for i, rows in pieces(spark, docs, limit=100, overlap=15).items():
        assert rows[0]["start"] == 0 and rows[-1]["start"] + rows[-1]["n_chars"] == len(docs[i])
        for a, b in zip(rows, rows[1:]):
            assert b["start"] <= a["start"] + a["n_chars"] < b["start"] + b["n_chars"]
        for r in rows:
            assert r["piece"] == docs[i][r["start"] : r["start"] + r["n_chars"]] and len(r["piece"]) <= 100
        forced = bool(re.search(r"[^ \t\r\n。！？]{100}[^ \t\r\n]", docs[i]))
        assert any(r["forced"] for r in rows) == forced


def test_exact_overlap_in_plain_text(spark):
    doc = "word " * 3000
    rows = pieces(spark, [doc])[0]
    assert all(a["start"] + a["n_chars"] - b["start"] == 540 for a, b in zip(rows, rows[1:]))
    assert all(len(r["piece"]) <= 3600 for r in rows)


def test_strong_boundaries_first(spark):
    doc = "a b c. " * 9 + "\n# Title\n" + "d e f. " * 9
    rows = pieces(spark, [doc], limit=100, overlap=10)[0]
    assert rows[0]["piece"].endswith("\n") and rows[1]["piece"][10:].startswith("# Title")


def test_edge_rows(spark):
    got = pieces(spark, [None, "", "short"])
    assert 0 not in got and got[1][0]["piece"] == "" and got[2][0]["n_chars"] == 5
    clash = spark.createDataFrame([("k", "q" * 50, 7)], "seq string, doc string, piece int")
    assert split.split_texts(clash, "doc", 20, 5).columns == split.OUTPUT
    empty = spark.createDataFrame([], "hash string, doc string")
    assert split.cut_kinds(split.split_texts(split.distinct_bodies(empty, "hash", "doc"), "doc")).count() == 0
    with pytest.raises(ValueError):
        split.piece_pattern(10, 10)


def test_redelivered_and_null_hash(spark):
    df = spark.createDataFrame([("h", "a" * 5000), ("h", "a" * 5000), (None, "b " * 3000), ("s", "tiny")], "hash string, doc string")
    kinds = {r["hash"]: r["cut"] for r in split.cut_kinds(split.split_texts(split.distinct_bodies(df, "hash", "doc", 3600), "doc")).collect()}
    assert kinds.pop("h") == "forced" and list(kinds.values()) == ["natural"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab .\n\r。#é", max_size=400))
def test_any_text(spark, text):
    rows = pieces(spark, [text], limit=40, overlap=7)[0]
    joined = rows[0]["piece"]
    for a, b in zip(rows, rows[1:]):
        joined += b["piece"][a["start"] + a["n_chars"] - b["start"] :]
    assert joined == text and all(len(r["piece"]) <= 40 for r in rows)
