import json

import pytest

from skein.session import drop_materialized, materialize
from skein.sources import benchmarks as b


def files(tmp_path, scores):
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"qid": q, "query": "x"}) for q in ("1", "2")))
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"doc_id": d, "path": d}) for d in ("a", "b")))
    (tmp_path / "r.tsv").write_text("query-id\tcorpus-id\tscore\n" + "\n".join("\t".join(r) for r in scores))
    return tmp_path


def load(spark, p):
    return b.read_queries(spark, str(p / "q.jsonl")), b.read_documents(spark, str(p / "d.jsonl")), b.read_judgements(spark, str(p / "r.tsv"))


def test_sound_benchmark(spark, tmp_path):
    b.checked(*load(spark, files(tmp_path, [("1", "a", "1"), ("2", "b", "1"), ("2", "a", "0")])))


def test_problems(spark, tmp_path):
    parts = load(spark, files(tmp_path, [("1", "a", "1"), ("1", "a", "1"), ("2", "z", "2"), ("9", "a", "x")]))
    got = {r["problem"]: r["rows"] for r in b.problems(*parts).collect()}
    assert got == {"repeated_judgement": 1, "bad_score": 2, "unknown_query": 1, "unknown_document": 1, "without_relevant": 1}
    with pytest.raises(b.BenchmarkError):
        b.checked(*parts)
    (tmp_path / "r.tsv").write_text("q\td\ts\n1\ta\t1")
    with pytest.raises(b.BenchmarkError):
        b.read_judgements(spark, str(tmp_path / "r.tsv"))


def test_expansion_artifacts(spark):
    q = spark.createDataFrame([("1",), ("2",)], "qid string")
    e = spark.createDataFrame([("1", "ok", ["x"], None), ("3", "format_error", ["y"], None)], "qid string, status string, output array<string>, error string")
    assert {r["problem"] for r in b.expansion_problems(q, e).collect()} == {"output_despite_error", "missing_error", "missing_query", "unknown_query"}


def test_writers_and_clean_up(spark, tmp_path):
    df = materialize(spark.range(5), "t")
    for form in ("parquet", "json", "csv", "tsv"):
        b.write_result(df, str(tmp_path / form), form)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 5 and drop_materialized(spark) >= 1
    with pytest.raises(ValueError):
        b.write_result(df, str(tmp_path / "x"), "xlsx")
