"""Readers of retrieval benchmarks (JSON lines, tab-separated judgements) with validation, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BenchmarkError(ValueError):
    """A benchmark file breaks its contract."""


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``qid, query`` from JSON lines."""
    return spark.read.schema("qid string, query string").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc, path`` from JSON lines with ``doc_id`` and ``path``."""
    return spark.read.schema("doc_id string, path string").json(path).withColumnRenamed("doc_id", "doc")


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """``qid, doc, score`` from a tab-separated file with the header ``query-id, corpus-id, score``."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    if raw.columns != ["query-id", "corpus-id", "score"]:
        raise BenchmarkError(f"unexpected header: {raw.columns}")
    return raw.select(F.col("`query-id`").alias("qid"), F.col("`corpus-id`").alias("doc"), F.col("score").try_cast("int").alias("score"))


def problems(queries: DataFrame, documents: DataFrame, judgements: DataFrame) -> DataFrame:
    """``problem, rows``: repeated ids, scores other than 0 and 1, dangling ids, queries without a relevant document."""

    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("rows"))

    repeated = lambda df, c: df.groupBy(c).count().where("count > 1")
    relevant = judgements.where("score = 1").select("qid").distinct()
    parts = [
        one("repeated_query", repeated(queries, "qid")),
        one("repeated_document", repeated(documents, "doc")),
        one("repeated_judgement", judgements.groupBy("qid", "doc").count().where("count > 1")),
        one("bad_score", judgements.where("score is null or score not in (0, 1)")),
        one("unknown_query", judgements.join(queries, "qid", "left_anti")),
        one("unknown_document", judgements.join(documents, "doc", "left_anti")),
        one("without_relevant", queries.join(relevant, "qid", "left_anti")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("rows > 0")


def checked(queries: DataFrame, documents: DataFrame, judgements: DataFrame) -> None:
    """Raises if the benchmark has any problem."""
    if found := problems(queries, documents, judgements).collect():
        raise BenchmarkError(", ".join(f"{r['problem']}: {r['rows']}" for r in found))


def expansion_problems(queries: DataFrame, expansions: DataFrame) -> DataFrame:
    """``problem, rows`` of an expansion artifact ``qid, status, output (array), error``: each query once, known
    status, output only where the status is ``ok``, an error wherever it is not."""
    size = F.coalesce(F.size("output"), F.lit(0))
    bad = {
        "unknown_status": expansions.where(~F.coalesce("status", F.lit("")).isin("ok", "format_error", "generation_error")),
        "output_despite_error": expansions.where((F.col("status") != "ok") & (size > 0)),
        "missing_error": expansions.where((F.col("status") != "ok") & F.col("error").isNull()),
        "missing_query": queries.join(expansions, "qid", "left_anti"),
        "unknown_query": expansions.join(queries, "qid", "left_anti"),
        "repeated_query": expansions.groupBy("qid").count().where("count > 1"),
    }
    out = None
    for name, df in bad.items():
        part = df.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out.where("rows > 0")


def write_result(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes a result as ``parquet``, ``json`` (lines), ``csv`` or ``tsv``; committed as a whole or not at all."""
    writer = df.write.mode("overwrite")
    if form in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if form == "tsv" else ",").csv(path)
    elif form in ("parquet", "json"):
        getattr(writer, form)(path)
    else:
        raise ValueError(f"unknown form {form}")
