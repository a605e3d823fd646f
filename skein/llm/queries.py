"""The queries of the training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import balance, canonical, leakage, packing, pairs, split, subjects, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    entities = pairs.read_pairs(table(spark, d, "qmd_expansion_personal_entities"), "qmd_expansion_personal_entities", "output", lines=False)
    contract = pairs.read_pairs(table(spark, d, "query_expansion_contract_v1"), "query_expansion_contract_v1", "raw_model_output", lines=True)
    return pairs.defective_pairs(entities.unionByName(contract))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.overlaps(table(spark, d, "qmd_expansion_locations"), table(spark, d, "eval_deep_research"), table(spark, d, "qrels"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return leakage.overlap_counts(leakage.overlap_rows(table(spark, d, "qmd_expansion_locations"), table(spark, d, "eval_deep_research"), table(spark, d, "qrels")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.copy_pairs(table(spark, d, "qmd_expansion_sports"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return canonical.collapse_copies(table(spark, d, "qmd_expansion_sports"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    bodies = split.distinct_bodies(table(spark, d, "content"), "hash", "doc", longer_than=3600)
    return split.cut_kinds(split.split_texts(bodies, "doc"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    bodies = split.distinct_bodies(table(spark, d, "content"), "hash", "doc")
    return split.split_texts(bodies, "doc")


def p4_rejoined(spark: SparkSession, d: str) -> DataFrame:
    return split.rejoined(p4_pieces(spark, d))


def _p5(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return balance.balanced_sample(table(spark, d, "distill_records"), table(spark, d, "sample_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d)[1].where("missing > 0").select("source_id", "selection_status")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """The report; ``missing`` and ``sampled`` are counted in the rows really drawn."""
    return _p5(spark, d)[1]


def p5_needs(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the report that do not depend on the draw."""
    return _p5(spark, d)[1].select("source_id", "selection_status", "pool_rows", "need", "missing")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d)[0]


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and those whose ids decode to their text."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = tokens.decode(tokens.encode(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("text") == F.col("back")).alias("equal"))


def p2_ids(spark: SparkSession, d: str) -> DataFrame:
    """Judged ids that the evaluation splits share with the training split."""
    return leakage.id_overlaps(table(spark, d, "qrels")).select("source_id", "split", "ekey", "tkey").distinct()


def _p7_items(spark: SparkSession, d: str) -> DataFrame:
    return tokens.count_tokens(table(spark, d, "documents")).withColumnRenamed("doc_id", "id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_p7_items(spark, d)).withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.compare_rules(_p7_items(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_shares(subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"), with_labelled=True))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_counts, p2_ids, p3_found, p3_groups, p4_found, p4_pieces, p4_rejoined, p5_found, p5_needs, p5_report, p5_sample, p6_ids, p6_round_trip, p7_containers, p7_report, p8_found, p8_shares)}
