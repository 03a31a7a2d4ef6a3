"""Queries of the training-data operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import confusables, linkage, mixing, names, packing, pii
from foliograph.session import table


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.resolve(table(spark, sf_dir, "creator_name"), table(spark, sf_dir, "paper"), table(spark, sf_dir, "reference_item"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entity_pairs(_entities(spark, sf_dir))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select(F.col("n").alias("name_id"), "entity")


def p2_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = linkage.profiles(table(spark, sf_dir, "paper"), "item_id")
    candidates = linkage.profiles(table(spark, sf_dir, "candidate"), "candidate_id", lead="author")
    m = linkage.match(papers, candidates)
    return m.select(F.col("_i").alias("item_id"), F.col("_j").alias("candidate_id"), F.round("confidence", 4).alias("confidence"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_confidence(spark, sf_dir).where("confidence >= 0.5").select("item_id", "candidate_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = confusables.look_alikes(table(spark, sf_dir, "paper"), "item_id", "title")
    raw = confusables.look_alikes(table(spark, sf_dir, "reference_item"), "ref_id", "raw", "source")
    return title.select(F.lit("title").alias("field"), "*").unionByName(raw.select(F.lit("raw").alias("field"), "*"))


def p3_canonical_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "paper").select("item_id", "title").distinct()
    return confusables.canonical_text(papers, "title").select("item_id", "canonical")


def p3_confusable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "reference_item").select("ref_id", "raw").distinct()
    raw = rows.select("raw").where(F.col("raw").rlike("[^\\u0000-\\u036f]"))
    hits = raw.select(F.explode(confusables.findings_udf("raw")).alias("f")).select("f.token", "f.kind")
    return hits.groupBy("token", "kind").agg(F.count(F.lit(1)).alias("n"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = confusables.look_classes(table(spark, sf_dir, "paper"), "item_id", "title").withColumnRenamed("item_id", "key")
    raw = confusables.look_classes(table(spark, sf_dir, "reference_item"), "ref_id", "raw", "source").withColumnRenamed("ref_id", "key")
    return title.select(F.lit("title").alias("field"), "key", "class").unionByName(raw.select(F.lit("raw").alias("field"), "key", "class"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(packing.pack(table(spark, sf_dir, "documents")))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_target")
    return mixing.shares(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).select("doc_id", "kind", "start_char")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_pii(table(spark, sf_dir, "documents"), "public test secret")


def p8_redacted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_pii(table(spark, sf_dir, "documents"), "public test secret", dates=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p2_found": p2_found,
    "p2_confidence": p2_confidence,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p3_canonical_titles": p3_canonical_titles,
    "p3_confusable_tokens": p3_confusable_tokens,
    "p6_containers": p6_containers,
    "p6_report": p6_report,
    "p7_selection": p7_selection,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
    "p8_redacted_dates": p8_redacted_dates,
}

ORACLE: dict[str, str] = {}
