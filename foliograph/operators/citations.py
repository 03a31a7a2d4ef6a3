"""Citation mentions in running text: numeric ranges and author-year, resolved to papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.functions import ids, text
from foliograph.operators.linking import lead

HIGHEST, WIDEST = 9999, 100
_BRACKET = r"\[(\d{1,4}(?: ?[-–,;] ?\d{1,4})*)\]"
_AUTHOR_YEAR = r"(\p{Lu}[\p{L}’'-]+)(?: et al\.?| (?:and|und|et|y|&) \p{Lu}[\p{L}’'-]+)?,? \(?((?:1[5-9]|20)\d{2})"


def numeric_mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, mention, number): every number a bracketed mention stands for; ranges of at most 100 are written out."""
    m = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_BRACKET), F.lit(1))).alias("mention", "body"))
    part = m.select("doc_id", "mention", F.explode(F.split("body", "[,;]")).alias("p"))
    ends = F.transform(F.split("p", "[-–]"), lambda x: F.trim(x).try_cast("int"))
    part = part.select("doc_id", "mention", ends[0].alias("lo"), F.element_at(ends, -1).alias("hi"))
    part = part.where((F.col("lo") >= 1) & (F.col("hi") >= F.col("lo")) & (F.col("hi") <= HIGHEST) & (F.col("hi") - F.col("lo") <= WIDEST))
    return part.select("doc_id", "mention", F.explode(F.sequence("lo", "hi")).alias("number")).distinct()


def author_year_mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, author, year, times)."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_AUTHOR_YEAR), F.lit(0))).alias("m"))
    return found.select(
        "doc_id", text.norm(F.regexp_extract("m", r"^(\p{Lu}[\p{L}’'-]+)", 1)).alias("author"), F.regexp_extract("m", r"(\d{4})$", 1).cast("int").alias("year")
    ).groupBy("doc_id", "author", "year").agg(F.count(F.lit(1)).alias("times"))


def resolve_mentions(docs: DataFrame, papers: DataFrame) -> DataFrame:
    """(doc_id, author, year, status, hits): author-year mentions against papers by lead author and year; several papers are ambiguous."""
    p = papers.select("item_id", lead(F.get("creators", F.lit(0))["last_name"]).alias("author"), ids.year(F.col("year")).alias("year")).distinct()
    n = p.where("author IS NOT NULL AND year IS NOT NULL").groupBy("author", "year").agg(F.count(F.lit(1)).alias("hits"))
    m = author_year_mentions(docs).join(n, ["author", "year"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return m.select("doc_id", "author", "year", F.when(F.col("hits") == 1, "matched").when(F.col("hits") > 1, "ambiguous").otherwise("missing").alias("status"), "hits")


def repeated_lines(docs: DataFrame, least: int = 2) -> DataFrame:
    """(line, docs): short line keys that stand in several documents, as running headers do; digits count as one."""
    line = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    key = F.regexp_replace(text.norm(F.col("line")), "[0-9]+", "0")
    return line.select("doc_id", key.alias("line")).where(F.length("line").between(4, 80)).groupBy("line").agg(F.countDistinct("doc_id").alias("docs")).where(F.col("docs") >= least)


def audit(resolved: DataFrame) -> DataFrame:
    """(doc_id, expected, matched, unresolved, status): of each document's mentions, how many found their record; ambiguous ones have not."""
    ok = F.col("status") == "matched"
    by = resolved.groupBy("doc_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if(ok).alias("matched"), F.count_if(~ok).alias("unresolved"))
    return by.withColumn("status", F.when(F.col("unresolved") == 0, "complete").when(F.col("matched") == 0, "none").otherwise("partial"))
