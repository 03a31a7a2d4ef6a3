"""Career timelines and author identifiers from the works at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.functions import ids, text


def works_by_orcid(papers: DataFrame) -> DataFrame:
    """(orcid, identity, year, journal): each work of each ORCID once, however many copies a library holds; missing fields filled from copies."""
    w = papers.select(F.explode("creators.orcid").alias("o"), ids.identity(F.col("doi"), F.col("title"), F.col("year")).alias("identity"), ids.year(F.col("year")).alias("year"), text.clean(F.col("journal")).alias("journal"))
    w = w.select(ids.orcid(F.col("o")).alias("orcid"), "identity", "year", "journal").where("orcid IS NOT NULL AND identity IS NOT NULL")
    return w.groupBy("orcid", "identity").agg(F.max("year").alias("year"), F.max("journal").alias("journal"), F.count(F.lit(1)).alias("copies"))


def timeline(papers: DataFrame) -> DataFrame:
    """(orcid, year, works, journals): works by year, undated ones under 0."""
    return works_by_orcid(papers).groupBy("orcid", F.coalesce("year", F.lit(0)).alias("year")).agg(F.count(F.lit(1)).alias("works"), F.countDistinct("journal").alias("journals"))


def orcid_status(papers: DataFrame) -> DataFrame:
    """(name_id, status, orcid): available with one valid ORCID over all papers, ambiguous with several, missing with none."""
    c = papers.select(F.explode("creators").alias("c")).select(F.col("c.name_id").alias("name_id"), ids.orcid(F.col("c.orcid")).alias("orcid")).where("name_id IS NOT NULL")
    n = c.groupBy("name_id").agg(F.countDistinct("orcid").alias("n"), F.min("orcid").alias("orcid"))
    return n.select("name_id", F.when(F.col("n") == 1, "available").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("status"), F.when(F.col("n") == 1, F.col("orcid")).alias("orcid"))
