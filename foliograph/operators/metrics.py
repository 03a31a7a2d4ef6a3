"""Journal metrics: validation, merge with conflicts kept visible, lookup by ISSN or name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.functions import ids, text
from foliograph.operators.packed import ISSN, split_packed


def metric_rows(metrics: DataFrame) -> DataFrame:
    """(metric_id, jkey, metric_year, jif, category, quartile, source), each imported row once."""
    return metrics.select("metric_id", text.norm(F.col("journal")).alias("jkey"), "metric_year", "jif", "category", "quartile", "source").distinct()


def metric_issns(metrics: DataFrame) -> DataFrame:
    """(metric_id, issn) with right check characters."""
    v = split_packed(metrics, "issn", ["metric_id"], "issn", "pos", shape=ISSN)
    return v.select("metric_id", ids.issn(F.col("issn")).alias("issn")).where("issn IS NOT NULL").distinct()


def merged(metrics: DataFrame) -> DataFrame:
    """(issn, metric_year, rows, jif, categories, conflict): category rows merged; conflict if they disagree on the value or a category's quartile."""
    m = metric_rows(metrics).join(metric_issns(metrics), "metric_id").where("metric_year IS NOT NULL")
    per = m.groupBy("issn", "metric_year", "category").agg(
        F.countDistinct("quartile").alias("quartiles"), F.min("quartile").alias("quartile"), F.count(F.lit(1)).alias("n"), F.min("jif").alias("lo"), F.max("jif").alias("hi")
    )
    return per.groupBy("issn", "metric_year").agg(
        F.sum("n").alias("rows"), F.min("lo").alias("jif"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "category", "quartile"))), "; ").alias("categories"),
        ((F.max("quartiles") > 1) | (F.coalesce(F.min("lo") != F.max("hi"), F.lit(False)))).alias("conflict"),
    )


def lookup(journals: DataFrame, metrics: DataFrame) -> DataFrame:
    """(journal_id, status, metric_year, jif, hits): by ISSN; by name only where the journal has no valid ISSN.

    The latest year counts; several distinct values in it are ambiguous. A
    failed ISSN never falls through to the name: two equi-joins, united.
    """
    j = journals.select("journal_id", text.norm(F.col("title")).alias("jkey"), F.filter(F.transform("issn", ids.issn), lambda x: x.isNotNull()).alias("issns"))
    m = metric_rows(metrics).where("metric_year IS NOT NULL")
    by_issn = j.select("journal_id", F.explode("issns").alias("issn")).join(metric_issns(metrics), "issn").select("journal_id", "metric_id").distinct()
    by_name = j.where(F.size("issns") == 0).join(m.select("jkey", "metric_id"), "jkey").select("journal_id", "metric_id")
    hits = by_issn.unionByName(by_name).join(m, "metric_id").select("journal_id", "metric_year", "jif", "metric_id")
    latest = hits.groupBy("journal_id").agg(F.max("metric_year").alias("metric_year"))
    top = hits.join(latest, ["journal_id", "metric_year"]).groupBy("journal_id", "metric_year").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct(F.coalesce("jif", F.lit(-1.0))).alias("values"), F.min("jif").alias("jif")
    )
    status = F.when(F.col("hits").isNull(), "missing").when(F.col("values") > 1, "ambiguous").otherwise("available")
    return j.select("journal_id").join(top, "journal_id", "left").select(
        "journal_id", status.alias("status"), "metric_year", F.when(status == "available", F.col("jif")).alias("jif"), F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits")
    )


def checked_import(metrics: DataFrame) -> DataFrame:
    """The merged rows, or an error that aborts the whole import if any of them conflicts or any row lacks ISSN or source."""
    rows = merged(metrics)
    bad = rows.where("conflict").count()
    bare = metrics.where("source IS NULL OR trim(source) = ''").count() + metrics.select("metric_id").distinct().join(metric_issns(metrics), "metric_id", "left_anti").count()
    if bad or bare:
        raise ValueError(f"import refused: {bad} conflicting and {bare} incomplete rows")
    return rows.drop("conflict")


OFFLINE = (
    "schema INT, history MAP<STRING, STRUCT<meta: STRUCT<journalName: STRING, issn: STRING, eissn: STRING>, "
    "dataByYear: ARRAY<STRUCT<jcrYear: INT, jif: STRING, category: ARRAY<STRUCT<category: STRING, quartile: STRING>>>>>>, aliases ARRAY<STRUCT<journal: STRING, issn: STRING>>"
)


def offline_package(texts: DataFrame, json: str = "json") -> DataFrame:
    """(journal, issn, names, year, jif, jif_bound, categories): '<0.1' becomes a bound, 'N/A' null; alias ISSNs add their names."""
    p = texts.select(F.from_json(json, OFFLINE).alias("p"))
    j = p.select(F.explode(F.map_entries("p.history")).alias("e")).select(F.col("e.value.meta").alias("m"), F.explode("e.value.dataByYear").alias("y"))
    issns = F.array_distinct(F.filter(F.array(ids.issn(F.col("m.issn")), ids.issn(F.col("m.eissn"))), lambda x: x.isNotNull()))
    rows = j.select(F.col("m.journalName").alias("journal"), issns.alias("issn"), F.col("y.jcrYear").alias("year"), F.col("y.jif").try_cast("double").alias("jif"),
                    F.when(F.col("y.jif").startswith("<"), F.col("y.jif")).alias("jif_bound"), F.col("y.category").alias("categories"))
    alias = p.select(F.explode("p.aliases").alias("a")).select(ids.issn(F.col("a.issn")).alias("i"), F.col("a.journal").alias("name")).where("i IS NOT NULL")
    names = rows.select("journal", F.explode("issn").alias("i")).join(alias, "i").groupBy("journal").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return rows.join(names, "journal", "left")


def choose(values: DataFrame, key: str, signature: list[str]) -> DataFrame:
    """(key, status, n) of metric values from several places: equal ones count once, several distinct ones are ambiguous."""
    n = values.select(key, *signature).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.select(key, F.when(F.col("n") == 1, "available").otherwise("ambiguous").alias("status"), "n")
