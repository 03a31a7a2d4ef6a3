"""Records of metadata providers, read from their JSON and XML as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import ids, text

_DATE = "STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>"
CROSSREF = (
    f"DOI STRING, type STRING, title ARRAY<STRING>, `container-title` ARRAY<STRING>, ISSN ARRAY<STRING>, author ARRAY<STRUCT<given: STRING, family: STRING, name: STRING, ORCID: STRING>>, "
    f"`published-print` {_DATE}, published {_DATE}, `published-online` {_DATE}, issued {_DATE}"
)
EUROPE_PMC = "id STRING, doi STRING, title STRING, pubYear STRING, abstractText STRING, authorList STRUCT<author: ARRAY<STRUCT<firstName: STRING, lastName: STRING, authorId: STRUCT<type: STRING, value: STRING>>>>"
OPENALEX = "doi STRING, title STRING, publication_year INT, abstract_inverted_index MAP<STRING, ARRAY<INT>>"
ORCID_WORKS = (
    "`group` ARRAY<STRUCT<`work-summary`: ARRAY<STRUCT<`put-code`: BIGINT, title: STRUCT<title: STRUCT<value: STRING>>, `display-index`: STRING, visibility: STRING, "
    "`publication-date`: STRUCT<year: STRUCT<value: STRING>, month: STRUCT<value: STRING>, day: STRUCT<value: STRING>>, "
    "`external-ids`: STRUCT<`external-id`: ARRAY<STRUCT<`external-id-type`: STRING, `external-id-value`: STRING>>>>>>>"
)


def _year(date: str) -> Column:
    return F.get(F.get(F.col(f"m.`{date}`.`date-parts`"), F.lit(0)), F.lit(0))


def crossref(messages: DataFrame, json: str = "json") -> DataFrame:
    """(doi, type, title, year, journal, issn, creators); the print date goes before published, online and issued."""
    m = messages.select(F.from_json(json, CROSSREF).alias("m"))
    year = F.coalesce(*[_year(d) for d in ("published-print", "published", "published-online", "issued")])
    return m.select(
        ids.doi(F.col("m.DOI")).alias("doi"), F.col("m.type").alias("type"), text.plain_title(F.get("m.title", F.lit(0))).alias("title"), year.alias("year"),
        F.get("m.`container-title`", F.lit(0)).alias("journal"), F.filter(F.transform("m.ISSN", ids.issn), lambda x: x.isNotNull()).alias("issn"),
        F.transform("m.author", lambda a: F.struct(a["given"].alias("first_name"), F.coalesce(a["family"], a["name"]).alias("last_name"), ids.orcid(a["ORCID"]).alias("orcid"))).alias("creators"),
    )


def europe_pmc(results: DataFrame, json: str = "json") -> DataFrame:
    """(doi, title, year, abstract, creators)."""
    m = results.select(F.from_json(json, EUROPE_PMC).alias("m"))
    return m.select(
        ids.doi(F.col("m.doi")).alias("doi"), text.plain_title(F.col("m.title")).alias("title"), ids.year(F.col("m.pubYear")).alias("year"), text.plain_title(F.col("m.abstractText")).alias("abstract"),
        F.transform("m.authorList.author", lambda a: F.struct(a["firstName"].alias("first_name"), a["lastName"].alias("last_name"), F.when(a["authorId"]["type"] == "ORCID", ids.orcid(a["authorId"]["value"])).alias("orcid"))).alias("creators"),
    )


def openalex(works: DataFrame, json: str = "json") -> DataFrame:
    """(doi, title, year, abstract): the abstract restored from its inverted index, '' if that has gaps or conflicts."""
    m = works.select(F.from_json(json, OPENALEX).alias("m"))
    placed = F.flatten(F.transform(F.map_entries("m.abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word")))))
    order = F.array_sort(placed)
    n = F.size(order)
    whole = (n > 0) & (n <= 10_000) & (F.transform(order, lambda w: w["pos"]) == F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))
    return m.select(ids.doi(F.col("m.doi")).alias("doi"), text.plain_title(F.col("m.title")).alias("title"), F.col("m.publication_year").alias("year"),
                    F.when(whole, F.array_join(F.transform(order, lambda w: w["word"]), " ")).otherwise("").alias("abstract"))


def orcid_works(activities: DataFrame, key: str = "orcid", json: str = "json") -> DataFrame:
    """(key, title, doi, year, month, day, precision): public works, in each group the preferred assertion.

    A day that does not exist in its month is dropped and the date is precise to the month.
    """
    g = activities.select(key, F.explode(F.from_json(json, ORCID_WORKS)["group"]).alias("g"))
    s = g.select(key, F.filter("g.work-summary", lambda w: w["visibility"].isNull() | (w["visibility"] == "public")).alias("w")).where(F.size("w") > 0)
    best = F.array_max(F.transform("w", lambda w: F.struct(F.coalesce(w["display-index"].try_cast("int"), F.lit(0)).alias("i"), (-w["put-code"]).alias("p"), w.alias("w"))))["w"]
    s = s.select(key, best.alias("b"))
    y, m, d = (F.col(f"b.publication-date.{x}.value").try_cast("int") for x in ("year", "month", "day"))
    month = F.when(m.between(1, 12), m)
    last = F.day(F.last_day(F.make_date(y, F.coalesce(month, F.lit(1)), F.lit(1))))
    day = F.when(month.isNotNull() & (d >= 1) & (d <= last), d)
    found = F.filter("b.external-ids.external-id", lambda e: F.lower(e["external-id-type"]) == "doi")
    return s.select(
        key, F.col("b.title.title.value").alias("title"), ids.doi(F.get(found, F.lit(0))["external-id-value"]).alias("doi"), y.alias("year"), month.alias("month"), day.alias("day"),
        F.when(day.isNotNull(), "day").when(month.isNotNull(), "month").when(y.isNotNull(), "year").otherwise("none").alias("precision"),
    )


def extra_metrics(rows: DataFrame, key: str, extra: str) -> DataFrame:
    """(key, field, value): 'name: value' lines of a free field; a name given two values comes out null."""
    line = rows.select(key, F.explode(F.split(extra, "\n")).alias("line"))
    pair = line.select(key, F.lower(F.trim(F.regexp_extract("line", r"^\s*([^:：]{1,60})[:：]", 1))).alias("field"), F.trim(F.regexp_extract("line", r"[:：](.*)$", 1)).alias("value"))
    pair = pair.where((F.col("field") != "") & (F.col("value") != "")).distinct()
    return pair.groupBy(key, "field").agg(F.when(F.count(F.lit(1)) == 1, F.min("value")).alias("value"))


PUBMED = (
    "MedlineCitation STRUCT<PMID: STRING, Article: STRUCT<ArticleTitle: STRING, Journal: STRUCT<Title: STRING, ISSN: STRING, JournalIssue: STRUCT<PubDate: STRUCT<Year: STRING>>>, "
    "Abstract: STRUCT<AbstractText: ARRAY<STRING>>, AuthorList: STRUCT<Author: ARRAY<STRUCT<LastName: STRING, ForeName: STRING>>>>>"
)


def pubmed(articles: DataFrame, xml: str = "xml") -> DataFrame:
    """(pmid, title, journal, issn, year, abstract, creators) of PubMed article elements."""
    m = articles.select(F.from_xml(xml, PUBMED).alias("m")).select(F.col("m.MedlineCitation.PMID").alias("pmid"), F.col("m.MedlineCitation.Article").alias("a"))
    return m.select(
        "pmid", text.plain_title(F.col("a.ArticleTitle")).alias("title"), F.col("a.Journal.Title").alias("journal"), ids.issn(F.col("a.Journal.ISSN")).alias("issn"),
        ids.year(F.col("a.Journal.JournalIssue.PubDate.Year")).alias("year"), F.array_join("a.Abstract.AbstractText", " ").alias("abstract"),
        F.transform("a.AuthorList.Author", lambda x: F.struct(x["ForeName"].alias("first_name"), x["LastName"].alias("last_name"))).alias("creators"),
    )
