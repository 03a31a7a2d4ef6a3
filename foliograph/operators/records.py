"""Records and what belongs to them: list search, sources still valid, edges in scope, enrichment of creators, members of an author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import ids, text

#: A journal with more hits than this is reported as ambiguous instead of being cut short.
MOST_HITS = 500
#: Papers shown of one opened author.
MEMBERS = 120


def list_search(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose normalised columns, put together, contain the normalised query; an empty query keeps all. Null columns count as empty."""
    hay = F.coalesce(text.norm(F.concat_ws(" ", *columns)), F.lit(""))
    return df.where(hay.contains(F.coalesce(text.norm(F.lit(query)), F.lit(""))))


def valid_sources(entries: DataFrame, papers: DataFrame) -> DataFrame:
    """Entries (source, attachment_id, attachment_key) whose citing paper still holds that attachment; a semi-join, so nothing is repeated."""
    held = papers.select(F.col("id").alias("source"), F.explode("attachments").alias("a")).select("source", F.col("a.id").alias("attachment_id"), F.col("a.key").alias("attachment_key")).distinct()
    return entries.join(held, ["source", "attachment_id", "attachment_key"], "left_semi")


def in_scope(edges: DataFrame, scope: DataFrame, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """Edges of which both ends lie in the scope; null ends never do."""
    nodes = scope.select(F.col(node).alias("_n")).distinct()
    kept = edges.join(nodes.withColumnRenamed("_n", a), a, "left_semi").join(nodes.withColumnRenamed("_n", b), b, "left_semi")
    return kept.select(*edges.columns)


def quartiles(c: Column) -> Column:
    """The distinct quartiles Q1 to Q4 named in a text, in order of first mention; an empty array if there is none, null for null."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b(q[1-4])\b"), F.lit(1)), lambda q: F.upper(q)))


def metric_number(c: Column) -> Column:
    """A metric's value as typed, without blanks: digits with an optional fraction and '<' before it, which stays text; else null."""
    s = F.regexp_replace(c, r"\s", "")
    return F.when(s.rlike(r"^<?[0-9]+(\.[0-9]+)?$"), s)


def pmids(c: Column) -> Column:
    """The distinct PubMed numbers labelled as such in a text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)\bPMID:? ?([1-9][0-9]{0,8})\b"), F.lit(1)))


def enrich_creators(papers: DataFrame) -> DataFrame:
    """(name_id, orcid): creators without ORCID that take it from a copy of their paper (equal DOI).

    Two names fit if families agree and given names begin with the same letter.
    A name takes an ORCID only if it fits one name of the copy and that name
    fits no other of its own paper; names that would take different ORCIDs take
    none. Repeated rows count once.
    """
    c = papers.select("item_id", ids.doi(F.col("doi")).alias("d"), F.posexplode("creators").alias("pos", "c")).where("d IS NOT NULL")
    c = c.select("item_id", "d", "pos", F.col("c.name_id").alias("name_id"), ids.orcid(F.col("c.orcid")).alias("orcid"), F.concat_ws("|", text.norm(F.col("c.last_name")), F.substring(text.norm(F.col("c.first_name")), 1, 1)).alias("k")).distinct()
    alone = c.where("k <> ''").groupBy("item_id", "d", "k").agg(F.count(F.lit(1)).alias("n"), F.min("name_id").alias("name_id"), F.min("orcid").alias("orcid")).where("n = 1")
    # ORCIDs of one DOI and name are gathered before names meet them, so copies are never paired
    known = alone.where("orcid IS NOT NULL").groupBy("d", "k").agg(F.min("orcid").alias("orcid"), F.countDistinct("orcid").alias("m")).where("m = 1").select("d", "k", "orcid")
    got = alone.where("orcid IS NULL AND name_id IS NOT NULL").select("d", "k", "name_id").join(known, ["d", "k"])
    return got.groupBy("name_id").agg(F.min("orcid").alias("orcid"), F.countDistinct("orcid").alias("m")).where("m = 1").select("name_id", "orcid")


def expand_members(papers: DataFrame, most: int = MEMBERS) -> DataFrame:
    """(author, item_id, rank): of each spelled-out author the newest papers, at most `most` as the view shows them; undated last, then by id."""
    p = papers.select("item_id", ids.year(F.col("year")).alias("y"), F.explode("creators").alias("c"))
    p = p.select("item_id", "y", ids.author_key(F.col("c.first_name"), F.col("c.last_name")).alias("author")).where("author IS NOT NULL").distinct()
    w = Window.partitionBy("author").orderBy(F.col("y").desc_nulls_last(), "item_id")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("author", "item_id", "rank")


def metric_search(journals: DataFrame, metrics: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """(journal_id, hits, status): rows of the journal's exact normalised title; more than `most` are ambiguous, never cut short."""
    m = metrics.select("metric_id", text.norm(F.col("journal")).alias("k")).distinct().where("k <> ''").groupBy("k").agg(F.count(F.lit(1)).alias("hits"))
    j = journals.select("journal_id", text.norm(F.col("title")).alias("k")).join(m, "k", "left")
    hits = F.coalesce("hits", F.lit(0)).cast("bigint")
    return j.select("journal_id", hits.alias("hits"), F.when(hits == 0, "missing").when(hits > most, "ambiguous").otherwise("available").alias("status"))
