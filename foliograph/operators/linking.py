"""References and candidates linked to papers; ambiguity is a result, never broken by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliograph.functions import ids, text

#: A title shorter than this identifies nothing by itself.
SHORTEST_TITLE = 20


def lead(c: Column) -> Column:
    """The longest word of a name as typed, its family name in most styles."""
    words = F.filter(F.split(text.norm(c), " "), lambda w: w != "")
    return F.substring(F.array_max(F.transform(words, lambda w: F.concat(F.lpad(F.length(w).cast("string"), 3, "0"), w))), 4, 10_000)


def paper_keys(papers: DataFrame) -> DataFrame:
    """(item_id, id, library_id, doi, tkey, year, lead), each paper once."""
    return papers.select(
        "item_id", "id", "library_id", ids.doi(F.col("doi")).alias("doi"), text.norm(F.col("title")).alias("tkey"), ids.year(F.col("year")).alias("year"),
        lead(F.get("creators", F.lit(0))["last_name"]).alias("lead"),
    ).distinct()


def link_references(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """(ref_id, source, status, hits, item_id): by DOI; without one by title, year and lead author.

    A DOI that no paper has is missing, whatever the title says. Copies in the
    citing paper's library go before others; a paper never cites itself. Two
    equi-joins and one grouping; a reference's hits are as few as copies of a work.
    """
    p = paper_keys(papers)
    r = refs.select(
        "ref_id", "source", ids.doi(F.col("doi")).alias("doi"), text.norm(F.col("title")).alias("tkey"), ids.year(F.col("year")).alias("year"), lead(F.col("author")).alias("lead")
    ).distinct()
    by_doi = r.where("doi IS NOT NULL").join(p.select("doi", "item_id", "id", "library_id"), "doi")
    keys = ["tkey", "year", "lead"]
    by_title = r.where(F.col("doi").isNull() & (F.length("tkey") >= SHORTEST_TITLE)).join(p.select(*keys, "item_id", "id", "library_id"), keys)
    hits = by_doi.select("ref_id", "source", "item_id", "id", "library_id").unionByName(by_title.select("ref_id", "source", "item_id", "id", "library_id"))
    hits = hits.where("id <> source").withColumn("own", (F.split("source", ":")[0] == F.col("library_id").cast("string")).cast("int"))
    found = hits.groupBy("ref_id").agg(
        F.max("own").alias("near"), F.count(F.lit(1)).alias("every"), F.sum("own").alias("same"),
        F.min(F.when(F.col("own") == 1, F.col("item_id"))).alias("near_item"), F.min("item_id").alias("any_item"),
    )
    n = F.when(F.col("near") == 1, F.col("same")).otherwise(F.coalesce("every", F.lit(0)))
    out = r.select("ref_id", "source").join(found, "ref_id", "left").withColumn("hits", n.cast("bigint"))
    status = F.when(F.col("hits") == 1, "matched").when(F.col("hits") > 1, "ambiguous").otherwise("missing")
    item = F.when(F.col("hits") == 1, F.when(F.col("near") == 1, F.col("near_item")).otherwise(F.col("any_item")))
    return out.select("ref_id", "source", status.alias("status"), "hits", item.alias("item_id"))


def related_edges(papers: DataFrame) -> DataFrame:
    """(a, b), a < b: items that name each other, in either direction, once."""
    p = papers.select("item_id", "id", "library_id", "related_keys").distinct()
    named = p.select("item_id", "library_id", F.explode("related_keys").alias("k"))
    named = named.select("item_id", F.when(F.col("k").contains(":"), F.col("k")).otherwise(F.concat_ws(":", F.col("library_id").cast("string"), "k")).alias("id"))
    both = named.join(p.select(F.col("item_id").alias("other"), "id"), "id").where("item_id <> other")
    return both.select(F.least("item_id", "other").alias("a"), F.greatest("item_id", "other").alias("b")).distinct()


def judge_candidates(papers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(item_id, candidate_id, score, rank, status): candidates of a paper's DOI or title, scored and decided.

    Score 1 for an equal DOI, else .7 title + .18 author + .12 year. Rejected:
    different DOIs, titles below .52, years more than one apart, different lead
    authors. matched: equal DOI (and year, where both are known), or without a
    DOI a score of .93 with a lead of .12, equal year and author; else review.
    """
    p = papers.select("item_id", ids.doi(F.col("doi")).alias("doi"), text.norm(F.col("title")).alias("tkey"), text.tokens(F.col("title")).alias("words"), ids.year(F.col("year")).alias("year"), lead(F.get("creators", F.lit(0))["last_name"]).alias("lead")).distinct()
    c = candidates.select("candidate_id", ids.doi(F.col("doi")).alias("cdoi"), text.norm(F.col("title")).alias("ckey"), text.tokens(F.col("title")).alias("cwords"), ids.year(F.col("year")).alias("cyear"), lead(F.col("author")).alias("clead")).distinct()
    by_doi = p.join(c, p["doi"] == c["cdoi"])
    by_title = p.join(c, (p["tkey"] == c["ckey"]) & (F.length("tkey") >= SHORTEST_TITLE))
    j = by_doi.unionByName(by_title).dropDuplicates(["item_id", "candidate_id"])
    like = text.dice(F.col("words"), F.col("cwords"))
    same_lead, same_year = F.coalesce(F.col("lead") == F.col("clead"), F.lit(False)), F.coalesce(F.col("year") == F.col("cyear"), F.lit(False))
    exact = F.coalesce(F.col("doi") == F.col("cdoi"), F.lit(False))
    bad = (F.coalesce(F.col("doi") != F.col("cdoi"), F.lit(False)) | ((F.length("tkey") >= 10) & (F.length("ckey") >= 10) & (like < 0.52))
           | F.coalesce(F.abs(F.col("year") - F.col("cyear")) > 1, F.lit(False)) | F.coalesce(F.col("lead") != F.col("clead"), F.lit(False)))
    score = F.round(F.when(exact, 1.0).otherwise(0.7 * like + 0.18 * same_lead.cast("int") + 0.12 * same_year.cast("int")), 6)
    j = j.where(~bad).select("item_id", "candidate_id", score.alias("score"), exact.alias("exact"), same_lead.alias("a"), same_year.alias("y"), F.col("doi").isNull().alias("bare"), (F.col("year").isNull() | F.col("cyear").isNull()).alias("undated"))
    w = W.partitionBy("item_id").orderBy(F.col("score").desc(), "candidate_id")
    j = j.withColumn("rank", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    won = F.col("exact") & (F.col("undated") | F.col("y")) | F.col("bare") & (F.col("score") >= 0.93) & (F.col("score") - F.col("next") >= 0.12) & F.col("y") & F.col("a")
    return j.select("item_id", "candidate_id", "score", "rank", F.when((F.col("rank") == 1) & won, "matched").otherwise("review").alias("status"))


def fill_missing(papers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(item_id, doi, year, journal): empty fields filled from the paper's one matched candidate, others kept."""
    won = judge_candidates(papers, candidates).where("status = 'matched'").select("item_id", "candidate_id")
    c = candidates.select("candidate_id", ids.doi(F.col("doi")).alias("cdoi"), ids.year(F.col("year")).alias("cyear"), text.clean(F.col("journal")).alias("cjournal")).distinct()
    p = papers.select("item_id", ids.doi(F.col("doi")).alias("doi"), ids.year(F.col("year")).alias("year"), text.clean(F.col("journal")).alias("journal")).distinct()
    return p.join(won.join(c, "candidate_id"), "item_id", "left").select(
        "item_id", F.coalesce("doi", "cdoi").alias("doi"), F.coalesce("year", "cyear").alias("year"), F.coalesce(F.nullif("journal", F.lit("")), "cjournal").alias("journal")
    )


def union_references(refs: DataFrame) -> DataFrame:
    """One row per source and identity of reference: the longest text, how many extractors and rows gave it."""
    r = refs.select("ref_id", "source", "raw", "extractor", ids.identity(F.col("doi"), F.col("title"), F.col("year")).alias("identity")).distinct()
    r = r.withColumn("identity", F.coalesce("identity", F.concat(F.lit("raw:"), text.norm(F.col("raw")))))
    best = F.max_by("ref_id", F.struct(F.length("raw"), -F.col("ref_id")))
    return r.groupBy("source", "identity").agg(best.alias("ref_id"), F.countDistinct("extractor").alias("extractors"), F.count(F.lit(1)).alias("rows"))
