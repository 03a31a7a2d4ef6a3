"""Scalar functions over the library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import ids, sql, text
from foliograph.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


@query(f"SELECT DISTINCT item_id, {sql.doi('doi')} AS doi FROM paper")
def q_doi_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paper").select("item_id", ids.doi(F.col("doi")).alias("doi")).distinct()


@query(f"SELECT DISTINCT item_id, {sql.identity('doi', 'title', 'year')} AS identity FROM paper")
def q_identity_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paper").select("item_id", ids.identity(F.col("doi"), F.col("title"), F.col("year")).alias("identity")).distinct()


@query(f"SELECT DISTINCT metric_id, {sql.issn('issn')} AS issn FROM metric_import WHERE length(regexp_replace(issn, '[^0-9Xx]', '', 'g')) <= 8")
def q_issn_checksum(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "metric_import").where(F.length(F.regexp_replace("issn", "[^0-9Xx]", "")) <= 8)
    return rows.select("metric_id", ids.issn(F.col("issn")).alias("issn")).distinct()


@query(f"SELECT DISTINCT o AS typed, {sql.orcid('o')} AS orcid FROM (SELECT DISTINCT c.orcid AS o FROM (SELECT unnest(creators) AS c FROM paper) WHERE c.orcid IS NOT NULL)")
def q_orcid_checksum(spark: SparkSession, d: str) -> DataFrame:
    typed = table(spark, d, "paper").select(F.explode("creators.orcid").alias("typed")).where("typed IS NOT NULL").distinct()
    return typed.select("typed", ids.orcid(F.col("typed")).alias("orcid"))


@query(f"SELECT DISTINCT item_id, {sql.norm('title')} AS title FROM paper")
def q_norm_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paper").select("item_id", text.norm(F.col("title")).alias("title")).distinct()


@query(f"SELECT DISTINCT candidate_id, {sql.plain_title('title')} AS title FROM candidate")
def q_plain_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate").select("candidate_id", text.plain_title(F.col("title")).alias("title")).distinct()


@query(f"""
WITH p AS (SELECT DISTINCT item_id, {sql.doi('doi')} AS doi, {sql.tokens('title')} AS t FROM paper),
c AS (SELECT DISTINCT candidate_id, {sql.doi('doi')} AS doi, {sql.tokens('title')} AS t FROM candidate)
SELECT item_id, candidate_id, round({sql.dice('p.t', 'c.t')}, 6) AS similarity FROM p JOIN c ON p.doi = c.doi""")
def q_title_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paper").select("item_id", ids.doi(F.col("doi")).alias("doi"), text.tokens(F.col("title")).alias("a")).distinct()
    c = table(spark, d, "candidate").select("candidate_id", ids.doi(F.col("doi")).alias("doi"), text.tokens(F.col("title")).alias("b")).distinct()
    return p.join(c, "doi").select("item_id", "candidate_id", F.round(text.dice(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""
WITH n AS (SELECT DISTINCT name_id, list_filter(string_split({sql.norm("concat_ws(' ', first_name, last_name)")}, ' '), lambda x: x <> '')[1:10] AS w FROM creator_name)
SELECT name_id, array_to_string(w[i:] || w[1:i - 1], '') AS form FROM (SELECT name_id, w, unnest(generate_series(1, len(w))) AS i FROM n)""")
def q_name_forms(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "creator_name").select("name_id", F.concat_ws(" ", "first_name", "last_name").alias("n")).distinct()
    return n.select("name_id", F.explode(text.name_forms(F.col("n"))).alias("form"))


#: Words that say nothing about a subject.
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "was", "were", "are", "has", "have", "not", "but", "its", "into", "than", "their", "our", "via")


@query(f"""
SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}]{{3,}}')) AS term FROM documents)
WHERE term NOT IN {STOP_WORDS} GROUP BY term""")
def q_terms(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{3,}"), F.lit(0))).alias("term"))
    return words.where(~F.col("term").isin(*STOP_WORDS)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH w AS (SELECT DISTINCT unnest({sql.tokens('title')}) AS w FROM journal)
SELECT a.w AS a, b.w AS b FROM w a JOIN w b ON a.w < b.w AND length(a.w) >= 5 AND length(b.w) >= 5 AND damerau_levenshtein(a.w, b.w) = 1""")
def q_typo_match(spark: SparkSession, d: str) -> DataFrame:
    """Words one edit apart, found by their common one-letter deletions (no pair of words is formed without one)."""
    w = table(spark, d, "journal").select(F.explode(text.tokens(F.col("title"))).alias("w")).distinct().where(F.length("w") >= 5)
    cuts = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substr("w", F.lit(1), i - 1), F.substr("w", i + 1)))
    keyed = w.select("w", F.explode(F.array_distinct(F.concat(F.array("w"), cuts))).alias("k"))
    pairs = keyed.select("k", F.col("w").alias("a")).join(keyed.select("k", F.col("w").alias("b")), "k").where("a < b").select("a", "b").distinct()
    return pairs.where(text.one_edit(F.col("a"), F.col("b")))


@query("""
SELECT DISTINCT id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(id, ''), lambda c: CAST(ascii(c) AS BIGINT))),
lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hash FROM paper""")
def q_fnv_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paper").select("id", text.fnv1a(F.col("id")).alias("hash")).distinct()


@query(f"""
SELECT DISTINCT item_id, {sql.year('year')} AS year, CASE WHEN {sql.year('year')} IS NOT NULL THEN 'year' ELSE 'none' END AS "precision",
coalesce({sql.year('year')} * 10000, 0) AS sort_key FROM paper""")
def q_partial_date(spark: SparkSession, d: str) -> DataFrame:
    y = ids.year(F.col("year"))
    return table(spark, d, "paper").select("item_id", y.alias("year"), F.when(y.isNotNull(), "year").otherwise("none").alias("precision"), F.coalesce(y * 10000, F.lit(0)).alias("sort_key")).distinct()


_RIS = {"journalArticle": "JOUR", "preprint": "UNPB", "bookSection": "CHAP", "conferencePaper": "CPAPER"}


@query(f"""
SELECT DISTINCT item_id, 'TY  - ' || CASE item_type WHEN 'journalArticle' THEN 'JOUR' WHEN 'preprint' THEN 'UNPB' WHEN 'bookSection' THEN 'CHAP' WHEN 'conferencePaper' THEN 'CPAPER' ELSE 'GEN' END
|| coalesce(chr(10) || 'TI  - ' || {sql.clean('title')}, '') || coalesce(chr(10) || array_to_string(list_transform(creators, lambda c: 'AU  - ' || {sql.clean("concat_ws(', ', c.last_name, c.first_name)")}), chr(10)), '')
|| coalesce(chr(10) || 'PY  - ' || CAST({sql.year('year')} AS VARCHAR), '') || coalesce(chr(10) || 'JO  - ' || {sql.clean('journal')}, '') || coalesce(chr(10) || 'DO  - ' || {sql.doi('doi')}, '')
|| chr(10) || 'ER  - ' AS ris FROM paper""")
def q_ris_export(spark: SparkSession, d: str) -> DataFrame:
    from foliograph.sources.sinks import ris

    return table(spark, d, "paper").select("item_id", ris().alias("ris")).distinct()


@query(f"""
SELECT DISTINCT item_id, CASE WHEN len(creators) > 6 THEN array_to_string(list_transform(creators[1:3] || creators[-3:], lambda c: {sql.clean('c.last_name')}), '; ')
ELSE array_to_string(list_transform(creators, lambda c: {sql.clean('c.last_name')}), '; ') END AS authors, len(creators) AS n FROM paper""")
def q_visible_authors(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("creators")
    few = F.when(F.size(c) > 6, F.concat(F.slice(c, 1, 3), F.slice(c, -3, 3))).otherwise(c)
    return table(spark, d, "paper").select("item_id", F.array_join(F.transform(few, lambda x: text.clean(x["last_name"])), "; ").alias("authors"), F.size(c).cast("bigint").alias("n")).distinct()


@query(f"""
SELECT DISTINCT item_id, concat_ws('. ', nullif({sql.clean("creators[1].last_name")}, ''), CAST({sql.year('year')} AS VARCHAR), nullif({sql.plain_title('title')}, ''), nullif({sql.clean('journal')}, '')) AS citation FROM paper""")
def q_citation_line(spark: SparkSession, d: str) -> DataFrame:
    parts = [text.clean(F.get("creators", F.lit(0))["last_name"]), ids.year(F.col("year")).cast("string"), text.plain_title(F.col("title")), text.clean(F.col("journal"))]
    return table(spark, d, "paper").select("item_id", F.concat_ws(". ", *[F.nullif(p, F.lit("")) for p in parts]).alias("citation")).distinct()


@query("""
WITH w AS (SELECT item_id, unnest(s) AS word, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT DISTINCT item_id, string_split(trim(regexp_replace(abstract, '\\s+', ' ', 'g')), ' ') AS s FROM paper WHERE length(trim(abstract)) > 0))
SELECT item_id, string_agg(word, ' ' ORDER BY pos) AS text, count(DISTINCT word) AS words FROM w GROUP BY item_id""")
def q_inverted_text(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts turned into word -> positions and back."""
    from foliograph.operators.inverted import inverted, restored

    a = table(spark, d, "paper").where(F.length(F.trim("abstract")) > 0).select("item_id", "abstract").distinct()
    index = inverted(a, "item_id", "abstract")
    return restored(index, "item_id").join(index.groupBy("item_id").agg(F.count(F.lit(1)).alias("words")), "item_id").select("item_id", "text", "words")
