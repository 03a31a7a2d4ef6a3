"""Queries over records, their sources, members and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import sql
from foliograph.operators import citations, records
from foliograph.plans import library
from foliograph.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return register


@query(f"""SELECT DISTINCT ref_id FROM reference_item WHERE contains({sql.norm("concat_ws(' ', raw, doi)")}, 'retina')""")
def q_list_search(spark: SparkSession, d: str) -> DataFrame:
    return records.list_search(table(spark, d, "reference_item"), " Rétina ", "raw", "doi").select("ref_id").distinct()


@query("""WITH h AS (SELECT DISTINCT source, a.id AS i, a.key AS k FROM (SELECT id AS source, unnest(attachments) AS a FROM paper))
SELECT DISTINCT r.ref_id FROM reference_item r JOIN h ON r.source = h.source AND r.attachment_id = h.i AND r.attachment_key = h.k""")
def q_valid_sources(spark: SparkSession, d: str) -> DataFrame:
    return records.valid_sources(table(spark, d, "reference_item"), table(spark, d, "paper")).select("ref_id").distinct()


@query("""WITH p AS (SELECT DISTINCT id, library_id, related_keys FROM paper), e AS (SELECT DISTINCT id AS a, library_id || ':' || k AS b FROM (SELECT id, library_id, unnest(related_keys) AS k FROM p)),
s AS (SELECT id FROM p WHERE library_id = 1) SELECT a, b FROM e WHERE a IN (SELECT id FROM s) AND b IN (SELECT id FROM s)""")
def q_edges_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Related items of which both lie in one library, the scope a user opened."""
    p = table(spark, d, "paper").select("id", "library_id", "related_keys").distinct()
    edges = p.select(F.col("id").alias("a"), "library_id", F.explode("related_keys").alias("k")).select("a", F.concat_ws(":", "library_id", "k").alias("b")).distinct()
    return records.in_scope(edges, p.where("library_id = 1").select(F.col("id").alias("node")))


@query("""SELECT DISTINCT line_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(line, '(?i)\\b(q[1-4])\\b', 1), lambda q: upper(q)))), ',') AS quartiles FROM metric_line WHERE line IS NOT NULL""")
def q_quartiles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "metric_line").where("line IS NOT NULL")
    return t.select("line_id", F.array_join(F.array_sort(records.quartiles(F.col("line"))), ",").alias("quartiles")).distinct()


@query("""SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?i)\\bPMID:? ?([1-9][0-9]{0,8})\\b', 1)) AS pmid FROM documents""")
def q_pmids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(records.pmids(F.col("text"))).alias("pmid")).distinct()


_KEYED = f"""WITH c AS (SELECT DISTINCT item_id, {sql.doi('doi')} AS d, pos, c.name_id AS name_id, {sql.orcid('c.orcid')} AS orcid,
concat_ws('|', {sql.norm('c.last_name')}, left({sql.norm('c.first_name')}, 1)) AS k
FROM (SELECT item_id, doi, creators[pos] AS c, pos FROM (SELECT item_id, doi, creators, unnest(generate_series(1, len(creators))) AS pos FROM paper))),
a AS (SELECT item_id, d, k, min(name_id) AS name_id, min(orcid) AS orcid FROM c WHERE d IS NOT NULL AND k <> '' GROUP BY 1, 2, 3 HAVING count(*) = 1),
g AS (SELECT d, k, min(orcid) AS orcid FROM a WHERE orcid IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT orcid) = 1)
SELECT name_id, min(g.orcid) AS orcid FROM a JOIN g USING (d, k) WHERE a.orcid IS NULL AND name_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT g.orcid) = 1"""


@query(_KEYED)
def q_creator_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return records.enrich_creators(table(spark, d, "paper"))


_AUTHOR = f"CASE WHEN regexp_matches(c.first_name, '\\p{{Ll}}{{2}}|\\p{{Han}}') AND c.last_name IS NOT NULL THEN concat_ws(' ', {sql.norm('c.last_name')}, {sql.norm('c.first_name')}) END"


@query(f"""WITH p AS (SELECT DISTINCT item_id, {sql.year('year')} AS y, {_AUTHOR} AS author FROM (SELECT item_id, year, unnest(creators) AS c FROM paper))
SELECT author, item_id, CAST(row_number() OVER (PARTITION BY author ORDER BY y DESC NULLS LAST, item_id) AS INTEGER) AS rank FROM p WHERE author IS NOT NULL QUALIFY rank <= 120""")
def q_expand_members(spark: SparkSession, d: str) -> DataFrame:
    return records.expand_members(table(spark, d, "paper"))


@query(f"""WITH m AS (SELECT k, count(*) AS hits FROM (SELECT DISTINCT metric_id, {sql.norm('journal')} AS k FROM metric_import) WHERE k <> '' GROUP BY 1)
SELECT journal_id, coalesce(hits, 0) AS hits, CASE WHEN hits IS NULL THEN 'missing' WHEN hits > 500 THEN 'ambiguous' ELSE 'available' END AS status
FROM (SELECT journal_id, {sql.norm('title')} AS k FROM journal) LEFT JOIN m USING (k)""")
def q_metric_search(spark: SparkSession, d: str) -> DataFrame:
    return records.metric_search(table(spark, d, "journal"), table(spark, d, "metric_import"))


@query("""SELECT candidate_id, fetched_at FROM (SELECT DISTINCT candidate_id, fetched_at FROM candidate) ORDER BY fetched_at DESC NULLS LAST, candidate_id LIMIT 5000""")
def q_newest_cached(spark: SparkSession, d: str) -> DataFrame:
    """What a cache of 5,000 entries keeps: the newest, a top-k of each partition merged."""
    return table(spark, d, "candidate").select("candidate_id", "fetched_at").distinct().orderBy(F.col("fetched_at").desc_nulls_last(), "candidate_id").limit(5000)


@query(f"""WITH r AS ({library.ORACLE['q_mention_resolve']})
SELECT doc_id, count(*) AS expected, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status <> 'matched') AS unresolved,
CASE WHEN count(*) FILTER (status <> 'matched') = 0 THEN 'complete' WHEN count(*) FILTER (status = 'matched') = 0 THEN 'none' ELSE 'partial' END AS status FROM r GROUP BY doc_id""")
def q_mention_audit(spark: SparkSession, d: str) -> DataFrame:
    return citations.audit(library.q_mention_resolve(spark, d))
