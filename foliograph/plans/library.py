"""Metrics, search, change feeds, mentions and careers over the library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliograph.functions import ids, sql, text
from foliograph.operators import careers, changes, citations, metrics, search
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


_METRIC = f"""
m AS (SELECT DISTINCT metric_id, {sql.norm('journal')} AS jkey, metric_year, jif, category, quartile, source FROM metric_import),
mi AS (SELECT DISTINCT metric_id, {sql.issn('v')} AS issn FROM (SELECT metric_id, unnest(regexp_extract_all(regexp_replace(issn, '[-‐-―−]', '', 'g'), '[0-9]{{7}}[0-9Xx]')) AS v FROM metric_import) WHERE {sql.issn('v')} IS NOT NULL)"""


@query(f"""WITH {_METRIC}, p AS (SELECT issn, metric_year, category, count(DISTINCT quartile) AS quartiles, min(quartile) AS quartile, count(*) AS n, min(jif) AS lo, max(jif) AS hi FROM m JOIN mi USING (metric_id) WHERE metric_year IS NOT NULL GROUP BY 1, 2, 3)
SELECT issn, metric_year, CAST(sum(n) AS BIGINT) AS rows, min(lo) AS jif, string_agg(category || ':' || quartile, '; ' ORDER BY category || ':' || quartile) AS categories, max(quartiles) > 1 OR coalesce(min(lo) <> max(hi), false) AS conflict FROM p GROUP BY 1, 2""")
def q_metric_merge(spark: SparkSession, d: str) -> DataFrame:
    return metrics.merged(table(spark, d, "metric_import"))


@query(f"""WITH {_METRIC}, j AS (SELECT journal_id, {sql.norm('title')} AS jkey, list_filter(list_transform(issn, lambda x: {sql.issn('x')}), lambda x: x IS NOT NULL) AS issns FROM journal),
ji AS (SELECT journal_id, unnest(issns) AS issn FROM j),
h AS (SELECT DISTINCT journal_id, metric_id FROM ji JOIN mi USING (issn) UNION SELECT journal_id, metric_id FROM j JOIN m USING (jkey) WHERE len(issns) = 0 AND metric_year IS NOT NULL),
k AS (SELECT journal_id, metric_year, jif FROM h JOIN m USING (metric_id) WHERE metric_year IS NOT NULL),
t AS (SELECT journal_id, metric_year, count(*) AS hits, count(DISTINCT coalesce(jif, -1)) AS vals, min(jif) AS jif FROM k WHERE (journal_id, metric_year) IN (SELECT journal_id, max(metric_year) FROM k GROUP BY journal_id) GROUP BY 1, 2)
SELECT j.journal_id, CASE WHEN hits IS NULL THEN 'missing' WHEN vals > 1 THEN 'ambiguous' ELSE 'available' END AS status, metric_year, CASE WHEN vals = 1 THEN jif END AS jif, coalesce(hits, 0) AS hits FROM j LEFT JOIN t ON t.journal_id = j.journal_id""")
def q_metric_status(spark: SparkSession, d: str) -> DataFrame:
    return metrics.lookup(table(spark, d, "journal"), table(spark, d, "metric_import"))


@query(f"WITH {_METRIC} SELECT metric_year, count(DISTINCT metric_id) AS rows, count(DISTINCT issn) AS issns, min(quartile) AS best FROM m LEFT JOIN mi USING (metric_id) GROUP BY metric_year")
def q_metric_years(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metric_import")
    rows = metrics.metric_rows(m).join(metrics.metric_issns(m), "metric_id", "left")
    return rows.groupBy("metric_year").agg(F.countDistinct("metric_id").alias("rows"), F.countDistinct("issn").alias("issns"), F.min("quartile").alias("best"))


_TEXT = f"""s AS (SELECT DISTINCT item_id, {sql.norm('title')} AS title, {sql.norm("concat_ws(' ', title, journal, year, doi, array_to_string(list_transform(creators, lambda c: concat_ws(' ', c.first_name, c.last_name)), ' '))")} AS body FROM paper)"""
SEARCHED, MISTYPED, TERM = "lens fibres", "retinal organiods", "deconvolved"


@query(f"WITH {_TEXT} SELECT item_id FROM s WHERE contains(body, 'lens') AND contains(body, 'fibres')")
def q_token_search(spark: SparkSession, d: str) -> DataFrame:
    return search.token_search(table(spark, d, "paper"), SEARCHED)


def _ranked(q: str) -> str:
    w = q.split()
    every = lambda c: " AND ".join(f"contains({c}, '{x}')" for x in w)
    near = " AND ".join(f"len(list_filter(string_split(title, ' '), lambda x: contains(x, '{y}') OR (length(x) >= 5 AND length('{y}') >= 5 AND damerau_levenshtein(x, '{y}') = 1))) > 0" for y in w)
    squeezed = "replace(title, ' ', '')"
    return f"""WITH {_TEXT} SELECT * FROM (SELECT item_id, CASE WHEN title = '{q}' OR {squeezed} = '{''.join(w)}' THEN 100 WHEN {every('title')} THEN 85
WHEN contains({squeezed}, '{''.join(w)}') THEN 75 WHEN {every('body')} THEN 60 WHEN {near} THEN 35 END AS score, title FROM s) WHERE score IS NOT NULL ORDER BY score DESC, title, item_id LIMIT 8"""


@query(_ranked(SEARCHED))
def q_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked_search(table(spark, d, "paper"), SEARCHED)


@query(_ranked(MISTYPED))
def q_ranked_search_typo(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked_search(table(spark, d, "paper"), MISTYPED)


@query(f"""SELECT doc_id, substr(text, greatest(pos - 90, 1), pos - greatest(pos - 90, 1) + 160) AS snippet FROM (SELECT doc_id, text, instr(lower(text), '{TERM}') AS pos FROM documents) WHERE pos > 0""")
def q_fulltext_snippet(spark: SparkSession, d: str) -> DataFrame:
    return search.snippets(table(spark, d, "documents"), TERM)


@query(f"""SELECT coalesce(lang, '') AS lang, count(*) AS docs, count(*) FILTER (contains(lower(text), '{TERM}')) AS hits, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def q_fulltext_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.lower("text").contains(TERM)).alias("hits"), F.sum(F.length("text")).alias("chars")
    )


@query("SELECT DISTINCT item_id FROM paper WHERE library_id = 1 AND list_has_any(collections, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10])")
def q_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    scope = F.array(*[F.lit(i).cast("bigint") for i in range(1, 11)])
    return table(spark, d, "paper").where((F.col("library_id") == 1) & F.arrays_overlap("collections", scope)).select("item_id").distinct()


@query("""WITH RECURSIVE t AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation),
p AS (SELECT id, name AS path, 0 AS level FROM t WHERE parent IS NULL UNION ALL SELECT t.id, p.path || ' › ' || t.name, p.level + 1 FROM t JOIN p ON t.parent = p.id)
SELECT id, path, level FROM p""")
def q_collection_paths(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    return collection_paths(r.unionByName(n))


def collection_paths(tree: DataFrame, deepest: int = 64) -> DataFrame:
    """(id, path, level) of a tree given as (id, parent, name); rows on a cycle are reached from no root and left out."""
    at = tree.where("parent IS NULL").select("id", F.col("name").alias("path"), F.lit(0).alias("level"))
    out = at
    for level in range(1, deepest):
        at = tree.join(at.select(F.col("id").alias("parent"), F.col("path").alias("above")), "parent").select("id", F.concat_ws(" › ", "above", "name").alias("path"), F.lit(level).alias("level"))
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out


_DIRTY = """
c AS (SELECT DISTINCT change_id, event, type, changed_at, unnest(ids) AS id FROM library_change WHERE event IS NOT NULL AND type IN ('item', 'collection-item')),
i AS (SELECT TRY_CAST(CASE WHEN type = 'item' THEN id ELSE split_part(id, '-', -1) END AS BIGINT) AS item_id, changed_at, change_id, event = 'delete' AND type = 'item' AS gone FROM c),
dirty AS (SELECT item_id, max(changed_at) AS changed_at, last(gone ORDER BY changed_at, change_id) AS deleted FROM i WHERE item_id IS NOT NULL GROUP BY item_id)"""


@query(f"WITH {_DIRTY} SELECT * FROM dirty")
def q_dirty_items(spark: SparkSession, d: str) -> DataFrame:
    return changes.dirty_items(table(spark, d, "library_change"))


@query(f"""WITH {_DIRTY}, p AS (SELECT DISTINCT item_id, title, date_modified FROM paper)
SELECT item_id, title FROM p WHERE item_id NOT IN (SELECT item_id FROM dirty) UNION ALL SELECT p.item_id, p.title FROM p JOIN dirty ON dirty.item_id = p.item_id AND NOT deleted""")
def q_incremental_snapshot(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paper").select("item_id", "title").distinct()
    return changes.snapshot(p, p, changes.dirty_items(table(spark, d, "library_change")))


@query(f"""WITH e AS (SELECT provider, {sql.doi('doi')} AS doi, max(fetched_at) AS fetched_at FROM candidate WHERE {sql.doi('doi')} IS NOT NULL GROUP BY 1, 2)
SELECT * FROM e WHERE fetched_at + INTERVAL 30 DAY > (SELECT max(fetched_at) FROM candidate)""")
def q_ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidate").select("provider", ids.doi(F.col("doi")).alias("doi"), "fetched_at")
    return changes.fresh_entries(c.where("doi IS NOT NULL"), ["provider", "doi"], "fetched_at", 30, F.lit(c.agg(F.max("fetched_at")).first()[0]))


@query("""SELECT user_id, count(*) AS times, last(event_type ORDER BY ts, event_id) AS status, min(ts) AS added FROM events GROUP BY user_id""")
def q_queue_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("_o", F.struct("ts", "event_id"))
    return changes.queue_upsert(e, "user_id", "_o", "event_type").withColumn("added", F.col("added.ts"))


@query(r"""WITH m AS (SELECT doc_id, unnest(l) AS body, generate_subscripts(l, 1) - 1 AS mention FROM (SELECT doc_id, regexp_extract_all(text, '\[(\d{1,4}(?: ?[-–,;] ?\d{1,4})*)\]', 1) AS l FROM documents)),
p AS (SELECT doc_id, mention, unnest(string_split_regex(body, '[,;]')) AS p FROM m),
e AS (SELECT doc_id, mention, CAST(trim(string_split_regex(p, '[-–]')[1]) AS INTEGER) AS lo, CAST(trim(string_split_regex(p, '[-–]')[-1]) AS INTEGER) AS hi FROM p)
SELECT DISTINCT doc_id, CAST(mention AS INTEGER) AS mention, CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS number FROM e WHERE lo >= 1 AND hi >= lo AND hi <= 9999 AND hi - lo <= 100""")
def q_mention_ranges(spark: SparkSession, d: str) -> DataFrame:
    return citations.numeric_mentions(table(spark, d, "documents"))


def _sql_lead(x: str) -> str:
    return f"substr(list_max(list_transform(list_filter(string_split({sql.norm(x)}, ' '), lambda w: w <> ''), lambda w: lpad(CAST(length(w) AS VARCHAR), 3, '0') || w)), 4)"


_AY = r"(\p{Lu}[\p{L}’''-]+)(?: et al\.?| (?:and|und|et|y|&) \p{Lu}[\p{L}’''-]+)?,? \(?((?:1[5-9]|20)\d{2})"


@query(f"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_AY}', 0)) AS m FROM documents),
a AS (SELECT doc_id, {sql.norm("regexp_extract(m, '^(" + chr(92) + "p{Lu}[" + chr(92) + "p{L}’''-]+)', 1)")} AS author, CAST(right(m, 4) AS INTEGER) AS year FROM f),
g AS (SELECT DISTINCT doc_id, author, year FROM a),
p AS (SELECT DISTINCT item_id, {_sql_lead('creators[1].last_name')} AS author, {sql.year('year')} AS year FROM paper),
n AS (SELECT author, year, count(*) AS hits FROM p WHERE author IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, g.author, g.year, CASE WHEN hits = 1 THEN 'matched' WHEN hits > 1 THEN 'ambiguous' ELSE 'missing' END AS status, coalesce(hits, 0) AS hits FROM g LEFT JOIN n USING (author, year)""")
def q_mention_resolve(spark: SparkSession, d: str) -> DataFrame:
    return citations.resolve_mentions(table(spark, d, "documents"), table(spark, d, "paper"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, regexp_replace({sql.norm('line')}, '[0-9]+', '0', 'g') AS line FROM l)
SELECT line, count(DISTINCT doc_id) AS docs FROM k WHERE length(line) BETWEEN 4 AND 80 GROUP BY line HAVING count(DISTINCT doc_id) >= 2""")
def q_reference_headers(spark: SparkSession, d: str) -> DataFrame:
    return citations.repeated_lines(table(spark, d, "documents"))


_WORKS = f"""w AS (SELECT {sql.orcid('o')} AS orcid, identity, year, journal FROM (SELECT unnest(creators).orcid AS o, {sql.identity('doi', 'title', 'year')} AS identity, {sql.year('year')} AS year, {sql.clean('journal')} AS journal FROM paper)),
works AS (SELECT orcid, identity, max(year) AS year, max(journal) AS journal, count(*) AS copies FROM w WHERE orcid IS NOT NULL AND identity IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {_WORKS} SELECT * FROM works")
def q_career_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return careers.works_by_orcid(table(spark, d, "paper"))


@query(f"WITH {_WORKS} SELECT orcid, coalesce(year, 0) AS year, count(*) AS works, count(DISTINCT journal) AS journals FROM works GROUP BY 1, 2")
def q_career_timeline(spark: SparkSession, d: str) -> DataFrame:
    return careers.timeline(table(spark, d, "paper"))


@query(f"""WITH c AS (SELECT c.name_id AS name_id, {sql.orcid('c.orcid')} AS orcid FROM (SELECT unnest(creators) AS c FROM paper) WHERE c.name_id IS NOT NULL)
SELECT name_id, CASE count(DISTINCT orcid) WHEN 1 THEN 'available' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT orcid) = 1 THEN min(orcid) END AS orcid FROM c GROUP BY name_id""")
def q_author_orcid_status(spark: SparkSession, d: str) -> DataFrame:
    return careers.orcid_status(table(spark, d, "paper"))


@query(f"""SELECT item_id, CAST(row_number() OVER (PARTITION BY library_id ORDER BY year DESC NULLS LAST, title NULLS LAST, item_id) AS INTEGER) AS rank FROM (SELECT DISTINCT item_id, library_id, {sql.year('year')} AS year, {sql.norm('title')} AS title FROM paper)""")
def q_paper_sort(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paper").select("item_id", "library_id", ids.year(F.col("year")).alias("year"), text.norm(F.col("title")).alias("title")).distinct()
    w = W.partitionBy("library_id").orderBy(F.desc_nulls_last("year"), F.asc_nulls_last("title"), "item_id")
    return p.select("item_id", F.row_number().over(w).alias("rank"))


@query("""WITH s AS (SELECT item_id, text, CASE source WHEN 'abstract' THEN 1 WHEN 'review' THEN 2 WHEN 'note' THEN 3 WHEN 'fulltext' THEN 4 ELSE 5 END AS p, doc_id FROM documents WHERE item_id IS NOT NULL AND length(text) > 0),
b AS (SELECT item_id, first(text ORDER BY p, doc_id) AS text FROM s GROUP BY item_id)
SELECT q.item_id, coalesce(nullif(abstract, ''), b.text) AS abstract, CASE WHEN nullif(abstract, '') IS NOT NULL THEN 'own' WHEN b.text IS NOT NULL THEN 'document' ELSE 'none' END AS origin
FROM (SELECT DISTINCT item_id, abstract FROM paper) q LEFT JOIN b USING (item_id)""")
def q_abstract_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A paper's own abstract, else the first of its documents by kind of source (a total order, so runs agree)."""
    order = F.lit(5)
    for i, s in enumerate(("fulltext", "note", "review", "abstract")):
        order = F.when(F.col("source") == s, 4 - i).otherwise(order)
    docs = table(spark, d, "documents").where(F.col("item_id").isNotNull() & (F.length("text") > 0))
    best = docs.groupBy("item_id").agg(F.min_by("text", F.struct(order, "doc_id")).alias("text"))
    own = F.nullif("abstract", F.lit(""))
    return table(spark, d, "paper").select("item_id", "abstract").distinct().join(best, "item_id", "left").select(
        "item_id", F.coalesce(own, "text").alias("abstract"), F.when(own.isNotNull(), "own").when(F.col("text").isNotNull(), "document").otherwise("none").alias("origin")
    )


@query(f"""WITH k AS (SELECT DISTINCT item_id, library_id, {sql.identity('doi', 'title', 'year')} AS identity, collections, attachments, related_keys FROM paper)
SELECT library_id, identity, count(*) AS copies, min(item_id) AS item_id, CAST(sum(len(collections)) AS BIGINT) AS collections, CAST(sum(len(attachments)) AS BIGINT) AS attachments FROM k WHERE identity IS NOT NULL GROUP BY 1, 2""")
def q_consolidate_copies(spark: SparkSession, d: str) -> DataFrame:
    """Copies of a work within one library as one row, what hangs on them counted together."""
    p = table(spark, d, "paper").select("item_id", "library_id", ids.identity(F.col("doi"), F.col("title"), F.col("year")).alias("identity"), "collections", "attachments", "related_keys").distinct()
    return p.where("identity IS NOT NULL").groupBy("library_id", "identity").agg(
        F.count(F.lit(1)).alias("copies"), F.min("item_id").alias("item_id"), F.sum(F.size("collections")).alias("collections"), F.sum(F.size("attachments")).alias("attachments")
    )


@query(f"""WITH k AS (SELECT DISTINCT item_id, library_id, {sql.identity('doi', 'title', 'year')} AS identity FROM paper), n AS (SELECT identity, count(*) AS items, count(DISTINCT library_id) AS libraries FROM k WHERE identity IS NOT NULL GROUP BY identity)
SELECT candidate_id, coalesce(items, 0) AS items, coalesce(libraries, 0) AS libraries FROM (SELECT DISTINCT candidate_id, {sql.identity('doi', 'title', 'year')} AS identity FROM candidate) LEFT JOIN n USING (identity)""")
def q_existing_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Of each candidate, how many items in how many libraries are it already."""
    key = ids.identity(F.col("doi"), F.col("title"), F.col("year")).alias("identity")
    n = table(spark, d, "paper").select("item_id", "library_id", key).distinct().where("identity IS NOT NULL").groupBy("identity").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("library_id").alias("libraries"))
    return table(spark, d, "candidate").select("candidate_id", key).distinct().join(n, "identity", "left").select("candidate_id", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("libraries", F.lit(0)).alias("libraries"))
