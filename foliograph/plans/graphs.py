"""Linking and graph queries over the library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import sql
from foliograph.operators import graph, linking
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


def _lead(x: str) -> str:
    return f"substr(list_max(list_transform(list_filter(string_split({sql.norm(x)}, ' '), lambda w: w <> ''), lambda w: lpad(CAST(length(w) AS VARCHAR), 3, '0') || w)), 4)"


_LINKS = f"""
p AS (SELECT DISTINCT item_id, id, library_id, {sql.doi('doi')} AS doi, {sql.norm('title')} AS tkey, {sql.year('year')} AS year, {_lead('creators[1].last_name')} AS lead FROM paper),
r AS (SELECT DISTINCT ref_id, source, {sql.doi('doi')} AS doi, {sql.norm('title')} AS tkey, {sql.year('year')} AS year, {_lead('author')} AS lead FROM reference_item),
hits AS (SELECT r.ref_id, r.source, p.item_id, p.id, p.library_id FROM r JOIN p ON r.doi = p.doi
 UNION ALL SELECT r.ref_id, r.source, p.item_id, p.id, p.library_id FROM r JOIN p ON r.doi IS NULL AND length(r.tkey) >= 20 AND r.tkey = p.tkey AND r.year = p.year AND r.lead = p.lead),
own AS (SELECT *, CAST(library_id AS VARCHAR) = split_part(source, ':', 1) AS own FROM hits WHERE id <> source),
f AS (SELECT ref_id, bool_or(own) AS near, count(*) AS every, count(*) FILTER (own) AS same, min(item_id) FILTER (own) AS near_item, min(item_id) AS any_item FROM own GROUP BY ref_id),
links AS (SELECT r.ref_id, r.source, CAST(CASE WHEN near THEN same ELSE coalesce(every, 0) END AS BIGINT) AS hits, CASE WHEN near THEN near_item ELSE any_item END AS item FROM r LEFT JOIN f USING (ref_id)),
linked AS (SELECT ref_id, source, CASE WHEN hits = 1 THEN 'matched' WHEN hits > 1 THEN 'ambiguous' ELSE 'missing' END AS status, hits, CASE WHEN hits = 1 THEN item END AS item_id FROM links)"""


@query(f"WITH {_LINKS} SELECT * FROM linked")
def q_citation_link_status(spark: SparkSession, d: str) -> DataFrame:
    return linking.link_references(table(spark, d, "reference_item"), table(spark, d, "paper"))


@query(f"WITH {_LINKS} SELECT source, count(*) AS refs, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'missing') AS missing FROM linked GROUP BY source")
def q_citation_coverage(spark: SparkSession, d: str) -> DataFrame:
    r = q_citation_link_status(spark, d)
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("refs"), *[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "ambiguous", "missing")])


_RELATED = """
rp AS (SELECT DISTINCT item_id, id, library_id, related_keys FROM paper),
rk AS (SELECT item_id, library_id, unnest(related_keys) AS k FROM rp),
related AS (SELECT DISTINCT least(rk.item_id, rp.item_id) AS a, greatest(rk.item_id, rp.item_id) AS b FROM rk JOIN rp ON rp.id = CASE WHEN contains(k, ':') THEN k ELSE CAST(rk.library_id AS VARCHAR) || ':' || k END WHERE rk.item_id <> rp.item_id)"""


@query(f"WITH {_RELATED} SELECT * FROM related")
def q_related_edges(spark: SparkSession, d: str) -> DataFrame:
    return linking.related_edges(table(spark, d, "paper"))


_EDGES = """
x AS (SELECT DISTINCT item_id, c.name_id AS author FROM (SELECT item_id, unnest(creators) AS c FROM paper) WHERE c.name_id IS NOT NULL),
t AS (SELECT item_id, count(*) AS team FROM x GROUP BY item_id),
edges AS (SELECT a.author AS a, b.author AS b, round(sum(1.0 / greatest(team - 1, 1)), 6) AS strength, count(*) AS papers FROM x a JOIN x b ON a.item_id = b.item_id AND a.author < b.author JOIN t ON t.item_id = a.item_id GROUP BY 1, 2),
two AS (SELECT a, b, strength, papers FROM edges UNION ALL SELECT b, a, strength, papers FROM edges),
busiest AS (SELECT author FROM (SELECT author, count(*) AS n FROM x GROUP BY author) ORDER BY n DESC, author LIMIT 1)"""


@query(f"WITH {_EDGES} SELECT a, b, CAST(strength AS DOUBLE) AS strength, papers FROM edges")
def q_coauthor_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.coauthor_edges(table(spark, d, "paper"))


@query(f"WITH {_EDGES} SELECT * FROM (SELECT a, b, CAST(strength AS DOUBLE) AS strength, papers, CAST(row_number() OVER (PARTITION BY a ORDER BY strength DESC, papers DESC, b) AS INTEGER) AS rank FROM two) WHERE rank <= 12")
def q_coauthor_top12(spark: SparkSession, d: str) -> DataFrame:
    return graph.strongest(graph.coauthor_edges(table(spark, d, "paper")))


@query("""
WITH p AS (SELECT DISTINCT item_id, title, local, c.name_id AS author FROM (SELECT item_id, title, local, unnest(creators) AS c FROM paper) WHERE c.name_id IS NOT NULL)
SELECT author, count(DISTINCT item_id) AS papers, bool_or(local) AS any_local, first(title ORDER BY length(title) DESC, title) AS title FROM p GROUP BY author""")
def q_author_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.author_nodes(table(spark, d, "paper"))


@query(f"WITH {_EDGES} SELECT b AS author, 1 AS depth, papers AS evidence FROM two JOIN busiest ON a = author ORDER BY papers DESC, b LIMIT 600")
def q_author_neighborhood_1(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paper")
    return graph.neighbourhood(graph.coauthor_edges(p), graph.busiest_author(p), 1)


@query(f"""WITH {_EDGES}, one AS (SELECT b AS author, papers AS evidence FROM two JOIN busiest ON a = author),
far AS (SELECT b AS author, CAST(sum(papers) AS BIGINT) AS evidence FROM two WHERE a IN (SELECT author FROM one) GROUP BY b)
SELECT * FROM (SELECT author, 1 AS depth, evidence FROM one UNION ALL SELECT author, 2, evidence FROM far WHERE author NOT IN (SELECT author FROM one) AND author NOT IN (SELECT author FROM busiest))
ORDER BY depth, evidence DESC, author LIMIT 600""")
def q_author_neighborhood_2(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paper")
    return graph.neighbourhood(graph.coauthor_edges(p), graph.busiest_author(p), 2)


@query(f"""WITH {_EDGES} SELECT a.author AS author, count(*) AS papers, min(x.item_id) AS first_item FROM x JOIN busiest USING (author) JOIN x a ON a.item_id = x.item_id AND a.author <> x.author GROUP BY 1""")
def q_author_links(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paper")
    x = graph.authorship(p).select("item_id", "author")
    own = x.join(F.broadcast(graph.busiest_author(p)), "author").select("item_id", F.col("author").alias("self"))
    return x.join(own, "item_id").where("author <> self").groupBy("author").agg(F.count(F.lit(1)).alias("papers"), F.min("item_id").alias("first_item"))


@query(f"""WITH r AS (SELECT DISTINCT source, {sql.identity('doi', 'title', 'year')} AS k FROM reference_item), u AS (SELECT * FROM r WHERE k IS NOT NULL),
top AS (SELECT source AS s FROM (SELECT source, count(*) AS n FROM u GROUP BY source) ORDER BY n DESC, source LIMIT 1)
SELECT u.source, count(*) AS shared, min(u.k) AS first_key FROM u JOIN u o ON o.k = u.k JOIN top ON o.source = top.s WHERE u.source <> top.s GROUP BY u.source""")
def q_bibliographic_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Papers that share references with the paper of most references."""
    from foliograph.functions import ids

    u = table(spark, d, "reference_item").select("source", ids.identity(F.col("doi"), F.col("title"), F.col("year")).alias("k")).where("k IS NOT NULL").distinct()
    top = u.groupBy("source").count().orderBy(F.col("count").desc(), "source").limit(1).select(F.col("source").alias("s"))
    own = u.join(F.broadcast(top), u["source"] == top["s"]).select("k", "s")
    return u.join(own, "k").where("source <> s").groupBy("source").agg(F.count(F.lit(1)).alias("shared"), F.min("k").alias("first_key"))


@query("""WITH m AS (SELECT DISTINCT item_id, unnest(collections) AS g FROM paper), s AS (SELECT g, count(*) AS n FROM m GROUP BY g),
p AS (SELECT a.g AS a, b.g AS b, count(*) AS papers FROM m a JOIN m b ON a.item_id = b.item_id AND a.g < b.g GROUP BY 1, 2)
SELECT a, b, papers, round(1 - exp(-0.45 * log2(1 + papers) - 0.55 * papers / sqrt(sa.n * sb.n)), 6) AS affinity FROM p JOIN s sa ON sa.g = a JOIN s sb ON sb.g = b""")
def q_publication_relations(spark: SparkSession, d: str) -> DataFrame:
    return graph.group_relations(table(spark, d, "paper").select(F.explode("collections").alias("group"), "item_id"))


@query(f"""WITH {_LINKS}, j AS (SELECT DISTINCT item_id, id, journal_id FROM paper),
e AS (SELECT s.journal_id AS ga, t.journal_id AS gb, count(*) AS weight FROM linked l JOIN j s ON s.id = l.source JOIN j t ON t.item_id = l.item_id WHERE s.journal_id IS NOT NULL AND t.journal_id IS NOT NULL GROUP BY 1, 2),
v AS (SELECT g, sum(weight) AS v FROM (SELECT ga AS g, weight FROM e UNION ALL SELECT gb, weight FROM e) GROUP BY g),
c AS (SELECT least(ga, gb) AS a, greatest(ga, gb) AS b, sum(weight) AS weight FROM e WHERE ga <> gb GROUP BY 1, 2),
k AS (SELECT a, b, CAST(weight AS BIGINT) AS weight, 1 - exp(-6 * sqrt(weight / va.v * (weight / vb.v))) AS f FROM c JOIN v va ON va.g = a JOIN v vb ON vb.g = b)
SELECT a, b, weight, round(f, 6) AS affinity, round(48 + 250 * (1 - f) * (1 - f), 4) AS gap FROM k""")
def q_community_relations(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paper").select("item_id", "id", "journal_id").distinct()
    links = q_citation_link_status(spark, d).where("item_id IS NOT NULL").select("source", "item_id")
    links = links.join(p.select(F.col("id").alias("source"), F.col("journal_id").alias("ga")), "source").join(p.select("item_id", F.col("journal_id").alias("gb")), "item_id")
    return graph.link_relations(links.where("ga IS NOT NULL AND gb IS NOT NULL").groupBy("ga", "gb").agg(F.count(F.lit(1)).alias("weight")))


_CITES = f"""{_LINKS}, {_RELATED}, {_EDGES}, ids AS (SELECT DISTINCT item_id, id FROM paper),
cites AS (SELECT DISTINCT i.item_id AS a, l.item_id AS b FROM linked l JOIN ids i ON i.id = l.source WHERE l.item_id IS NOT NULL)"""


def _cites(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paper").select(F.col("item_id").alias("a"), F.col("id").alias("source")).distinct()
    return q_citation_link_status(spark, d).where("item_id IS NOT NULL").join(p, "source").select("a", F.col("item_id").alias("b")).distinct()


@query(f"""WITH {_CITES}, centre AS (SELECT a AS c FROM (SELECT a, count(*) AS n FROM cites GROUP BY a) ORDER BY n DESC, a LIMIT 1),
near AS (SELECT b AS item_id, 100 AS w FROM cites JOIN centre ON a = c UNION ALL SELECT a, 100 FROM cites JOIN centre ON b = c UNION ALL SELECT b, 50 FROM related JOIN centre ON a = c UNION ALL SELECT a, 50 FROM related JOIN centre ON b = c
 UNION ALL SELECT o.item_id, 1 FROM x JOIN centre ON x.item_id = c JOIN x o ON o.author = x.author AND o.item_id <> c)
SELECT item_id, CAST(sum(w) AS BIGINT) AS weight, title FROM near JOIN (SELECT DISTINCT item_id, title FROM paper) USING (item_id) GROUP BY item_id, title""")
def q_neighbors_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the paper that cites most: citations count 100, related items 50, each common author 1."""
    p = table(spark, d, "paper")
    cites = _cites(spark, d)
    centre = cites.groupBy("a").count().orderBy(F.col("count").desc(), "a").limit(1).select(F.col("a").alias("c"))
    centre = F.broadcast(centre)
    related = linking.related_edges(p)
    x = graph.authorship(p).select("item_id", "author")
    near = [e.join(centre, F.col(one) == F.col("c")).select(F.col(other).alias("item_id"), F.lit(w).alias("w")) for e, w in ((cites, 100), (related, 50)) for one, other in (("a", "b"), ("b", "a"))]
    own = x.join(centre, F.col("item_id") == F.col("c")).select("author", "c")
    near.append(x.join(own, "author").where("item_id <> c").select("item_id", F.lit(1).alias("w")))
    every = near[0]
    for n in near[1:]:
        every = every.unionByName(n)
    return every.groupBy("item_id").agg(F.sum("w").alias("weight")).join(p.select("item_id", "title").distinct(), "item_id")


@query(f"""WITH RECURSIVE {_RELATED}, two AS (SELECT a, b FROM related UNION SELECT b, a FROM related),
reach AS (SELECT a, b FROM two UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a)
SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a""")
def q_connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(linking.related_edges(table(spark, d, "paper")))


@query(f"WITH {_CITES}, e AS (SELECT a, b FROM cites UNION ALL SELECT b, a FROM cites) SELECT a AS node, count(DISTINCT b) AS degree, count(*) AS signals FROM e GROUP BY a")
def q_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_cites(spark, d).withColumn("n", F.lit(1)))


@query()
def q_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(graph.coauthor_edges(table(spark, d, "paper")).withColumnRenamed("strength", "weight"))


@query()
def q_communities_incremental(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.coauthor_edges(table(spark, d, "paper")).withColumnRenamed("strength", "weight")
    from foliograph.session import cut

    before = cut(graph.communities(edges))
    return graph.communities_incremental(edges, edges, before)


def _judged() -> str:
    return f"""
p AS (SELECT DISTINCT item_id, {sql.doi('doi')} AS doi, {sql.norm('title')} AS tkey, {sql.tokens('title')} AS words, {sql.year('year')} AS year, {_lead('creators[1].last_name')} AS lead FROM paper),
c AS (SELECT DISTINCT candidate_id, {sql.doi('doi')} AS cdoi, {sql.norm('title')} AS ckey, {sql.tokens('title')} AS cwords, {sql.year('year')} AS cyear, {_lead('author')} AS clead FROM candidate),
j AS (SELECT *, {sql.dice('words', 'cwords')} AS lk, coalesce(lead = clead, false) AS a, coalesce(year = cyear, false) AS y, coalesce(doi = cdoi, false) AS exact FROM p JOIN c ON doi = cdoi
 UNION SELECT *, {sql.dice('words', 'cwords')} AS lk, coalesce(lead = clead, false) AS a, coalesce(year = cyear, false) AS y, coalesce(doi = cdoi, false) AS exact FROM p JOIN c ON tkey = ckey AND length(tkey) >= 20),
g AS (SELECT *, round(CASE WHEN exact THEN 1.0 ELSE 0.7 * lk + 0.18 * CAST(a AS INT) + 0.12 * CAST(y AS INT) END, 6) AS score FROM j
 WHERE NOT (coalesce(doi <> cdoi, false) OR (length(tkey) >= 10 AND length(ckey) >= 10 AND lk < 0.52) OR coalesce(abs(year - cyear) > 1, false) OR coalesce(lead <> clead, false))),
k AS (SELECT *, row_number() OVER w AS rank, coalesce(lead(score) OVER w, 0.0) AS nxt FROM g WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, candidate_id)),
judged AS (SELECT item_id, candidate_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank, CASE WHEN rank = 1 AND ((exact AND (year IS NULL OR cyear IS NULL OR y)) OR (doi IS NULL AND score >= 0.93 AND score - nxt >= 0.12 AND y AND a)) THEN 'matched' ELSE 'review' END AS status FROM k)"""


@query(f"WITH {_judged()} SELECT * FROM judged")
def q_rank_decide(spark: SparkSession, d: str) -> DataFrame:
    return linking.judge_candidates(table(spark, d, "paper"), table(spark, d, "candidate"))


@query(f"""WITH {_judged()}, o AS (SELECT DISTINCT item_id, {sql.doi('doi')} AS doi, {sql.year('year')} AS year, {sql.clean('journal')} AS journal FROM paper),
n AS (SELECT DISTINCT candidate_id, {sql.doi('doi')} AS cdoi, {sql.year('year')} AS cyear, {sql.clean('journal')} AS cjournal FROM candidate),
w AS (SELECT item_id, n.* FROM judged JOIN n USING (candidate_id) WHERE status = 'matched')
SELECT item_id, coalesce(o.doi, cdoi) AS doi, coalesce(o.year, cyear) AS year, coalesce(nullif(journal, ''), cjournal) AS journal FROM o LEFT JOIN w USING (item_id)""")
def q_fill_missing(spark: SparkSession, d: str) -> DataFrame:
    return linking.fill_missing(table(spark, d, "paper"), table(spark, d, "candidate"))


@query(f"""WITH r AS (SELECT DISTINCT ref_id, source, raw, extractor, coalesce({sql.identity('doi', 'title', 'year')}, 'raw:' || {sql.norm('raw')}) AS identity FROM reference_item)
SELECT source, identity, first(ref_id ORDER BY length(raw) DESC, ref_id) AS ref_id, count(DISTINCT extractor) AS extractors, count(*) AS rows FROM r GROUP BY source, identity""")
def q_reference_union(spark: SparkSession, d: str) -> DataFrame:
    return linking.union_references(table(spark, d, "reference_item"))
