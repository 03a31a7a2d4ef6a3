"""Author identities, parsed references, validators, interval joins over the library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import ids, sql, text
from foliograph.operators import citations, identity, places, references
from foliograph.session import table
from foliograph.streaming.feeds import arrivals

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


@query()
def q_author_identity(spark: SparkSession, d: str) -> DataFrame:
    return identity.author_identities(table(spark, d, "paper"))


@query()
def q_parse_references(spark: SparkSession, d: str) -> DataFrame:
    r = references.parse_references(table(spark, d, "reference_item"))
    return r.select("ref_id", "number", F.array_join("authors", "; ").alias("authors"), "year", "title", "journal", "volume", "pages", "doi", "type")


@query(f"""SELECT DISTINCT name_id, CASE WHEN regexp_matches(first_name, '\\p{{Ll}}{{2}}|\\p{{Han}}') AND last_name IS NOT NULL THEN concat_ws(' ', {sql.norm('last_name')}, {sql.norm('first_name')}) END AS author_key FROM creator_name""")
def q_author_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "creator_name").select("name_id", ids.author_key(F.col("first_name"), F.col("last_name")).alias("author_key")).distinct()


@query("""SELECT DISTINCT candidate_id, TRY_CAST(nullif(regexp_extract(pages, '^\\s*(\\d+)', 1), '') AS INTEGER) AS first_page, TRY_CAST(nullif(regexp_extract(pages, '[-–](\\d+)\\s*$', 1), '') AS INTEGER) AS last_page FROM candidate""")
def q_locator(spark: SparkSession, d: str) -> DataFrame:
    page = lambda p: F.regexp_extract("pages", p, 1).try_cast("int")
    return table(spark, d, "candidate").select("candidate_id", page(r"^\s*(\d+)").alias("first_page"), page(r"[-–](\d+)\s*$").alias("last_page")).distinct()


@query(f"""SELECT DISTINCT item_id, CASE item_type WHEN 'bookSection' THEN 'In: ' || coalesce({sql.clean('journal')}, '?') WHEN 'preprint' THEN 'Preprint' WHEN 'conferencePaper' THEN 'Proceedings: ' || coalesce({sql.clean('journal')}, '?') ELSE coalesce({sql.clean('journal')}, '') END
|| coalesce(' (' || CAST({sql.year('year')} AS VARCHAR) || ')', '') AS line FROM paper""")
def q_publication_line(spark: SparkSession, d: str) -> DataFrame:
    journal, y = text.clean(F.col("journal")), ids.year(F.col("year")).cast("string")
    known = F.coalesce(journal, F.lit("?"))
    line = (
        F.when(F.col("item_type") == "bookSection", F.concat(F.lit("In: "), known)).when(F.col("item_type") == "preprint", F.lit("Preprint"))
        .when(F.col("item_type") == "conferencePaper", F.concat(F.lit("Proceedings: "), known)).otherwise(F.coalesce(journal, F.lit("")))
    )
    return table(spark, d, "paper").select("item_id", F.concat(line, F.coalesce(F.concat(F.lit(" ("), y, F.lit(")")), F.lit(""))).alias("line")).distinct()


@query("""WITH m AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '\\[\\d{1,4}[-–]\\d{1,4}\\]', 0)) AS m FROM documents),
s AS (SELECT DISTINCT doc_id, instr(text, m) AS start, instr(text, m) + length(m) AS "end" FROM m),
p AS (SELECT doc_id, unnest(generate_series(1, length(text), 500)) AS "at" FROM documents)
SELECT s.doc_id, CAST("at" AS INTEGER) AS "at", CAST(start AS INTEGER) AS start FROM p JOIN s ON s.doc_id = p.doc_id AND "at" >= start AND "at" < "end" """)
def q_interval_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every 500th character of each text that lies in a numeric mention."""
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    m = docs.select("doc_id", "text", F.explode(F.regexp_extract_all("text", F.lit(r"\[\d{1,4}[-–]\d{1,4}\]"), F.lit(0))).alias("m"))
    spans = m.select("doc_id", F.expr("instr(text, m)").alias("start"), F.expr("instr(text, m) + length(m)").alias("end")).distinct()
    points = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.length("text"), F.lit(500))).alias("at"))
    return places.within(points, spans, "doc_id").select("doc_id", "at", "start")


@query("""WITH c AS (SELECT DISTINCT change_id, event, type, changed_at FROM library_change WHERE event IS NOT NULL)
SELECT date_trunc('day', changed_at) AS day, type, count(*) AS changes FROM c GROUP BY 1, 2""")
def q_change_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return arrivals(table(spark, d, "library_change"))


@query("""WITH f AS (SELECT DISTINCT regexp_extract(file_name, '^[^_]+_(\\d+)', 1) AS a, regexp_extract(file_name, '_(\\d+)\\.', 1) AS b, file_name FROM metric_line)
SELECT file_name, CAST(rank() OVER (ORDER BY TRY_CAST(a AS INTEGER), TRY_CAST(b AS INTEGER)) AS INTEGER) AS rank FROM f""")
def q_version_order(spark: SparkSession, d: str) -> DataFrame:
    """Files in the order of the numbers in their names, compared as numbers."""
    from pyspark.sql import Window as W

    f = table(spark, d, "metric_line").select("file_name").distinct()
    parts = F.array(*[F.regexp_extract("file_name", p, 1).try_cast("int") for p in (r"^[^_]+_(\d+)", r"_(\d+)\.")])
    return f.select("file_name", F.rank().over(W.orderBy(parts)).alias("rank"))


@query("""WITH t AS (SELECT DISTINCT item_id, abstract FROM paper WHERE length(abstract) > 0),
b AS (SELECT item_id, trim(regexp_replace(abstract, '\\s*(©|\\(c\\)|Copyright).*$', '', 'i')) AS body FROM t) SELECT item_id, body, length(body) AS chars FROM b""")
def q_abstract_body(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "paper").where(F.length("abstract") > 0).select("item_id", "abstract").distinct()
    body = F.trim(F.regexp_replace("abstract", r"(?i)\s*(©|\(c\)|Copyright).*$", ""))
    return t.select("item_id", body.alias("body"), F.length(body).cast("bigint").alias("chars"))


@query("""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\\p{Lu}[\\p{L}’''-]+)(?: et al\\.?| (?:and|und|et|y|&) \\p{Lu}[\\p{L}’''-]+)?,? \\(?((?:1[5-9]|20)\\d{2})', 0)) AS m FROM documents) SELECT doc_id, count(*) AS mentions FROM d GROUP BY doc_id""")
def q_mention_counts(spark: SparkSession, d: str) -> DataFrame:
    return citations.author_year_mentions(table(spark, d, "documents")).groupBy("doc_id").agg(F.sum("times").alias("mentions"))
