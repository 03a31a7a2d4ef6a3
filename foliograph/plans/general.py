"""Queries of the general training-data operators (packed fields, rows that fail to parse)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators.csvgrammar import parse_records, recover
from foliograph.operators.packed import ISSN, split_packed
from foliograph.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(table(spark, sf_dir, "metric_import"), "issn", ["metric_id"], "issn", "pos", at_least=2, shape=ISSN)


def p4_all_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(table(spark, sf_dir, "metric_import"), "issn", ["metric_id"], "issn", "pos", shape=ISSN)


def p4_affiliation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Department, institution and so on of each affiliation text, in order."""
    texts = table(spark, sf_dir, "paper").select(F.explode("creators.affiliations").alias("a")).select(F.explode("a").alias("affiliation"))
    return split_packed(texts, "affiliation", ["affiliation"], "part", "pos", delimiters=",")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(table(spark, sf_dir, "metric_line"), "line_id", "line").where(F.col("reason").isNotNull()).select("line_id", "reason")


def p5_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recover(table(spark, sf_dir, "metric_line"), "line_id", "line", "file_name", "line_no")


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_records(table(spark, sf_dir, "metric_line"), "line_id", "line").where(F.col("reason").isNull())
    return rows.select("line_id", F.array_join("issn", ";").alias("issn"), "journal", "metric_year", "jif", "category", "quartile", "source")


QUERIES = {
    "p4_found": p4_found, "p4_all_values": p4_all_values, "p4_affiliation_parts": p4_affiliation_parts,
    "p5_found": p5_found, "p5_recovered": p5_recovered, "p5_loaded": p5_loaded,
}

_VALUES = """
WITH t AS (SELECT DISTINCT metric_id, regexp_replace(translate(issn, '０１２３４５６７８９Ｘｘ', '0123456789Xx'), '[-‐-―−]', '', 'g') AS s FROM metric_import WHERE issn IS NOT NULL),
v AS (SELECT metric_id, regexp_extract_all(s, '[0-9]{7}[0-9Xx]') AS a FROM t)
SELECT metric_id, CAST(pos AS INTEGER) AS pos, upper(a[pos][1:4] || '-' || a[pos][5:8]) AS issn
FROM (SELECT metric_id, a, unnest(generate_series(1, len(a))) AS pos FROM v WHERE len(a) >= {least})
"""

ORACLE = {"p4_found": _VALUES.replace("{least}", "2"), "p4_all_values": _VALUES.replace("{least}", "1")}

ORACLE["p4_affiliation_parts"] = """
WITH t AS (SELECT DISTINCT unnest(c.affiliations) AS affiliation FROM (SELECT unnest(creators) AS c FROM paper)),
v AS (SELECT affiliation, list_filter(list_transform(string_split(affiliation, ','), lambda p: trim(p)), lambda p: regexp_matches(p, '[\\p{L}0-9]')) AS a FROM t)
SELECT affiliation, CAST(pos AS INTEGER) AS pos, a[pos] AS part FROM (SELECT affiliation, a, unnest(generate_series(1, len(a))) AS pos FROM v)
"""

_B = "[ \\t\u00a0\u3000\u2002\u2003\u2007\u2009\u202f]*"
_FIELD = f'{_B}(?:"(?:[^"]|"")*"{_B}|[^",]*)'
_ENDS = "chr(9) || chr(10) || chr(13) || chr(32) || chr(160) || chr(65279) || chr(12288) || chr(8194) || chr(8195) || chr(8199) || chr(8201) || chr(8239)"
_CHECK = " + ".join(f"(ascii(_x[{i}]) - 48) * {9 - i}" for i in range(1, 8))
_BAD_ISSN = f"""NOT (regexp_full_match(p, '[0-9]{{4}}-?[0-9]{{3}}[0-9Xx]') AND
list_first(list_transform([upper(replace(p, '-', ''))], lambda _x: ({_CHECK} + CASE WHEN _x[8] = 'X' THEN 10 ELSE ascii(_x[8]) - 48 END) % 11 = 0)))"""
_RECORDS = f"""
l AS (SELECT DISTINCT line_id, trim(line, {_ENDS}) AS s FROM metric_line WHERE line IS NOT NULL),
g AS (SELECT line_id, s, regexp_full_match(s, '{_FIELD}(?:,{_FIELD})*') AS whole, list_transform(regexp_extract_all(s || ',', '{_B}("(?:[^"]|"")*"{_B}|[^",]*),', 1),
 lambda f: trim(CASE WHEN starts_with(f, '"') THEN replace(regexp_extract(f, '^"((?:[^"]|"")*)"', 1), '""', '"') ELSE f END, {_ENDS})) AS f FROM l),
d AS (SELECT * FROM g WHERE NOT whole OR (len(list_filter(f, lambda x: x <> '')) > 0 AND lower(array_to_string(f, ',')) <> 'issn,journal,metricyear,jif,category,quartile,source')),
v AS (SELECT *, list_filter(string_split_regex(f[1], '[;,\\s\u00a0\u3000\u2002\u2003\u2007\u2009\u202f]+'), lambda p: p <> '') AS issns FROM d),
r AS (SELECT *, CASE WHEN NOT whole THEN 'quoting' WHEN len(f) <> 7 THEN 'column_count' WHEN len(issns) = 0 OR len(list_filter(issns, lambda p: {_BAD_ISSN})) > 0 THEN 'issn'
 WHEN NOT regexp_full_match(f[3], '[0-9]{{4}}') OR TRY_CAST(f[3] AS INTEGER) NOT BETWEEN 1975 AND 2026 THEN 'metric_year' END AS reason FROM v)"""
ORACLE["p5_found"] = f"WITH {_RECORDS} SELECT line_id, reason FROM r WHERE reason IS NOT NULL"
ORACLE["p5_loaded"] = f"""WITH {_RECORDS} SELECT line_id, array_to_string(list_transform(issns, lambda p: replace(upper(p), '-', '')[1:4] || '-' || replace(upper(p), '-', '')[5:8]), ';') AS issn, f[2] AS journal,
CAST(f[3] AS INTEGER) AS metric_year, CASE WHEN regexp_full_match(f[4], '[0-9]+(?:\\.[0-9]+)?') THEN CAST(f[4] AS DOUBLE) END AS jif, f[5] AS category, f[6] AS quartile, f[7] AS source FROM r WHERE reason IS NULL"""
