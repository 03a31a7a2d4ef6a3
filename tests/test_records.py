from pyspark.sql import functions as F

from foliograph.operators import records as R


def test_search_sources_scope(spark):
    df = spark.createDataFrame([(1, "Rétina, I", None), (2, None, "10.1/retina"), (3, None, None)], "id int, raw string, doi string")
    assert sorted(r["id"] for r in R.list_search(df, "RETINA", "raw", "doi").collect()) == [1, 2]
    assert R.list_search(df, "", "raw").count() == 3
    e = spark.createDataFrame([(1, "p", 7, "k"), (2, "p", 8, "k"), (3, "q", 7, "k"), (4, None, None, None)], "ref int, source string, attachment_id long, attachment_key string")
    p = spark.createDataFrame([("p", [(7, "k")]), ("p", [(7, "k")]), ("q", None)], "id string, attachments array<struct<id:long,key:string>>")
    assert [r["ref"] for r in R.valid_sources(e, p).collect()] == [1]
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), (None, "a")], "a string, b string")
    assert [tuple(r) for r in R.in_scope(edges, spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "node string")).collect()] == [("a", "b")]


def test_parsers(spark):
    df = spark.createDataFrame([("Q2; q1, Q2",), ("none",), (None,), ("< 0.1",), ("PMID: 123, pmid 45 PMID 0",)], "t string")
    got = [tuple(r) for r in df.select(R.quartiles(F.col("t")), R.metric_number(F.col("t")), R.pmids(F.col("t"))).collect()]
    assert got == [(["Q2", "Q1"], None, []), ([], None, []), (None, None, None), ([], "<0.1", []), ([], None, ["123", "45"])]


def test_enrichment_needs_one_name_on_both_sides(spark):
    s = "item_id long, doi string, creators array<struct<name_id:long,first_name:string,last_name:string,orcid:string>>"
    o, o2 = "0000-0002-1825-0097", "0000-0001-5109-3700"
    rows = [
        (1, "10.1234/a", [(1, "Ewa", "Olnetal", o), (2, "Jan", "Darberg", None)]), (2, "10.1234/A", [(3, "E.", "Olnetal", None), (4, "J.", "Darberg", None)]), (2, "10.1234/A", [(3, "E.", "Olnetal", None), (4, "J.", "Darberg", None)]),
        (3, "10.1234/b", [(5, "Ewa", "Olnetal", o), (6, "Emil", "Olnetal", o2)]), (4, "10.1234/b", [(7, "E.", "Olnetal", None)]), (5, None, [(8, "E.", "Olnetal", None)]), (6, "10.1234/c", None),
    ]
    df = spark.createDataFrame(rows, s)
    assert [tuple(r) for r in R.enrich_creators(df).collect()] == [(3, o)]
    assert R.enrich_creators(df.limit(0)).count() == 0


def test_members_and_guard(spark):
    s = "item_id long, year string, creators array<struct<first_name:string,last_name:string>>"
    df = spark.createDataFrame([(k, "2001" if k % 2 else None, [("Ewa", "Olnetal")]) for k in range(6)], s)
    assert [(r["item_id"], r["rank"]) for r in sorted(R.expand_members(df, 4).collect(), key=lambda r: r["rank"])] == [(1, 1), (3, 2), (5, 3), (0, 4)]
    j = spark.createDataFrame([(1, "J X"), (2, "Y"), (3, None)], "journal_id int, title string")
    m = spark.createDataFrame([(k, "j. x", 0) for k in range(4)], "metric_id long, journal string, journal_id int")
    assert sorted(tuple(r) for r in R.metric_search(j, m, 3).collect()) == [(1, 4, "ambiguous"), (2, 0, "missing"), (3, 0, "missing")]
