import json

import pytest
from pyspark.sql import functions as F

from foliograph.functions import markup
from foliograph.operators import changes, graph, metrics
from foliograph.sources import providers


def test_title_parts(spark):
    v = markup.title_parts("A <i>b</i> &amp;lt; c<sub>2</sub><script>x</script> p < 0.05")
    assert [(p["text"], p["styles"]) for p in v] == [("A ", []), ("b", ["i"]), (" < c", []), ("2", ["sub"]), (" p < 0.05", [])]
    assert markup.title_parts(None) is None and markup.title_parts("") == []
    df = spark.createDataFrame([("<b>x</b>",), (None,)], "t string")
    assert df.select(markup.title_parts_udf("t").alias("p")).first()["p"][0]["styles"] == ["b"]
    assert spark.createDataFrame([("caf\\u00e9",)], "t string").select(markup.decode_escapes("t")).first()[0] == "café"
    urls = spark.createDataFrame([("https://a.test/x",), ("ftp://a",), ("https://u@a.test",), ("https://a b",)], "u string")
    assert urls.where(markup.safe_url(F.col("u")).isNotNull()).count() == 1


def test_chunks():
    t = "One sentence here. " * 300
    parts = markup.chunks(t)
    assert all(len(p) <= 1600 for p in parts) and " ".join(parts).split() == t.split() and all(p.endswith(".") for p in parts)
    assert markup.chunks("x" * 4000) == ["x" * 1600, "x" * 1600, "x" * 800] and markup.chunks("") == [] and markup.chunks(None) is None


M = "metric_id bigint, issn string, journal string, metric_year int, jif double, category string, quartile string, source string"


def test_import_is_whole_or_nothing(spark):
    good = [(1, "0036-8075", "S", 2024, 1.2, "A", "Q1", "s"), (2, "0036-8075", "S", 2024, 1.2, "B", "Q2", "s")]
    r = metrics.checked_import(spark.createDataFrame(good, M)).collect()
    assert len(r) == 1 and r[0]["categories"] == "A:Q1; B:Q2"
    for bad in ((3, "0036-8075", "S", 2024, 9.9, "C", "Q1", "s"), (3, "0036-8075", "S", 2024, 1.2, "A", "Q3", "s"), (3, "0036-8076", "S", 2024, 1.2, "A", "Q1", "s"), (3, "0036-8075", "S", 2024, 1.2, "A", "Q1", "")):
        with pytest.raises(ValueError):
            metrics.checked_import(spark.createDataFrame([*good, bad], M))


def test_offline_package(spark):
    pkg = {"schema": 2, "history": {"k": {"meta": {"journalName": "S", "issn": "0036-8075"}, "dataByYear": [{"jcrYear": 2023, "jif": "<0.1", "category": []}, {"jcrYear": 2024, "jif": "0", "category": [{"category": "A", "quartile": "Q1"}]}]}}, "aliases": [{"journal": "Sci", "issn": "00368075"}]}
    r = {x["year"]: x for x in metrics.offline_package(spark.createDataFrame([(json.dumps(pkg),)], "json string")).collect()}
    assert r[2023]["jif"] is None and r[2023]["jif_bound"] == "<0.1" and r[2024]["jif"] == 0.0 and r[2024]["names"] == ["Sci"]


def test_choice_and_retention(spark):
    v = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "k int, v double")
    assert {r["k"]: r["status"] for r in metrics.choose(v, "k", ["v"]).collect()} == {1: "available", 2: "ambiguous"}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, False, "x"), (2, True, "c"), (3, True, "d")], "k int, ok boolean, v string")
    assert {r["k"]: r["v"] for r in changes.retained(old, new, "k", "ok", "v").collect()} == {1: "a", 2: "c", 3: "d"}


def test_overview(spark):
    g = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node bigint, community bigint")
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "a bigint, b bigint, weight double")
    p = spark.createDataFrame([(10, [(2,), (1,)]), (11, [(2,)])], "item_id bigint, creators array<struct<name_id:bigint>>")
    r = graph.overview(g, e, p).first()
    assert (r["members"], r["papers"], r["representative"]) == (3, 2, 2)


def test_pubmed(spark):
    x = "<PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>T</ArticleTitle><Journal><ISSN>0036-8075</ISSN><Title>J</Title><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>"
    r = providers.pubmed(spark.createDataFrame([(x,)], "xml string")).first()
    assert (r["title"], r["year"], r["issn"], r["creators"][0]["last_name"]) == ("T", 2001, "0036-8075", "L")
