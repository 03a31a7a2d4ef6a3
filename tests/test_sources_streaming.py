import json

from pyspark.sql import functions as F

from foliograph.operators.changes import dirty_items
from foliograph.sources import providers, sinks
from foliograph.streaming.feeds import arrivals, follow_changes, latest_state


def test_crossref(spark):
    m = {"DOI": "10.1234/X", "title": ["A <i>b</i>"], "ISSN": ["0036-8075", "bad"], "issued": {"date-parts": [[2001]]}, "published-print": {"date-parts": [[2000, 5]]}, "author": [{"given": "A", "family": "B", "ORCID": "https://orcid.org/0000-0002-1825-0097"}, {"name": "Group"}]}
    r = providers.crossref(spark.createDataFrame([(json.dumps(m),), ("{",)], "json string")).collect()
    assert (r[0]["doi"], r[0]["title"], r[0]["year"], r[0]["issn"]) == ("10.1234/x", "A b", 2000, ["0036-8075"])
    assert [c["last_name"] for c in r[0]["creators"]] == ["B", "Group"] and r[1]["doi"] is None


def test_openalex_and_europe_pmc(spark):
    good, gap = {"cells": [1, 3], "Retinal": [0], "and": [2]}, {"a": [0], "b": [2]}
    df = spark.createDataFrame([(json.dumps({"title": "t", "abstract_inverted_index": x}),) for x in (good, gap)], "json string")
    assert [r["abstract"] for r in providers.openalex(df).collect()] == ["Retinal cells and cells", ""]
    m = {"doi": "10.1/no", "title": "T", "pubYear": "1999", "authorList": {"author": [{"firstName": "A", "lastName": "B"}]}}
    assert providers.europe_pmc(spark.createDataFrame([(json.dumps(m),)], "json string")).first()["year"] == 1999


def test_orcid_works(spark):
    def work(code, date, **kw):
        return {"put-code": code, "title": {"title": {"value": f"w{code}"}}, "publication-date": {k: {"value": v} for k, v in date.items()}} | kw

    groups = [{"work-summary": [work(1, {"year": "2021", "month": "02", "day": "29"}), work(2, {"year": "2020"}, **{"display-index": "5"})]}, {"work-summary": [work(3, {"year": "2021", "month": "02", "day": "29"})]}, {"work-summary": [work(4, {}, visibility="limited")]}]
    r = {x["title"]: (x["year"], x["month"], x["day"], x["precision"]) for x in providers.orcid_works(spark.createDataFrame([("o", json.dumps({"group": groups}))], "orcid string, json string")).collect()}
    assert r == {"w2": (2020, None, None, "year"), "w3": (2021, 2, None, "month")}


def test_extra(spark):
    df = spark.createDataFrame([(1, "jif: 2.5\nquartile：Q1\njif: 3\nnote")], "id bigint, extra string")
    assert {(r["field"], r["value"]) for r in providers.extra_metrics(df, "id", "extra").collect()} == {("jif", None), ("quartile", "Q1")}


def test_sinks(spark, tmp_path):
    lib = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    new, bad = sinks.guarded_upsert(lib, spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k")
    assert [r["k"] for r in new.collect()] == ["c"] and [r["k"] for r in bad.collect()] == ["b"]
    p = spark.createDataFrame([("journalArticle", "T\nER  - x", [("A", "B")], "2001", None, "10.1234/a")], "item_type string, title string, creators array<struct<first_name:string,last_name:string>>, year string, journal string, doi string")
    sinks.write_ris(p, str(tmp_path / "ris"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "ris")).collect()]
    assert sum(x.startswith("ER") for x in lines) == 1 and "AU  - B, A" in lines


S = "change_id bigint, event string, type string, ids array<string>, changed_at timestamp"


def test_change_stream(spark, tmp_path):
    src, state = str(tmp_path / "feed"), str(tmp_path / "state")
    t = "TIMESTAMP'2024-01-01 00:00:00'"
    lib = lambda: spark.sql("SELECT * FROM VALUES (1, 'one'), (2, 'two'), (3, 'three') AS t(item_id, title)")
    rows = [(1, "modify", "item", "2"), (2, "delete", "item", "3"), (3, None, "item", "1"), (4, "modify", "collection", "42"), (5, "add", "collection-item", "42-1")]
    feed = spark.createDataFrame(rows, "change_id bigint, event string, type string, i string").select("change_id", "event", "type", F.array("i").alias("ids"), F.expr(t).alias("changed_at"))
    assert {(r["item_id"], r["deleted"]) for r in dirty_items(feed).collect()} == {(2, False), (3, True), (1, False)}
    assert arrivals(feed).agg(F.sum("changes")).first()[0] == 4
    for part in (feed.where("change_id <= 1"), feed.where("change_id > 1")):
        part.coalesce(1).write.mode("append").parquet(src)
        q = follow_changes(spark.readStream.schema(feed.schema).parquet(src), lib, state, str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert {r["item_id"] for r in latest_state(spark, state).collect()} == {1, 2}
