from hypothesis import given, settings
from hypothesis import strategies as st

from foliograph.operators.csvgrammar import COLUMNS, issn_error, judge, parse_files, parse_records, record, records, recover

GOOD = "9900-0008,Journal of X,2001,1.5,Optics,Q1,List"


def _why(line):
    return judge(record(line))


def test_reasons():
    assert _why(GOOD) is None
    assert _why("﻿" + GOOD + "\r") is None
    assert _why(' "9900-0008;9900-0016" , "A, ""b""" ,2001,,x,Q1,s') is None
    assert _why('9900-0008,"Journal,2001,1,x,Q1,s') == "quoting"
    assert _why('9900-0008,Jour"nal,2001,1,x,Q1,s') == "quoting"
    assert _why('9900-0008,"Journal" new,2001,1,x,Q1,s') == "quoting"
    assert _why("9900-0008,Journal,2001") == "column_count"
    assert _why(GOOD.replace(",", ";")) == "column_count"
    assert _why(GOOD.replace("9900-0008", "9900-0009")) == "issn"
    assert _why(GOOD.replace("9900-0008", "")) == "issn"
    assert _why(GOOD.replace("2001", "2027")) == "metric_year"
    assert _why(GOOD.replace("2001", "2O01")) == "metric_year"
    assert _why(",".join(COLUMNS)) == ""
    assert _why(" ,, ,") == ""
    assert _why("") == ""
    assert not issn_error("9900-044X 9900044x")


def test_resumes_after_broken_quote():
    text = f'{GOOD}\n9900-0016,"never closed,2001,1,x,Q1,s\n9900-0040,B,2002,1,x,Q2,s\nnoise"\n{GOOD}\n'
    got = [(judge(p), p.at is not None) for p in records(text)]
    assert got[0] == (None, False) and got[1] == ("quoting", True) and got[2] == (None, False) and got[-1] == (None, False)


def test_table(spark):
    rows = [(1, GOOD, "z"), (1, GOOD, "z"), (2, None, "z"), (3, "x" * 200_000, "z"), (4, 'a"', "z"), (5, "", "z")]
    got = {r["line_id"]: r["reason"] for r in parse_records(spark.createDataFrame(rows, "line_id bigint, line string, reason string"), "line_id", "line").collect()}
    assert got == {1: None, 3: "column_count", 4: "quoting"}
    assert parse_records(spark.createDataFrame([], "line_id bigint, line string"), "line_id", "line").count() == 0


def test_files(spark):
    df = spark.createDataFrame([("a", f"{','.join(COLUMNS)}\n{GOOD}\n{GOOD},\n"), ("b", None)], "path string, text string")
    assert sorted(str(r["reason"]) for r in parse_files(df).collect()) == ["None", "column_count"]


def test_recovery_without_row_bounds(spark):
    lines = [GOOD, '9900-0016,"never closed,2001,1,x,Q1,s', GOOD, '9900-0024,"two\nlines",2001,1,x,Q1,s', "9900-0009,A,2001,1,x,Q1,s", 'a"b', GOOD]
    df = spark.createDataFrame([(k, x, "f", k, 0) for k, x in enumerate(lines)] * 2 + [(90, "x", None, 1, 0), (91, None, "f", 3, 0)], "line_id bigint, line string, file string, no int, reason int")
    for block in (2, 512):
        assert {(r["line_id"], r["reason"]) for r in recover(df, "line_id", "line", "file", "no", block).collect()} == {(1, "quoting"), (4, "issn"), (5, "quoting"), (90, "column_count")}
    assert recover(df.limit(0), "line_id", "line", "file", "no").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\n ;é', max_size=8), min_size=1, max_size=9))
def test_quoted_round_trip(values):
    line = ",".join('"' + v.replace('"', '""') + '"' for v in values)
    p = record(line)
    assert p.fields is not None and [f.strip() for f in p.fields] == [v.strip(" \n") for v in values]
