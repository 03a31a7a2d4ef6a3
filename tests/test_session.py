from pyspark.sql import functions as F

from foliograph.session import broadcast_if_few, cut, cut_parts, release, rows_of, trim


def test_rows_of_written_tables(spark):
    empty, few = cut(spark.range(10).where("id > 20")), cut(spark.range(10))
    assert rows_of(empty) == 0 and rows_of(few, 100) == 10 and 1 <= rows_of(few) <= 10
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_few(few)) and not hinted(broadcast_if_few(few, 9 * 16))
    release(empty, few)


def test_tables_written_in_one_go(spark):
    df = spark.range(6).select("id", (F.col("id") % 2).cast("int").alias("kind"))
    whole, (even, odd, none) = cut_parts(df, "kind", 3)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, df.collect()))
    assert [sorted(x["id"] for x in part.collect()) for part in (even, odd, none)] == [[0, 2, 4], [1, 3, 5], []] and even.columns == none.columns == ["id"]
    whole, parts = cut_parts(df.where("id > 9"), "kind", 2)
    assert whole.columns == ["id", "kind"] and [x.count() for x in (whole, *parts)] == [0, 0, 0]


def test_trim_does_no_harm(spark):
    trim(spark)
    assert spark.range(3).count() == 3
