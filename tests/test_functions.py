from pyspark.sql import functions as F

from foliograph.functions import ids, text


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first()["v"]


def test_doi(spark):
    assert one(spark, ids.doi, " https://doi.example/10.1234%2FAbC(1). ") == "10.1234/abc(1)"
    assert one(spark, ids.doi, "10. 1234/x)") == "10.1234/x"
    assert one(spark, ids.doi, "none") is None and one(spark, ids.doi, None) is None


def test_checks(spark):
    assert one(spark, ids.issn, "0036-8075") == "0036-8075" and one(spark, ids.issn, "0036-8076") is None and one(spark, ids.issn, "x") is None
    assert one(spark, ids.orcid, "https://orcid.org/0000-0002-1825-0097") == "0000-0002-1825-0097"
    assert one(spark, ids.orcid, "0000-0002-1825-0098") is None
    assert one(spark, ids.year, "c1984") == 1984 and one(spark, ids.year, "n.d.") is None


def test_text(spark):
    assert one(spark, text.norm, "<i>Étude</i>  de l'œil — ß") == "etude de l œil ß"
    assert one(spark, text.one_edit, "retinal", "retianl") and not one(spark, text.one_edit, "retinal", "retinal") and not one(spark, text.one_edit, "abcde", "abxye")
    assert one(spark, text.fnv1a, "author:a") == 4094068479
    assert one(spark, text.name_forms, "Ligande Min-Olo") == ["ligandeminolo", "minololigande", "ololigandemin"]
    assert one(spark, text.name_forms, "") == []
    assert one(spark, lambda a, b: text.dice(text.tokens(a), text.tokens(b)), "a b c", "b c d") == 2 / 3
