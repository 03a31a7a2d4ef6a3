"""Sinks: RIS export and guarded library upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import ids, text

#: RIS types of item types.
RIS_TYPES = {"journalArticle": "JOUR", "preprint": "UNPB", "bookSection": "CHAP", "conferencePaper": "CPAPER"}


def ris() -> Column:
    """A paper row as one RIS record; values are cleaned, so none can open a record of its own."""
    kind = F.lit("GEN")
    for k, v in RIS_TYPES.items():
        kind = F.when(F.col("item_type") == k, v).otherwise(kind)

    def line(tag: str, value: Column) -> Column:
        return F.concat(F.lit(f"{tag}  - "), value)

    authors = F.array_join(F.transform("creators", lambda c: line("AU", text.clean(F.concat_ws(", ", c["last_name"], c["first_name"])))), "\n")
    return F.concat_ws(
        "\n", line("TY", kind), line("TI", text.clean(F.col("title"))), authors, line("PY", ids.year(F.col("year")).cast("string")),
        line("JO", text.clean(F.col("journal"))), line("DO", ids.doi(F.col("doi"))), F.lit("ER  - "),
    )


def write_ris(papers: DataFrame, path: str) -> None:
    papers.select(ris().alias("value")).write.mode("overwrite").text(path)


def guarded_upsert(library: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, conflicts): new keys are inserted, a key held once is left as it is, a key held more often is a conflict."""
    held = library.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    seen = incoming.join(held, key, "left")
    return seen.where("_n IS NULL").drop("_n"), seen.where("_n > 1").drop("_n")
