"""Inverted texts: word -> positions, and the text they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 10_000


def inverted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, positions)."""
    words = df.select(key, F.posexplode(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")).alias("pos", "word"))
    return words.groupBy(key, "word").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def restored(index: DataFrame, key: str) -> DataFrame:
    """(key, text); '' where positions have gaps, conflicts, or leave 0..9999."""
    placed = index.select(key, "word", F.explode("positions").alias("pos"))
    whole = placed.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("pos").alias("d"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
    )
    good = (F.col("n") == F.col("d")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("n") <= LONGEST)
    return whole.select(key, F.when(good, F.array_join("w.word", " ")).otherwise("").alias("text"))
