"""Token counts by a public tokenizer, and positions in a distributed order."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.session import cut_in_order

#: Vocabulary file used where a caller names none: ranks of a public byte-level BPE.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """The tokenizer of a rank file; one per process."""
    import tiktoken

    lines = Path(vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(Path(vocabulary).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, vocabulary: str = DEFAULT_VOCABULARY) -> list[int]:
    return encoder(vocabulary).encode_ordinary(text)


def with_tokens(docs: DataFrame, key: str, text: str, keep: list[str] | None = None, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(_id, *keep, _n): each row's number of tokens; null texts count 0. Rows with a null key are left out."""
    keep = keep or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for b in batches:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in b["_text"]]
            yield b.drop(columns="_text").assign(_n=n)

    slim = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("_id"), *keep, F.col(text).alias("_text"))
    kinds = dict(slim.dtypes)
    return slim.mapInPandas(run, "_id bigint, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + "_n bigint")


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """df sorted over its partitions by keys and materialised; `_pid` numbers the partitions in order.

    df is read twice, once for the bounds of the partitions: hand over a cut table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_in_order(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)).withColumn("_pid", F.spark_partition_id())


def running_start(df: DataFrame, size: str, group: str | None = None, out: str = "_start", more: str = "", then=None) -> DataFrame:
    """`out`: the sum of `size` over the rows before each row of an ordered frame, within its `group`.

    `then` may turn each batch into one with the further columns `more` in the same pass.

    Sums by partition (and group) are gathered, a number for each; rows are
    then numbered where they lie, so no group is ever brought into one task.
    """
    by = F.coalesce(F.col(group).cast("string"), F.lit("\u0000")) if group else F.lit("")
    sums = df.groupBy("_pid", by.alias("_by")).agg(F.sum(size).alias("_s")).orderBy("_pid").collect()
    starts: dict[tuple[int, str], int] = {}
    total: dict[str, int] = {}
    for r in sums:
        starts[r["_pid"], r["_by"]] = total.get(r["_by"], 0)
        total[r["_by"]] = total.get(r["_by"], 0) + r["_s"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[tuple[int, str], int] = {}
        for b in batches:
            begin = []
            for p, g, n in zip(b["_pid"], b["_by"], b[size]):
                k = (p, g)
                v = at.get(k, starts[k])
                begin.append(v)
                at[k] = v + int(n)
            b = b.drop(columns=["_by"]).assign(**{out: begin})
            yield then(b) if then else b

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.withColumn("_by", by).mapInPandas(run, f"{kinds}, `{out}` bigint{more and ', ' + more}").drop("_pid")
