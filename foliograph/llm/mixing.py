"""Mixing sources to target weights.

The tokens of each source are laid end to end and cut into blocks of fixed
length. Quotas in tokens follow the target shares; a source whose tokens, each
used max_repeats times, do not reach its quota gives all it may and the others
share the rest in proportion. A quota is so many whole passes over the source
and a part of one more, whose last slot is cut to what is left, so the total is
exact. Every output shard draws its source counts from a multinomial over the
slots left, so that the shards together use them up. A slot's running number
within its source is mapped through a pseudorandom permutation of that source's
block numbers (one for each pass), and blocks are joined to slots by number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.tokens import DEFAULT_VOCABULARY, ordered, running_start, with_tokens
from foliograph.session import cut

BLOCK = 256


def quotas(total: int, shares: dict[str, float], most: dict[str, int]) -> dict[str, int]:
    """Whole numbers that sum to `total` (or to all there is), in proportion to shares, none above `most`."""
    out = {s: 0 for s in shares}
    open_ = {s for s in shares if shares[s] > 0 and most.get(s, 0) > 0}
    left = total
    while open_:
        weight = sum(shares[s] for s in open_)
        full = {s for s in open_ if shares[s] / weight * left >= most[s]}
        if not full:
            exact = {s: shares[s] / weight * left for s in open_}
            for s in open_:
                out[s] = int(exact[s])
            rest = left - sum(out[s] for s in open_)
            for s in sorted(open_, key=lambda s: (out[s] - exact[s], s))[:rest]:
                out[s] += 1
            break
        for s in full:
            out[s] = most[s]
            left -= most[s]
        open_ -= full
    return out


def draw(quota: dict[str, int], shards: int, seed: int) -> np.ndarray:
    """Counts (shards x sources, sources in sorted order): multinomial draws that use up the quotas."""
    names = sorted(quota)
    left = np.array([quota[s] for s in names], dtype=np.int64)
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(shards):
        size = -(-int(left.sum()) // (shards - k))
        got = np.zeros_like(left)
        while size > 0:
            free = left - got
            step = np.minimum(rng.multinomial(size, free / free.sum()), free)
            got += step
            size -= int(step.sum())
        rows.append(got)
        left = left - got
    return np.array(rows)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 applied to `index`: a Feistel network on the next even number of bits, walked back into range."""
    bits = max(2, (n - 1).bit_length())
    half = np.uint64((bits + 1) // 2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        x = index.astype(np.uint64)
        out = np.full(len(x), -1, dtype=np.int64)
        todo = np.arange(len(x))
        while len(todo):
            a, b = x >> half, x & mask
            for r in range(4):
                a, b = b, a ^ (_mix64(b + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) & mask)
            x = (a << half) | b
            inside = x < np.uint64(n)
            out[todo[inside]] = x[inside].astype(np.int64)
            todo, x = todo[~inside], x[~inside]
    return out


@dataclass(frozen=True)
class Source:
    """A source of `tokens` in blocks: whole passes over all blocks, and `rest` tokens of one more pass."""

    tokens: int
    quota: int
    block: int

    @property
    def blocks(self) -> int:
        return -(-self.tokens // self.block)

    @property
    def passes(self) -> int:
        return self.quota // self.tokens

    @property
    def rest(self) -> int:
        return self.quota % self.tokens

    @property
    def slots(self) -> int:
        return self.passes * self.blocks + -(-self.rest // self.block)

    def place(self, q: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, pass, tokens taken) of the slots numbered q of this source.

        The part of a pass draws from the whole blocks; the short last block
        comes in only where all others are used.
        """
        turn, inner = q // self.blocks, q % self.blocks
        block = np.empty(len(q), dtype=np.int64)
        take = np.full(len(q), self.block, dtype=np.int64)
        whole = self.tokens // self.block
        for t in np.unique(turn):
            at = turn == t
            x = inner[at]
            if t < self.passes:
                block[at] = permute(x, self.blocks, key + int(t))
            else:
                block[at] = np.where(x < whole, permute(np.minimum(x, max(0, whole - 1)), max(1, whole), key + int(t)), whole)
                take[at] = np.minimum(self.block, self.rest - x * self.block)
        return block, turn, take


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shards: int | None = None, seed: int = 1, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The selection: (shard, slot, source, block, repeat, key, start_token, n_tokens), a row for each piece of a text in a block.

    Its size is that of all documents, or less if the repeats do not allow it.
    Texts are named by token ranges, not copied. A source without target, a
    null source and null or empty texts take no part; a target without
    documents gets nothing and its share goes to the others. Of targets that
    name one source twice the first by share counts. Shards are, where not
    given, as many as each has slots: the table of their source counts then
    grows with the square root of the data.
    """
    spark = docs.sparkSession
    goal = {}
    for r in sorted(targets.select("source", "target_share", "max_repeats").distinct().collect(), key=lambda r: (str(r[0]), -(r[1] or 0))):
        goal.setdefault(r["source"], (float(r["target_share"] or 0), int(r["max_repeats"] or 0)))
    counted = cut(with_tokens(docs.withColumn("_src", F.col(source).cast("string")), key, text, ["_src"], vocabulary).where("_n > 0"))
    held = {r["_src"]: r["t"] for r in counted.groupBy("_src").agg(F.sum("_n").alias("t")).where(F.col("_src").isin(list(goal))).collect()} if goal else {}
    total = (counted.agg(F.sum("_n")).first()[0] or 0)
    quota = quotas(total, {s: goal[s][0] for s in held}, {s: held[s] * goal[s][1] for s in held})
    use = {s: Source(held[s], q, block) for s, q in sorted(quota.items()) if q > 0}
    names = list(use)
    schema = "shard int, slot bigint, source string, block bigint, repeat int, _id bigint, start_token bigint, n_tokens bigint"
    if not names:
        return spark.createDataFrame([], schema).withColumnRenamed("_id", key)

    # what each block holds
    placed = running_start(ordered(counted.where(F.col("_src").isin(names)), ["_src", "_id"]), "_n", "_src", "_at")
    last = F.floor((F.col("_at") + F.col("_n") - 1) / block)
    parts = placed.select("_src", "_id", "_n", "_at", F.explode(F.sequence(F.floor(F.col("_at") / block), last)).alias("block"))
    low = F.greatest("_at", F.col("block") * block)
    parts = parts.select(
        F.col("_src").alias("source"), "block", "_id", (low - F.col("_at")).alias("start_token"), (low - F.col("block") * block).alias("_in"),
        (F.least(F.col("_at") + F.col("_n"), (F.col("block") + 1) * block) - low).alias("n_tokens"),
    )

    # slots are numbered through; runs of one shard and source are found by their first slot
    n_slots = sum(u.slots for u in use.values())
    drawn = draw({s: use[s].slots for s in names}, shards or math.isqrt(n_slots - 1) + 1, seed)
    run_lo = np.concatenate([[0], np.cumsum(drawn.ravel())[:-1]])
    run_q = (np.cumsum(drawn, axis=0) - drawn).ravel()
    runs = spark.sparkContext.broadcast((run_lo, run_q))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo, q_lo = runs.value
        for b in batches:
            slot = b["id"].to_numpy()
            r = np.searchsorted(lo, slot, side="right") - 1  # of empty runs at one place the last, which holds the slot
            code, q = r % len(names), q_lo[r] + slot - lo[r]
            got, again, take = (np.empty(len(b), dtype=np.int64) for _ in range(3))
            for j in np.unique(code):
                at = code == j
                got[at], again[at], take[at] = use[names[j]].place(q[at], seed * 1_000_003 + int(j) * 1009)
            yield pd.DataFrame({
                "shard": (r // len(names)).astype("int32"), "slot": slot, "source": [names[j] for j in code], "block": got,
                "repeat": again.astype("int32"), "_take": take,
            })

    slots = spark.range(n_slots).mapInPandas(place, "shard int, slot bigint, source string, block bigint, repeat int, _take bigint")
    out = slots.join(parts, ["source", "block"]).where("_in < _take")
    taken = F.least("n_tokens", F.col("_take") - F.col("_in"))
    return out.select("shard", "slot", "source", "block", "repeat", F.col("_id").alias(key), "start_token", taken.alias("n_tokens"))


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens): of each target, what the selection holds."""
    got = selection.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    whole = got.agg(F.sum("tokens").alias("_all"))
    goal = targets.groupBy("source").agg(F.max("target_share").alias("target_share"))
    return (
        goal.join(got, "source", "left").crossJoin(F.broadcast(whole))  # one row
        .select("source", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / F.col("_all"), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    )
