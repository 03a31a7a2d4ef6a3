"""Filling fixed-capacity containers with items: variable-capacity best-fit over a size histogram.

Items matter to packing only by their size, and there are at most `capacity`
sizes. The plan is therefore made on counts by size, of bounded length however
many items there are: the largest size left opens a bin; for each permitted bin
size the best-fit filling is worked out on the counts at hand, the size of least
cost (space left unused and a fixed cost of opening, for each token held) is
opened, as often as the counts allow; at the end each bin is downsized to the
least permitted size that holds its contents. Items then find their place by
their rank among the items of their size, without any group being gathered.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.tokens import DEFAULT_VOCABULARY, ordered, running_start, with_tokens
from foliograph.session import cut

CAPACITY = 2048
PERMITTED = (512, 1024, 1536, 2048)
#: Cost of opening a bin, in tokens of unused space.
OPENING = 64


@dataclass(frozen=True)
class Placement:
    """Items of `size` with rank lo..hi-1 go to bins bin_lo, bin_lo + 1, ... at `offset`; `capacity` is those bins' final size."""

    size: int
    lo: int
    hi: int
    bin_lo: int
    offset: int
    capacity: int


def _fill(free: np.ndarray, room: int) -> list[int]:
    """Sizes chosen by best fit for `room` of `free` counts by size: what fills it exactly, alone or as a pair, else the largest that fits."""
    free = free.copy()
    out: list[int] = []
    while room > 0:
        held = np.flatnonzero(free[: room + 1])
        if not len(held):
            break
        take = (int(held[-1]),)
        if take[0] != room:
            # an exact pair, the one with the largest item first
            big = held[::-1]
            big = big[2 * big >= room]
            fits = big[free[room - big] > (2 * big == room)]
            if len(fits):
                take = (int(fits[0]), room - int(fits[0]))
        for s in take:
            free[s] -= 1
            room -= s
        out += take
    return out


def plan(counts: dict[int, int], permitted: tuple[int, ...] = PERMITTED, opening: int = OPENING) -> list[Placement]:
    """Placements for items given as counts by size (sizes 1 to the largest permitted).

    Each step uses up at least one size, so there are at most as many steps as sizes.
    """
    permitted = tuple(sorted(permitted))
    if any(n > 0 and s > permitted[-1] for s, n in counts.items()):
        raise ValueError("an item exceeds the largest container")
    free = np.zeros(permitted[-1] + 1, dtype=np.int64)
    for s, n in counts.items():
        if s > 0:
            free[s] = max(0, n)
    placed = dict.fromkeys(counts, 0)
    out: list[Placement] = []
    bins = 0
    while len(held := np.flatnonzero(free)):
        top = int(held[-1])
        best: tuple[float, list[int]] | None = None
        free[top] -= 1
        for size in permitted:
            if size < top:
                continue
            inside = [top, *_fill(free, size - top)]
            tokens = sum(inside)
            cost = (size - tokens + opening) / tokens
            if best is None or cost < best[0] - 1e-12:
                best = (cost, inside)
        free[top] += 1
        inside = best[1]
        need = Counter(inside)
        times = min(int(free[s]) // n for s, n in need.items())
        final = next(p for p in permitted if p >= sum(inside))
        offset = 0
        for s in inside:
            out.append(Placement(s, placed[s], placed[s] + times, bins, offset, final))
            placed[s] += times
            offset += s
        bins += times
        for s, n in need.items():
            free[s] -= n * times
    return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, permitted: tuple[int, ...] = PERMITTED, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Every token of every text in one container: (key, piece, start_token, n_tokens, container, position, capacity).

    `position` is the first token's place in the container, `capacity` its
    final size, one of the permitted ones. A text is cut only if it alone
    exceeds `capacity`, into whole containers and a rest. Null and empty texts
    hold no tokens and are left out; rows of equal key and text are packed as
    often as they occur, each under its key.
    """
    if max(permitted) != capacity:
        raise ValueError("the largest permitted size must be the capacity")
    # tokenized once: ordering reads its input twice
    counted = cut(with_tokens(docs, key, text, vocabulary=vocabulary).where("_n > 0"))
    pieces = counted.select("_id", "_n", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / capacity).cast("int"))).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    pieces = pieces.select("_id", "piece", start.alias("start_token"), F.least(F.lit(capacity).cast("bigint"), F.col("_n") - start).alias("size"))
    counts = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}  # at most `capacity` rows
    first, at = {}, 0
    for s in sorted(counts):
        first[s] = at
        at += counts[s]
    # placements part the numbers 0, 1, ... of the ordered pieces into stretches: a piece's is found by its number alone
    places = sorted((first[p.size] + p.lo, p.bin_lo, p.offset, p.capacity) for p in plan(counts, permitted))
    low, bins, offsets, sizes = (np.array(c, dtype=np.int64) for c in zip(*places)) if places else (np.zeros(0, dtype=np.int64),) * 4

    def place(b: pd.DataFrame) -> pd.DataFrame:
        k = np.searchsorted(low, b["_index"].to_numpy(), side="right") - 1
        return b.assign(container=bins[k] + b["_index"] - low[k], position=offsets[k].astype("int32"), capacity=sizes[k].astype("int32"))

    ranked = running_start(
        ordered(pieces, ["size", "_id", "piece"]).withColumn("_one", F.lit(1).cast("bigint")), "_one", out="_index",
        more="container bigint, position int, capacity int", then=place,
    )
    return ranked.select(F.col("_id").alias(key), "piece", "start_token", F.col("size").cast("int").alias("n_tokens"), "container", "position", "capacity")


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, space unused by final sizes and had every container the full capacity."""
    bins = packed.groupBy("container").agg(F.sum("n_tokens").alias("held"), F.first("capacity").alias("size"))
    return bins.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("held").alias("tokens"), F.sum("size").alias("space"),
        F.round(1 - F.sum("held") / F.sum("size"), 6).alias("unused_share"),
        F.round(1 - F.sum("held") / (F.count(F.lit(1)) * capacity), 6).alias("unused_share_full_size"),
    )
