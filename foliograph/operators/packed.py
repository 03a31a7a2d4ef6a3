"""Several values packed in one field, split by delimiter skeletons.

A field is cut into runs: a word, a digit, a blank, any other sign. Masking the
ordinary ones leaves the field's delimiter skeleton, one sign for each run, of
which there are few however many rows there are. For each distinct skeleton one
splitting rule is resolved from its quotes, brackets and delimiters, and joined
back (broadcast when its measured size allows); the rule names the first run
and the number of runs of each value, and values are picked out by position,
inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.session import broadcast_if_small, cut

_DASHES = "\\-\u00ad\u2010-\u2015\u2212\ufe63"
_RUN = r"\p{L}[\p{L}\p{M}]*|[\s\S]"
_WIDE, _PLAIN = "０１２３４５６７８９Ｘｘ－", "0123456789Xx-"
#: Signs between values; full-width forms count.
DELIMITERS = "\r\n\t;|/,&，；、"
#: Words that part values when they stand between blanks.
CONJUNCTIONS = ("and", "et", "und", "y")
_QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "„": "“"}
_BRACKETS = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Shape:
    """What a value looks like in a skeleton: 9 a digit, x a lone X, a a word, D a dash; `parts` are the lengths it is written in."""

    pattern: str
    parts: tuple[int, ...] = ()


#: Eight signs in two halves, with a dash, blanks or nothing between them.
ISSN = Shape(r"(?<!9)9{4}[D ]*9{3}[9x](?!9)", (4, 4))


def _runs(field: Column) -> Column:
    return F.regexp_extract_all(field, F.lit(_RUN), F.lit(0))


def _mask(run: Column) -> Column:
    return (
        F.when(run.rlike("^[0-9]$"), "9")
        .when(run.rlike("^[Xx]$"), "x")
        .when(F.lower(run).isin(*CONJUNCTIONS), "c")
        .when(run.rlike(r"^\p{L}"), "a")
        .when(run.rlike(f"^[{_DASHES}]$"), "D")
        .when(run.rlike(r"^[\r\n\t]$"), run)
        .when(run.rlike(r"^[\s\u00a0\u2000-\u200a\u202f\u3000]$"), " ")
        .otherwise(run)
    )


def _closing(sk: str, k: int, b: int, delimiters: str) -> int:
    """Where the quote opened at k closes: at a quote before a delimiter, a bracket or the end; -1 if it never does."""
    q = _QUOTES[sk[k]]
    j = k + 1
    while (j := sk.find(q, j, b)) >= 0:
        if sk[j + 1 : j + 2] == q and j + 1 < b:  # a doubled quote stands for itself
            j += 2
            continue
        rest = sk[j + 1 : b].lstrip(" ")
        if not rest or rest[0] in delimiters or rest[0] in ")]}([{c":
            return j
        j += 1
    return -1


def _parts(sk: str, a: int, b: int, delimiters: str, inner: bool) -> Iterator[tuple[int, int]]:
    """The stretches of a skeleton between its delimiters; quotes and brackets hold theirs together, but for those around everything."""
    while a < b and sk[a] == " ":
        a += 1
    while b > a and sk[b - 1] == " ":
        b -= 1
    if a < b and sk[a] in _BRACKETS and _match(sk, a, b) == b - 1:
        yield from _parts(sk, a + 1, b - 1, delimiters, inner)
        return
    if a < b and sk[a] in _QUOTES and _closing(sk, a, b, delimiters) == b - 1:
        if inner:
            yield from _parts(sk, a + 1, b - 1, delimiters, inner)
        else:
            yield a + 1, b - 1
        return
    first = k = a
    split = False
    while k < b:
        c = sk[k]
        end = -1
        if c in _QUOTES and not sk[first:k].strip(" "):
            end = _closing(sk, k, b, delimiters)
        elif c in _BRACKETS:
            end = _match(sk, k, b)
        if end >= 0:
            k = end + 1
        elif c in delimiters or c == "c" and k > a and k + 1 < b and sk[k - 1] == " " == sk[k + 1]:
            yield from _parts(sk, first, k, delimiters, inner)
            first = k = k + 1
            split = True
        else:
            k += 1
    if split:
        yield from _parts(sk, first, b, delimiters, inner)
    elif a < b:
        yield a, b


def _match(sk: str, k: int, b: int) -> int:
    """The bracket that closes the one at k, -1 if there is none."""
    depth, opened, closed = 0, sk[k], _BRACKETS[sk[k]]
    for j in range(k, b):
        depth += (sk[j] == opened) - (sk[j] == closed)
        if not depth:
            return j
    return -1


def rule_of(skeleton: str, shape: Shape | None = None, delimiters: str = DELIMITERS) -> list[list[int]]:
    """[first run, number of runs] of each value, in order.

    Delimiters part the skeleton, but not inside quotes or brackets (unless
    these hold everything). With a shape, a part's values are what has it, so
    labels, qualifiers and other numbers belong to none and values next to each
    other without a delimiter are told apart; without one, a part with any word
    or digit is a value whole.
    """
    out: list[list[int]] = []
    for a, b in _parts(skeleton, 0, len(skeleton), delimiters, shape is not None):
        if shape:
            out += [[m.start(), m.end() - m.start()] for m in re.compile(shape.pattern).finditer(skeleton, a, b)]
        elif re.search("[9axc]", skeleton[a:b]):
            out.append([a, b - a])
    return out


def split_packed(
    df: DataFrame, field: str, keys: list[str], value: str = "value", pos: str = "pos", at_least: int = 1, shape: Shape | None = None, delimiters: str = DELIMITERS
) -> DataFrame:
    """One row per value of `field`: `keys`, `pos` (from 1) and `value`.

    With a shape, values come in its parts, joined by a dash and in upper case;
    without, as they stand, without blanks at the ends, their quotes undone.
    Leave a sign out of `delimiters` where values hold it ('Family, Given').
    Only fields with `at_least` values count; how many there are is known from
    the rule of the skeleton, so no further pass groups rows. Rows equal in keys
    and field count once. Null, blank and valueless fields give no rows; empty
    places are not counted; a value written twice counts twice. Columns of df
    other than keys and field are ignored, whatever their names. Texts of any
    length are handled whole.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(field).alias("_field"))
    base = base.where(F.col("_field").isNotNull()).distinct()
    text = F.translate("_field", _WIDE, _PLAIN) if shape else F.col("_field")
    runs = base.withColumn("_runs", _runs(text)).withColumn("_skeleton", F.array_join(F.transform("_runs", _mask), ""))
    skeletons = runs.select("_skeleton").distinct()

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_skeleton": b["_skeleton"], "_rule": [rule_of(s, shape, delimiters) for s in b["_skeleton"]]})

    rules = cut(skeletons.mapInPandas(resolve, "_skeleton string, _rule array<array<int>>").where(F.size("_rule") >= max(1, at_least)))
    text = F.array_join(F.slice("_runs", F.get("_place", F.lit(0)) + 1, F.get("_place", F.lit(1))), "")
    if shape:
        text = F.upper(F.regexp_replace(text, f"[{_DASHES}\\s\u00a0]", ""))
        at = [sum(shape.parts[:i]) + 1 for i in range(len(shape.parts))]
        text = F.concat_ws("-", *[F.substring(text, a, n) for a, n in zip(at, shape.parts)])
    else:
        text = F.trim(F.replace(text, F.lit('""'), F.lit('"')))
    return (
        runs.join(broadcast_if_small(rules), "_skeleton")
        .select(*names, "_runs", F.posexplode("_rule").alias("_p", "_place"))
        .select(*[F.col(n).alias(k) for n, k in zip(names, keys)], (F.col("_p") + 1).cast("int").alias(pos), text.alias(value))
    )
