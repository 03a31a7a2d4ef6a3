"""Text functions as Column expressions; everything here stays inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter with marks, and those bases (built from the Unicode tables)."""
    src, dst = [], []
    for cp in range(0xC0, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_FROM, _TO = _accents()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}", "")


def clean(c: Column) -> Column:
    """Soft hyphens, zero-width signs and ligatures resolved, blanks collapsed, ends trimmed."""
    c = F.replace(F.replace(F.regexp_replace(c, "[­​]", ""), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def plain_title(c: Column) -> Column:
    """A title without mark-up; comparisons written with < and > stay."""
    return clean(F.regexp_replace(c, r"</?(?:i|b|em|strong|sub|sup|scp|span|p|br)(?:\s[^<>]*)?/?>", ""))


def norm(c: Column) -> Column:
    """Letters and digits only, lower case, accentless, single blanks."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(plain_title(c))), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column) -> Column:
    """Distinct words of a normalised text."""
    return F.array_distinct(F.filter(F.split(norm(c), " "), lambda w: w != ""))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two word sets; 0 if either is empty."""
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def name_forms(c: Column) -> Column:
    """Rotations of the first ten words of a name, each written together."""
    w = F.slice(F.filter(F.split(norm(c), " "), lambda x: x != ""), 1, 10)
    n = F.size(w)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.concat(F.slice(w, i, n), F.slice(w, F.lit(1), i - 1)), ""))).otherwise(
        F.array().cast("array<string>")
    )


def one_edit(a: Column, b: Column) -> Column:
    """Whether one insert, drop, replacement or swap of neighbours turns a into b."""
    i = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), lambda k, p: F.when((k == 0) & (F.substr(a, p, F.lit(1)) != F.substr(b, p, F.lit(1))), p).otherwise(k))
    swapped = F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2))
    return (F.levenshtein(a, b) == 1) | ((F.length(a) == F.length(b)) & (i > 0) & (i < F.length(a)) & (swapped == b))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the code points of a text."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, x: h.bitwiseXOR(x) * 16777619 % 4294967296)


def snippet(text: Column, term: Column, before: int = 90, after: int = 160) -> Column:
    """The text around the first occurrence of `term` (lower case), null if there is none."""
    at = F.instr(F.lower(text), term)
    begin = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(text, begin, at - begin + after))
