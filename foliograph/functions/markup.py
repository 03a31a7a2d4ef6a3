"""Functions whose control flow needs Python: Arrow-batched pandas UDFs."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?(/?)>")
_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>", re.S | re.I)
#: Elements kept as styles, by the names they go under.
STYLES = {"i": "i", "em": "i", "b": "b", "strong": "b", "sub": "sub", "sup": "sup"}
_BLOCKS = frozenset("p div br li tr h1 h2 h3 title sec".split())
DEEPEST = 8
PARTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("styles", T.ArrayType(T.StringType()))]))


def title_parts(value: str | None) -> list[dict] | None:
    """Runs of a marked-up title with their styles; entities decoded twice, unknown tags dropped, lone < and > kept."""
    if value is None:
        return None
    text = _DROP.sub("", html.unescape(html.unescape(value)))
    out: list[dict] = []
    stack: list[str] = []

    def add(s: str) -> None:
        s = re.sub(r"\s+", " ", s)
        if not s:
            return
        styles = sorted(set(stack))
        if out and out[-1]["styles"] == styles:
            out[-1]["text"] += s
        else:
            out.append({"text": s, "styles": styles})

    at = 0
    for m in _TAG.finditer(text):
        name = m[2].lower()
        if name not in STYLES and name not in _BLOCKS and name not in ("span", "scp", "a", "u", "jats"):
            continue
        add(text[at : m.start()])
        at = m.end()
        if name in _BLOCKS:
            add(" ")
        elif name in STYLES:
            if m[1]:
                if STYLES[name] in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(STYLES[name])]
            elif not m[3] and len(stack) < DEEPEST:
                stack.append(STYLES[name])
    add(text[at:])
    if out:
        out[0]["text"] = out[0]["text"].lstrip()
        out[-1]["text"] = out[-1]["text"].rstrip()
    return [p for p in out if p["text"]]


def chunks(value: str | None, size: int = 1600) -> list[str] | None:
    """A text in pieces of at most `size` characters, broken after a sentence or at a blank where one lies in the second half."""
    if value is None:
        return None
    out, text = [], value.strip()
    while len(text) > size:
        window = text[: size + 1]
        ends = [m.end() for m in re.finditer(r"[.!?。！？]\s", window)]
        cut = next((e for e in reversed(ends) if e > size // 2), 0) or (window.rfind(" ") if window.rfind(" ") > size // 2 else size)
        out.append(text[:cut].rstrip())
        text = text[cut:].lstrip()
    return [*out, text] if text else out


_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


@F.pandas_udf(PARTS)
def title_parts_udf(s: pd.Series) -> pd.Series:
    return s.map(title_parts)


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks_udf(s: pd.Series) -> pd.Series:
    return s.map(chunks)


@F.pandas_udf(T.StringType())
def decode_escapes(s: pd.Series) -> pd.Series:
    r"""Literal \uXXXX escapes as the characters they name."""
    return s.map(lambda v: None if v is None else _ESCAPE.sub(lambda m: chr(int(m[1], 16)), v).encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def safe_url(c: Column) -> Column:
    """The text if it is an http(s) address without user part or blanks, else null."""
    return F.when(c.rlike(r"^https?://[^\s/@?#]+(?:[/?#][^\s]*)?$"), c)
