"""Bibliography entries typed as one text, parsed into fields.

A small grammar of styles: an optional number; authors; the year in brackets,
after a comma, before a volume, or last; title; container with volume, issue
and pages. What follows the authors is split from the right: locator first,
then the container (words with capitals or cut short), the rest is the title.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMBER = regex.compile(r"^\s*(?:\[(\d{1,4})\]|(\d{1,4})\.)\s+")
_DOI = regex.compile(r"(?:doi:?\s*|https?://\S*?/)?\b(10\.\d{4,9}/\S+?)[.,;]?\s*$", regex.I)
_YEAR = r"(?P<year>(?:1[5-9]|20)\d\d)(?P<suffix>[a-z]?)"
_BRACKETED = regex.compile(rf"^(?P<authors>.+?)\s*\({_YEAR}\)[.,]?\s+(?P<rest>.+)$", regex.S)
_COMMA = regex.compile(rf"^(?P<authors>.+?),\s+{_YEAR}[.,]\s+(?P<rest>.+)$", regex.S)
_VANCOUVER = regex.compile(rf"^(?P<rest>.+?)[.,]\s+{_YEAR};(?P<volume>\d+)(?:\((?P<issue>[^)]+)\))?:(?P<pages>[\d–-]+)\.?$", regex.S)
_LAST = regex.compile(rf"^(?P<rest>.+?)\s+\({_YEAR}\)\.?$", regex.S)
_LOCATOR = regex.compile(r"\s+(?P<volume>\d+)(?:\s*\((?P<issue>[^)]+)\))?(?:[:,]\s*(?P<pages>\d+(?:[–-]\d+)?))?\.?$")
_CHAPTER = regex.compile(r"^(?P<title>.+?)[.?]?\s+In:\s+(?P<publisher>.+?)\s+\(Eds?\.\),\s+(?P<journal>.+?)(?:,\s+pp?\.\s*(?P<pages>[\d–-]+))?\.?$", regex.S)
_CONTAINER = regex.compile(r"(?:(?:\p{Lu}[\p{L}’'-]*\.?|&|and|of|in|for|the|de|la|für|der|und|et)(?:,?\s+|$))+")
_NAME_END = regex.compile(r"(?:\.\.\s+|\.\s+)")
_LETTERS = regex.compile(r"^\p{Lu}(?:[.\s-]*\p{Lu})*\.?$")

FIELDS = ("number", "authors", "year", "suffix", "title", "journal", "publisher", "volume", "issue", "pages", "doi", "type")
SCHEMA = "number int, authors array<string>, year int, suffix string, title string, journal string, publisher string, volume string, issue string, pages string, doi string, type string"


def author_list(text: str) -> list[str]:
    """Names of an author list; initials given after a comma stay with their name."""
    out: list[str] = []
    for part in (p.strip() for p in regex.split(r",\s+|;\s+|\s+(?:and|&|et|und|y)\s+", text.strip().rstrip(","))):
        part = regex.sub(r"\s+et al\.*$", "", part).strip()
        if not part or part.lower().startswith("et al"):
            continue
        if out and _LETTERS.match(part) and not regex.search(r"[\s,]\p{Lu}{1,3}$|,", out[-1]):
            out[-1] = f"{out[-1]}, {part}"
        else:
            out.append(part)
    return out


def _split_authors(text: str) -> tuple[str, str]:
    """Authors and the rest where only a full stop parts them."""
    for m in _NAME_END.finditer(text):
        before = text[: m.start()]
        last = before.rsplit(None, 1)[-1] if before.split() else ""
        after = text[m.end() :]
        if m[0].startswith(".."):
            return before + ".", after
        single = len(last.strip(",.")) == 1
        if single and regex.match(r"(?:\p{Lu}\.\s*)*(?:\p{Lu}[\p{L}’'-]+(?:\s\p{Lu}{1,3})?(?:,|\s*$)|\p{Lu}\.|et al|&|and\s|und\s)", after):
            continue
        if len(before.split()) >= 2:
            return before, after
    return "", text


def _split_title(text: str) -> tuple[str, str]:
    """Title and container of what stands before the locator."""
    for m in regex.finditer(r"[.?]\s+", text):
        title, rest = text[: m.start() + (text[m.start()] == "?")], text[m.end() :]
        if len(title.split()) >= 3 and rest and _CONTAINER.fullmatch(rest.strip()):
            return title, rest.strip()
    return text, ""


def parse(raw: str | None) -> dict:
    """The fields of one entry; what is not found is None, an unparsed text has no title."""
    out: dict = dict.fromkeys(FIELDS)
    if not raw or not raw.strip():
        return out
    text = " ".join(regex.sub(r"[­​-‍⁠﻿]", "", raw).split())
    if m := _NUMBER.match(text):
        out["number"], text = int(m[1] or m[2]), text[m.end() :]
    if m := _DOI.search(text):
        out["doi"], text = m[1].lower(), text[: m.start()].strip()
    if (m := _BRACKETED.match(text)) and len(m["authors"]) < 0.7 * len(text):
        authors, rest = m["authors"], m["rest"]
    elif (m := _COMMA.match(text)) and len(m["authors"]) < 0.7 * len(text):
        authors, rest = m["authors"], m["rest"]
    elif m := _VANCOUVER.match(text):
        authors, rest = _split_authors(m["rest"])
        out |= {k: m[k] for k in ("volume", "issue", "pages")}
    elif m := _LAST.match(text):
        authors, rest = _split_authors(m["rest"])
    else:
        return out
    out["authors"], out["year"], out["suffix"] = author_list(authors), int(m["year"]), m["suffix"] or None
    if c := _CHAPTER.match(rest):
        return out | {k: c[k] for k in ("title", "publisher", "journal", "pages")} | {"type": "chapter"}
    if out["volume"] is None and (loc := _LOCATOR.search(rest)):
        out |= {k: loc[k] for k in ("volume", "issue", "pages")}
        rest = rest[: loc.start()]
    title, container = _split_title(rest.rstrip())
    out["title"], out["journal"] = title.strip() or None, container.strip() or None
    out["type"] = "article" if out["volume"] or out["journal"] else "book"
    return out


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [parse(r) for r in b["_raw"]]
        out = pd.DataFrame(rows, columns=list(FIELDS))
        for c in ("number", "year"):
            out[c] = out[c].astype("Int32")
        yield out.assign(_key=b["_key"].to_numpy())


def parse_references(refs: DataFrame, key: str = "ref_id", raw: str = "raw") -> DataFrame:
    """Key and fields of each entry; a row delivered twice counts once, a null text has null fields."""
    slim = refs.select(F.col(key).cast("bigint").alias("_key"), F.col(raw).alias("_raw")).distinct()
    return slim.mapInPandas(_batches, f"{SCHEMA}, _key bigint").withColumnRenamed("_key", key)
