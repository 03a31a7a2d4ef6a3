"""Rows that fail to parse: an error-recovering grammar for comma-separated records.

    file    := record*            record := field ("," field)*  anchor
    field   := blanks (quoted | plain) blanks
    quoted  := '"' (character | '""')* '"'      plain := no quote, no comma

The parser descends record -> field -> quoted/plain. A broken quote raises a
located error; parsing then resumes at the next validated record start. Where
the input says where records start (one table row each) those starts are the
anchors; in raw text an anchor is a line break after which a field list of the
right width, or one that starts with a plausible first value, can be read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\u00a0\u3000\u2002\u2003\u2007\u2009\u202f"
ENDS = BLANKS + "\r\n\ufeff"
COLUMNS = ("issn", "journal", "metricYear", "jif", "category", "quartile", "source")
FIRST_YEAR, LAST_YEAR = 1975, 2026
_ISSN = re.compile(r"([0-9]{4})-?([0-9]{3}[0-9Xx])")
_YEAR = re.compile(r"[0-9]{4}")
_PARTS = re.compile(rf"[;,\s{BLANKS}]+")


class Broken(Exception):
    """A quoting error at a character offset of the text."""

    def __init__(self, at: int):
        super().__init__(at)
        self.at = at


@dataclass
class Parsed:
    start: int
    end: int
    fields: list[str] | None
    reason: str | None = None
    at: int | None = None


def _quoted(text: str, k: int, end: int) -> tuple[str, int]:
    opened, out = k, []
    k += 1
    while True:
        close = text.find('"', k, end)
        if close < 0:
            raise Broken(opened)
        out.append(text[k:close])
        if close + 1 < end and text[close + 1] == '"':
            out.append('"')
            k = close + 2
            continue
        return "".join(out), close + 1


def _field(text: str, k: int, end: int, stop: str) -> tuple[str, int]:
    while k < end and text[k] in BLANKS:
        k += 1
    if k < end and text[k] == '"':
        value, k = _quoted(text, k, end)
        while k < end and (text[k] in BLANKS or text[k] == "\r" and text[k + 1 : k + 2] in ("", "\n")):
            k += 1
        if k < end and text[k] not in stop and text[k : end].strip(ENDS):
            raise Broken(k)
        return value.strip(ENDS), k
    first = k
    while k < end and text[k] not in stop:
        if text[k] == '"':
            raise Broken(k)
        k += 1
    return text[first:k].strip(ENDS), k


def _record(text: str, k: int, end: int, stop: str) -> tuple[list[str], int]:
    fields = []
    while True:
        value, k = _field(text, k, end, stop)
        fields.append(value)
        if k < end and text[k] == ",":
            k += 1
            continue
        return fields, k


class RowStarts:
    """Anchors of a text whose records' starts are known: each is valid as it stands, and bounds the record before it."""

    stop = ","

    def __init__(self, text: str, starts: list[int]):
        self.starts, self.ends = starts, [*(s - 1 for s in starts[1:]), len(text)]

    def __iter__(self) -> Iterator[tuple[int, int]]:
        yield from zip(self.starts, self.ends)


class FoundStarts:
    """Anchors of raw text: line breaks after which a record can be read, looked for only where a quote is broken."""

    stop = ",\n"

    def __init__(self, text: str, width: int):
        self.text, self.width, self.last_quote = text, width, text.rfind('"')

    def valid(self, k: int) -> bool:
        """Whether a record can start at k: it is the text's end, or reads as `width` fields, or opens with a value list."""
        text = self.text
        if k >= len(text):
            return True
        line = text[k : (text.find("\n", k) + 1 or len(text) + 1) - 1]
        try:
            # a trial reads one record; past the last quote no quoted value is looked for
            fields, _ = _record(text, k, max(k, self.last_quote + 1) if '"' in line else k + len(line), self.stop)
        except Broken:
            fields = []
        if len(fields) == self.width and (not issn_error(fields[0]) or is_header(fields)):
            return True
        head = line.lstrip(ENDS + '"').split(",", 1)[0].strip(ENDS + '"')
        return bool(head) and not issn_error(head)

    def after(self, k: int) -> int:
        """The line break before the next validated record start after k, or the text's end."""
        nl = self.text.find("\n", k)
        while nl >= 0 and not self.valid(nl + 1):
            nl = self.text.find("\n", nl + 1)
        return len(self.text) if nl < 0 else nl


def _one(text: str, start: int, end: int, stop: str) -> tuple[list[str] | None, int, int | None]:
    """(fields, end, offset of a broken quote) of the record that starts at `start` and ends by `end`."""
    try:
        fields, k = _record(text, start, end, stop)
        if stop == "," and k < end:
            raise Broken(k)
        return fields, k, None
    except Broken as e:
        return None, end, e.at


def records(text: str, width: int = len(COLUMNS), starts: list[int] | None = None) -> Iterator[Parsed]:
    """The records of a text; after a broken quote parsing resumes at the next validated record start.

    Without `starts` those are found in the text itself, so a quote that never
    closes costs its own record only.
    """
    if starts is not None:
        for start, end in RowStarts(text, starts):
            while start < end and text[start] in ENDS:
                start += 1
            while end > start and text[end - 1] in ENDS:
                end -= 1
            fields, end, fault = _one(text, start, end, RowStarts.stop)
            yield Parsed(start, end, fields, None if fault is None else "quoting", fault)
        return
    anchors, n = FoundStarts(text, width), len(text)
    k = 1 if text[:1] == "\ufeff" else 0
    while k < n:
        start = k
        fields, k, fault = _one(text, start, n, FoundStarts.stop)
        if fault is not None:
            k = anchors.after(fault)
            # a quote opened inside the record's first lines may hide a record start before the fault
            k = min(k, anchors.after(start))
        elif len(fields) != width and "\n" in text[start:k].strip(ENDS):
            # a quote that closes only records later: wrong width, and a record starts inside
            nl = anchors.after(start)
            if nl < k:
                fault, fields, k = text.index('"', start), None, nl
        yield Parsed(start, k, fields, None if fault is None else "quoting", fault)
        k += 1


def record(text: str) -> Parsed:
    """One record that is the whole text."""
    return next(records(text, starts=[0]))


def issn_error(value: str) -> bool:
    """True unless the text holds one ISSN or more and each has the right check character."""
    parts = [p for p in _PARTS.split(value) if p]
    for p in parts:
        m = _ISSN.fullmatch(p)
        if not m:
            return True
        s = (m[1] + m[2]).upper()
        if (sum(int(s[i]) * (8 - i) for i in range(7)) + (10 if s[7] == "X" else int(s[7]))) % 11:
            return True
    return not parts


def is_header(fields: list[str]) -> bool:
    return [f.lower() for f in fields] == [c.lower() for c in COLUMNS]


def judge(p: Parsed) -> str | None:
    """The first reason why a record can't be loaded; '' if it is no data record; None if it is valid."""
    if p.fields is None:
        return p.reason
    if not any(p.fields) or is_header(p.fields):
        return ""
    if len(p.fields) != len(COLUMNS):
        return "column_count"
    if issn_error(p.fields[0]):
        return "issn"
    if not (_YEAR.fullmatch(p.fields[2]) and FIRST_YEAR <= int(p.fields[2]) <= LAST_YEAR):
        return "metric_year"
    return None


def _number(s: str) -> float | None:
    return float(s) if re.fullmatch(r"[0-9]+(?:\.[0-9]+)?", s) else None


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        lines = b["_line"].tolist()
        starts = [0, *accumulate(len(x) + 1 for x in lines[:-1])]
        for key, first, p in zip(b["_key"], starts, records("\n".join(lines), starts=starts)):
            why = judge(p)
            if why == "":
                continue
            f = p.fields if why is None else None
            issns = [v.upper() if "-" in v else f"{v[:4]}-{v[4:].upper()}" for v in _PARTS.split(f[0]) if v] if f else None
            out.append((key, why, None if p.at is None else p.at - first, issns, *((f[1], int(f[2]), _number(f[3]), f[4], f[5], f[6]) if f else (None,) * 6)))
        yield pd.DataFrame(out, columns=["_key", "reason", "at", "issn", "journal", "metric_year", "jif", "category", "quartile", "source"])


PARSED = (
    "_key bigint, reason string, at int, issn array<string>, journal string, metric_year int, jif double, "
    "category string, quartile string, source string"
)


def parse_records(df: DataFrame, key: str, line: str) -> DataFrame:
    """Each data record once: `key`, `reason` (null: loaded), `at` (offset of a quoting error) and the typed values.

    Header records, records of blanks and commas only, and null lines are left
    out. A byte-order mark or carriage return at the ends and blanks around a
    value are harmless. Rows equal in key and line count once; other columns of
    df are ignored, so clashing names do no harm. The rows of a batch are read
    as one text whose record starts are known: a broken quote ends with its row.
    No file is gathered in one task, however many rows it has.
    """
    rows = df.select(F.col(key).cast("bigint").alias("_key"), F.col(line).alias("_line")).where(F.col("_line").isNotNull()).distinct()
    return rows.mapInPandas(_parse_batches, PARSED).withColumnRenamed("_key", key)


def recover(df: DataFrame, key: str, line: str, file: str, order: str, block: int = 512) -> DataFrame:
    """(key, reason): each record that can't be loaded, when record starts are not told but found in the files' text.

    Rows are put together to the text of their file, in blocks of `block`
    consecutive numbers, so however long a file is, no task holds more; a block
    begins where a record does. A record counts for the row in which it starts.
    Rows of one number follow one another by key; a row without number or file
    is a text of its own. Repeated rows count once, null lines not at all.
    """
    rows = df.select(F.col(key).cast("bigint").alias("_key"), F.col(line).alias("_line"), F.col(file).alias("_file"), F.col(order).cast("bigint").alias("_no"))
    rows = rows.where(F.col("_line").isNotNull()).distinct()
    alone = F.col("_no").isNull() | F.col("_file").isNull()
    rows = rows.withColumn("_block", F.when(alone, F.concat(F.lit("r"), F.col("_key").cast("string"))).otherwise(F.floor(F.col("_no") / block).cast("string")))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["_no", "_key"])
        lines = b["_line"].tolist()
        starts = [0, *accumulate(len(x) + 1 for x in lines[:-1])]
        found = {}
        for p in records("\n".join(lines)):
            why = judge(p)
            if why:
                found.setdefault(bisect_right(starts, p.start) - 1, why)
        keys = b["_key"].tolist()
        return pd.DataFrame({"_key": [keys[i] for i in found], "reason": list(found.values())}).astype({"_key": "int64", "reason": object})

    return rows.groupBy("_file", "_block").applyInPandas(run, "_key bigint, reason string").withColumnRenamed("_key", key)


def _file_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for path, text in zip(b["path"], b["text"]):
            for n, p in enumerate(records(text), 1):
                why = judge(p)
                if why == "":
                    continue
                out.append((path, n, why, p.start, p.at, p.fields))
        yield pd.DataFrame(out, columns=["path", "record_no", "reason", "start", "at", "fields"])


def parse_files(texts: DataFrame) -> DataFrame:
    """Records of whole files given as (path, text), with anchors found in the text itself."""
    return texts.select("path", "text").where(F.col("text").isNotNull()).mapInPandas(
        _file_batches, "path string, record_no int, reason string, start int, at int, fields array<string>"
    )
