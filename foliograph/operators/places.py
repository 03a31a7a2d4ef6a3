"""Interval and grid joins: positions in texts and on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of a bin of offsets, and of a cell of a page.
BIN, CELL = 256, 32.0


def within(points: DataFrame, spans: DataFrame, by: str, at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Each point with the spans [start, end) that hold it; an equi-join on `by` and bins of offsets, however long a span is."""
    p = points.withColumn("_bin", F.floor(F.col(at) / BIN))
    s = spans.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor((F.col(end) - 1) / BIN))))
    return p.join(s, [by, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def under_pointer(pointers: DataFrame, glyphs: DataFrame, page: str = "page") -> DataFrame:
    """Pointers (page, x, y) with the glyph rectangles (left, top, right, bottom) they lie in, through a grid of cells."""
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / CELL), F.floor(F.col(hi) / CELL))
    g = glyphs.where("right >= left AND bottom >= top").withColumn("_cx", F.explode(cells("left", "right"))).withColumn("_cy", F.explode(cells("top", "bottom")))
    p = pointers.withColumn("_cx", F.floor(F.col("x") / CELL)).withColumn("_cy", F.floor(F.col("y") / CELL))
    return p.join(g, [page, "_cx", "_cy"]).where("x BETWEEN left AND right AND y BETWEEN top AND bottom").drop("_cx", "_cy")
