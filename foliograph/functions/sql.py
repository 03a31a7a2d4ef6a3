"""The same functions as DuckDB SQL, for the oracle queries."""

from __future__ import annotations


def clean(x: str) -> str:
    x = f"replace(replace(regexp_replace({x}, '[­​]', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    return f"trim(regexp_replace({x}, '[\\s\\p{{Z}}\\x0b]+', ' ', 'g'))"


def plain_title(x: str) -> str:
    return clean(f"regexp_replace({x}, '</?(?:i|b|em|strong|sub|sup|scp|span|p|br)(?:\\s[^<>]*)?/?>', '', 'g')")


def norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({plain_title(x)})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({norm(x)}, ' '), lambda w: w <> ''))"


def dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0.0 END"


def doi(x: str) -> str:
    d = f"regexp_replace(url_decode(replace({x}, '+', '%2B')), '10\\. (\\d{{4,9}}/)', '10.\\1', 'g')"
    f = f"regexp_replace(lower(regexp_extract({d}, '10\\.\\d{{4,9}}/[^\\s\"]+', 0)), '[.,;:]+$', '')"
    closed = f"(length({f}) - length(replace({f}, ')', '')))"
    opened = f"(length({f}) - length(replace({f}, '(', '')))"
    return f"nullif(CASE WHEN {closed} > {opened} AND {f} LIKE '%)' THEN left({f}, length({f}) - 1) ELSE {f} END, '')"


def year(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '(?:^|[^0-9])((?:1[5-9]|20)[0-9]{{2}})(?:[^0-9]|$)', 1), '') AS INTEGER)"


def identity(d: str, t: str, y: str) -> str:
    return (
        f"CASE WHEN {doi(d)} IS NOT NULL THEN 'doi:' || {doi(d)} WHEN length({norm(t)}) > 0 "
        f"THEN 'text:' || {norm(t)} || '|' || coalesce(CAST({year(y)} AS VARCHAR), '') END"
    )


def issn(x: str) -> str:
    s = f"regexp_replace(upper({x}), '[^0-9X]', '', 'g')"
    total = " + ".join(f"(ascii({s}[{i}]) - 48) * {9 - i}" for i in range(1, 8))
    last = f"CASE WHEN {s}[8] = 'X' THEN 10 ELSE ascii({s}[8]) - 48 END"
    return f"CASE WHEN regexp_full_match({s}, '[0-9]{{7}}[0-9X]') AND ({total} + {last}) % 11 = 0 THEN {s}[1:4] || '-' || {s}[5:8] END"


def orcid(x: str) -> str:
    s = f"replace(upper(regexp_replace(trim({x}), '^(?i)https?://[^/]+/', '')), '-', '')"
    body = "0"
    for i in range(1, 16):
        body = f"(({body} + ascii({{s}}[{i}]) - 48) * 2 % 11)"
    body = body.replace("{s}", "_s")
    return (
        f"(SELECT CASE WHEN regexp_full_match(_s, '[0-9]{{15}}[0-9X]') AND _s[16] = CASE WHEN (12 - {body}) % 11 = 10 THEN 'X' "
        f"ELSE CAST((12 - {body}) % 11 AS VARCHAR) END THEN _s[1:4] || '-' || _s[5:8] || '-' || _s[9:12] || '-' || _s[13:16] END FROM (SELECT {s} AS _s))"
    )


def distinct(table: str, columns: str) -> str:
    return f"(SELECT DISTINCT {columns} FROM {table})"
