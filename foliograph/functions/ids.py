"""Identifiers of works, journals and people as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliograph.functions.text import norm


def doi(c: Column) -> Column:
    """The DOI in a text, lower case and without what punctuation adds; null if there is none.

    Percent escapes are decoded (a literal plus stays), a blank after '10.' is
    repaired, and a closing bracket without its opening one is cut.
    """
    decoded = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    repaired = F.regexp_replace(decoded, r"10\. (\d{4,9}/)", "10.$1")
    found = F.regexp_replace(F.lower(F.regexp_extract(repaired, r"10\.\d{4,9}/[^\s\"]+", 0)), r"[.,;:]+$", "")
    opened = F.length(found) - F.length(F.replace(found, F.lit("("), F.lit("")))
    closed = F.length(found) - F.length(F.replace(found, F.lit(")"), F.lit("")))
    found = F.when((closed > opened) & found.endswith(")"), F.substr(found, F.lit(1), F.length(found) - 1)).otherwise(found)
    return F.when(found != "", found)


def issn(c: Column) -> Column:
    """dddd-dddX if the check character is right, else null."""
    s = F.regexp_replace(F.upper(c), "[^0-9X]", "")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.lit(0), lambda t, i: t + F.substr(s, i, F.lit(1)).cast("int") * (9 - i))
    last = F.substr(s, F.lit(8), F.lit(1))
    good = s.rlike("^[0-9]{7}[0-9X]$")
    check = F.when(good, (total + F.when(last == "X", F.lit(10)).otherwise(last.try_cast("int"))) % 11 == 0)
    return F.when(good & check, F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 4)))


def orcid(c: Column) -> Column:
    """dddd-dddd-dddd-dddX if the ISO 7064 mod 11-2 character is right, else null."""
    s = F.regexp_replace(F.upper(F.regexp_replace(F.trim(c), r"(?i)^https?://[^/]+/", "")), "-", "")
    good = s.rlike("^[0-9]{15}[0-9X]$")
    body = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda t, i: (t + F.substr(s, i, F.lit(1)).cast("int")) * 2 % 11)
    code = (12 - body) % 11
    want = F.when(code == 10, F.lit("X")).otherwise(code.cast("string"))
    return F.when(good & F.when(good, F.substr(s, F.lit(16), F.lit(1)) == want), F.concat_ws("-", *[F.substring(s, 1 + 4 * k, 4) for k in range(4)]))


def year(c: Column) -> Column:
    """The first four-digit year from 1500 to 2099 in a text."""
    return F.regexp_extract(c, r"(?:^|[^0-9])((?:1[5-9]|20)[0-9]{2})(?:[^0-9]|$)", 1).try_cast("int")


def identity(doi_col: Column, title: Column, year_col: Column) -> Column:
    """doi:..., or text:title|year where there is no DOI, or null."""
    d = doi(doi_col)
    t = norm(title)
    return F.when(d.isNotNull(), F.concat(F.lit("doi:"), d)).when(F.length(t) > 0, F.concat(F.lit("text:"), t, F.lit("|"), F.coalesce(year(year_col).cast("string"), F.lit(""))))


def author_key(first: Column, last: Column) -> Column:
    """A name's key, only where the given name is spelled out: family and given parts, normalised."""
    full = first.rlike(r"\p{Ll}{2}|\p{IsHan}")
    return F.when(full & last.isNotNull(), F.concat_ws(" ", norm(last), norm(first)))
