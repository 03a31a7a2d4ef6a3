"""Visually identical text with different characters, brought to one form.

Each letter run (token) is resolved by scripts: every letter stands for the
set of scripts that have a letter of its look, and the sets are intersected
across the token. A token whose letters are not all of the script found is a
mixed-script confusable and is respelled in that script; a token that several
scripts could spell whole (a whole-script confusable) takes the script of the
nearest token that only one script can spell, Latin if there is none. What
remains is folded by width, ligature, gap, invisible sign and composition.
Case, accents, raised digits, punctuation and spelling stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.session import cut

#: Letters of other scripts with the Latin letter of the same look.
LOOKALIKES = {
    "cyrillic": "А A В B С C Е E Н H І I Ј J К K М M О O Р P Ԛ Q Ѕ S Т T Ѵ V Ԝ W Х X У Y Ԍ G а a с c ԁ d е e һ h і i ј j ӏ l о o р p ԛ q ѕ s ѵ v ԝ w х x у y",
    "greek": "Α A Β B Ε E Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Χ X Υ Y Ζ Z ο o ν v ϳ j",
    "armenian": "Ս U Լ L Տ S Օ O օ o ս u ո n հ h ց g զ q յ j",
    "cherokee": "Ꭰ D Ꭱ R Ꭲ T Ꭺ A Ꭻ J Ꭼ E Ꮃ W Ꮇ M Ꮋ H Ꮍ Y Ꮐ G Ꮓ Z Ꮢ R Ꮤ W Ꮥ S Ꮩ V Ꮪ S Ꮮ L Ꮯ C Ꮲ P Ꮶ K Ᏻ G Ᏼ B",
    "coptic": "Ⲁ A Ⲃ B Ⲉ E Ⲏ H Ⲓ I Ⲕ K Ⲙ M Ⲛ N Ⲟ O Ⲣ P Ⲥ C Ⲧ T Ⲩ Y Ⲭ X Ⲍ Z ⲟ o ⲥ c",
    "lisu": "ꓐ B ꓑ P ꓓ D ꓔ T ꓖ G ꓗ K ꓙ J ꓚ C ꓜ Z ꓝ F ꓟ M ꓠ N ꓡ L ꓢ S ꓣ R ꓦ V ꓧ H ꓪ W ꓫ X ꓬ Y ꓮ A ꓰ E ꓲ I ꓳ O ꓴ U",
}
#: Letters that are told apart when they stand alone, but pass for the Latin letter inside a Latin word.
NEAR_ALIKE = {"greek": "α a γ y ι i κ k ρ p τ t υ u ω w", "cyrillic": "г r к k м m н h т t п n", "armenian": "ա w ռ n ղ n"}
SCRIPTS = ("latin", *LOOKALIKES)
#: Cyrillic letters of the table that no living Slavic alphabet writes; a token that needs one is Latin.
RARE = frozenset("ԁһӏԛԝѵԚԜѴԌ")


def _pairs(line: str) -> list[tuple[str, str]]:
    w = line.split()
    return list(zip(w[::2], w[1::2]))


#: letter -> the letters of its look by script; near look-alikes apart
_LOOK: dict[str, dict[str, str]] = {}
_NEAR: dict[str, dict[str, str]] = {}
for _script, _line in LOOKALIKES.items():
    for _c, _latin in _pairs(_line):
        _LOOK.setdefault(_latin, {"latin": _latin}).setdefault(_script, _c)
for _script, _line in LOOKALIKES.items():
    for _c, _latin in _pairs(_line):
        _LOOK[_c] = {**_LOOK[_latin], _script: _c}
for _script, _line in NEAR_ALIKE.items():
    for _c, _latin in _pairs(_line):
        _NEAR[_c] = {"latin": _latin, _script: _c}


def _fold_table() -> dict[int, str | None]:
    """Width variants, ligatures, gaps and hyphens to their plain form; invisible signs to nothing."""
    table: dict[int, str | None] = {}
    for cp in range(0x80, 0x30000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0x3400 <= cp <= 0x4DBF or 0x4E00 <= cp <= 0x9FFF or 0x20000 <= cp:
            continue
        c = chr(cp)
        d, cat = unicodedata.decomposition(c), unicodedata.category(c)
        if cat == "Zs" or c in "\x85  ":
            table[cp] = " "
        elif cat == "Cf" or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or cat == "Cc":
            table[cp] = None
        elif d.startswith(("<wide>", "<narrow>", "<noBreak>")) or d.startswith("<font>") and cp >= 0x1D400 or d.startswith("<compat>") and (0x2160 <= cp <= 0x217F or 0xFB00 <= cp <= 0xFB06 or 0x132 <= cp <= 0x133 or 0x1C4 <= cp <= 0x1CC or 0x1F1 <= cp <= 0x1F3):
            table[cp] = unicodedata.normalize("NFKC", c)
    table |= {0x2010: "-", 0x2011: "-", 0x261: "g", 0xB5: "μ", 0x2126: "Ω", 0x212A: "K", 0x212B: "Å"}
    table |= {c: None for c in range(32) if c not in (9, 10, 11, 12, 13)} | {127: None}
    for cp in range(0xE0100, 0xE01F0):
        table[cp] = None
    return table


_FOLD = _fold_table()
_FOLDED = frozenset(map(chr, _FOLD))
_OTHER = re.compile("[\u0370-\u058f\u13a0-\u13ff\u1f00-\u1fff\u2c80-\u2cff\ua4d0-\ua4ff]")
_TOKEN = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[̀-ͯ])*")


@lru_cache(maxsize=1 << 12)
def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    return next((s for s in SCRIPTS if name.startswith(s.upper())), "other")


@lru_cache(maxsize=1 << 16)
def _scripts(token: str) -> frozenset[str]:
    """The scripts in which the whole token can be spelled with letters of the same look.

    Letters that only pass for Latin inside a word count where no script has
    all letters otherwise.
    """
    letters = [c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c) and c != "μ"]  # the micro sign belongs to every script
    for near in (False, True):
        sets = set(SCRIPTS) | {"other"}
        for c in letters:
            look = _LOOK.get(c) or (_NEAR.get(c) if near else None)
            sets &= look.keys() if look else {_script(c)}
        if sets:
            break
    return frozenset(sets - {"other"} if letters else SCRIPTS)


@lru_cache(maxsize=1 << 16)
def _spell(token: str, script: str | None) -> str:
    """The token in the letters of `script`; a token that no script can spell keeps its letters but for those of one look with a Latin one."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        look = _LOOK.get(c) or (_NEAR.get(c) if script == "latin" else None)
        out.append(c if look is None else look.get(script) or next(iter(look.values())))
    return unicodedata.normalize("NFC", "".join(out))


def canonical(text: str | None) -> str | None:
    """The one form of all texts that look like this one. Null stays null; applying it twice changes nothing."""
    if text is None:
        return None
    if text.isascii() and text.isprintable():
        return " ".join(text.split())
    if not _FOLDED.isdisjoint(text):
        text = text.translate(_FOLD)
    text = unicodedata.normalize("NFC", text)
    if _OTHER.search(text):
        spans = [(m.start(), m.end(), _scripts(m[0])) for m in _TOKEN.finditer(text)]
        sure = [next(iter(s)) if len(s) == 1 else None for _, _, s in spans]
        near: str | None = None
        context: list[str | None] = []
        for s in sure:
            near = s or near
            context.append(near)
        after: str | None = None
        for i in reversed(range(len(spans))):
            after = sure[i] or after
            context[i] = context[i] or after or "latin"
        out, at = [], 0
        for (a, b, scripts), c in zip(spans, context):
            if not scripts:
                script = None
            elif len(scripts) == 1:
                script = next(iter(scripts))
            else:
                script = c if c in scripts and not (RARE & set(_spell(text[a:b], c))) else next(s for s in SCRIPTS if s in scripts)
            out += [text[at:a], _spell(text[a:b], script)]
            at = b
        text = unicodedata.normalize("NFC", "".join([*out, text[at:]]))
    return " ".join(text.split())


def findings(text: str) -> list[tuple[str, str]]:
    """(token, 'mixed' | 'whole') of each confusable token of a text."""
    out = []
    for m in _TOKEN.finditer(unicodedata.normalize("NFC", text.translate(_FOLD))):
        scripts, letters = _scripts(m[0]), {s for c in unicodedata.normalize("NFD", m[0]) if (s := _script(c)) != "other"}
        if len(letters) > 1:
            out.append((m[0], "mixed"))
        elif len(scripts) > 1 and letters != {"latin"}:
            out.append((m[0], "whole"))
    return out


@F.pandas_udf(T.StringType())
def canonical_udf(s: pd.Series) -> pd.Series:
    return pd.Series([canonical(x) for x in s], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("kind", T.StringType())])))
def findings_udf(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else [{"token": t, "kind": k} for t, k in findings(x)] for x in s])


def canonical_text(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """df with the column `out`: the form of `text` under which all texts of one look are equal."""
    return df.withColumn(out, canonical_udf(F.col(text)))


def _varied(df: DataFrame, key: str, text: str, within: str | None) -> DataFrame:
    """(_k, _f, _f2, _s), one row each: digests of group and form, and of the string, of rows whose form occurs in several spellings.

    Texts are not shuffled; forms with a single spelling, however many rows
    hold it, are gone before anything is joined.
    """
    group = F.col(within) if within else F.lit("")
    slim = df.where(F.col(text).isNotNull() & F.col(key).isNotNull() & group.isNotNull()).select(
        F.col(key).cast("bigint").alias("_k"), group.alias("_g"), F.col(text).alias("_t")
    )
    form = slim.withColumn("_c", canonical_udf("_t"))
    rows = cut(form.select("_k", F.xxhash64("_g", "_c").alias("_f"), F.xxhash64("_c", F.lit(1), "_g").alias("_f2"), F.xxhash64("_t").alias("_s")))
    varied = rows.groupBy("_f", "_f2").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).where("_lo <> _hi").select("_f", "_f2")
    return rows.join(varied, ["_f", "_f2"], "left_semi").distinct()


def look_classes(df: DataFrame, key: str, text: str, within: str | None = None) -> DataFrame:
    """(key, class): each row whose text looks like that of a row spelled otherwise; `class` is the least key of one look (and group).

    A row for each member however large a class is. Null texts, keys and groups
    take no part; a row delivered twice counts once.
    """
    rows = _varied(df, key, text, within)
    least = rows.groupBy("_f", "_f2").agg(F.min("_k").alias("class"))
    return rows.join(least, ["_f", "_f2"]).select(F.col("_k").alias(key), "class").distinct()


def look_alikes(df: DataFrame, key: str, text: str, within: str | None = None) -> DataFrame:
    """(key_a, key_b), key_a < key_b: rows whose texts differ as strings and look the same.

    With `within`, both rows must agree in that column. Null texts (or null
    `within`) match nothing. Rows are compared by digests of group and form
    (128 bits) and of the string. A row delivered twice counts once.
    """
    rows = _varied(df, key, text, within)
    a = rows.select("_f", "_f2", F.col("_s").alias("_sa"), F.col("_k").alias("key_a"))
    b = rows.select("_f", "_f2", F.col("_s").alias("_sb"), F.col("_k").alias("key_b"))
    return a.join(b, ["_f", "_f2"]).where("_sa <> _sb AND key_a < key_b").select("key_a", "key_b")
