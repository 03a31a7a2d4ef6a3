"""Variant spellings of names typed by people, linked by merge-and-rematch resolution.

A profile starts as one stored name: its spelling, its initials, the
identifiers, works and fellow authors it was typed with. Profiles that share a
blocking key and match are merged; the merged profile holds the spellings,
initials, identifiers and fellow authors of both, enters blocking again (its
fellow authors being profiles themselves, they agree more often than before),
and rounds go on until one brings no merge.

Links of the first round rest on identifiers (ORCID, mail address), on an
organisation's whole name, or on one work held in several copies or cited: the
names typed for one place of a work are one person if they are compatible.
Later rounds need fellow authors or an affiliation in common. Never merged are
profiles with different ORCIDs, and two authors of one record, be it directly
or over a third name: where the links of the first round would do so, profiles
join one by one, the best link first, as far as these bounds allow.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from foliograph.llm.bibkeys import close, content, doi, full_forms, split_name, title_words
from foliograph.llm.confusables import canonical
from foliograph.llm.lexicon import fold
from foliograph.session import broadcast_if_few, cut, cut_parts, release, rows_of, trim

#: Short forms of words in names of organisations.
ORG_SHORT = {
    "net": "network", "inst": "institute", "fdn": "foundation", "found": "foundation", "assoc": "association", "grp": "group", "gp": "group", "consort": "consortium",
    "collab": "collaboration", "coll": "collaboration", "ctr": "centre", "cent": "centre", "center": "centre", "soc": "society", "comm": "committee", "univ": "university", "lab": "laboratory", "res": "research", "wg": "working group", "org": "organisation",
}
_ACRONYM = re.compile(r"\s*([A-Z]{2,8})\s*\(([^()]{3,})\)\s*")


def organisation(text: str) -> str:
    """The words of an organisation's name, short forms written out, in the order typed."""
    words = " ".join(ORG_SHORT.get(w, w) for w in text.split()).split()
    return " ".join(w for w in words if w != "group" or len(words) < 3)


def parse(first: str | None, last: str | None) -> tuple[str, list[str], str]:
    """(family or organisation, given parts, kind) with kind 'p' person, 'o' organisation, 'a' acronym of one with its place."""
    one = " ".join(x for x in (first, last) if x)
    m = _ACRONYM.fullmatch(canonical(one) or "")
    if m:
        return fold(m[1]), [fold(m[2])], "a"
    fam, giv, org = split_name(first, last)
    return (organisation(fam), [], "o") if org else (fam, list(giv), "p")


def _shortened(word: str, most: int) -> set[str]:
    """A word with up to so many letters left out."""
    out = {word}
    for _ in range(most):
        out |= {w[:k] + w[k + 1 :] for w in out for k in range(len(w))}
    return out


def _flat(fam: str) -> str:
    return fam.replace("oe", "o").replace("ue", "u").replace("ae", "a")


def name_keys(fam: str, giv: list[str], kind: str) -> list[str]:
    """Keys for names at large: any two families or organisations that `compatible` accepts have one in common.

    A slip is undone by leaving out one letter on either side, so families
    within two slips agree once two letters are left out.
    """
    if kind == "a":
        return sorted({f"o:{''.join(sorted(x))}:{giv[0]}" for x in (fam, fam.removesuffix("g"))})
    if kind == "o":
        w = fam.split()
        letters = "".join(sorted(x[0] for x in w))
        keys = {f"o:{letters}:{x}" for x in w}  # meets acronyms only
        for k, x in enumerate(w):
            rest = " ".join(sorted(w[:k] + w[k + 1 :]))
            keys |= {f"r:{rest}|{h}" for h in (*half_keys(x), x[:3])}
        return sorted(keys)
    if not fam:
        return []
    keys = _shortened(fam, 1 if len(fam) < 7 else 2)
    for part in fam.split("-") if "-" in fam else []:
        if len(part) > 3:
            keys |= _shortened(part, 1)
    return sorted(keys | {f"u:{_flat(fam)}"})


def half_keys(word: str) -> list[str]:
    """Beginnings and ends, of which two words within one slip have one in common."""
    out = set()
    for n in (len(word), len(word) - 1):  # the shorter word's length counts
        p = max(0, n - 1) // 2
        q = max(0, n - 1) - p
        out |= {f"{n}<{word[:p]}", f"{n}>{word[len(word) - q :]}"}
    return sorted(out)


@lru_cache(maxsize=1 << 16)
def _given_level(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """0 incompatible, 1 one side unknown, 2 initials agree, 3 whole given names agree (short forms and slips allowed)."""
    if not a or not b:
        return 1
    x, y = a[0].replace("-", ""), b[0].replace("-", "")
    if len(x) == 1 or len(y) == 1:
        heads = {f[0] for f in full_forms(a[0])} & {f[0] for f in full_forms(b[0])}
        level = 2 if heads else 0
        parts_x, parts_y = a[0].split("-"), b[0].split("-")
        if level and len(parts_x) == 2 and len(b) > 1 and len(b[1]) == 1 and parts_x[1][0] != b[1][0] and len(a) == 1:
            level = 0  # Jun-Wei against J. B.
        if level and len(parts_y) == 2 and len(a) > 1 and len(a[1]) == 1 and parts_y[1][0] != a[1][0] and len(b) == 1:
            level = 0
    else:
        same = x == y or full_forms(a[0]) & full_forms(b[0]) or close(x, y, 1 if min(len(x), len(y)) < 7 else 2)
        if not same and len(a) > 1 and len(b[0].split("-")) == 2 and a[0] + a[1] == y or len(b) > 1 and b[0] + b[1] == x:
            return 3
        level = 3 if same else 0
    if not level and len(a) == len(b) == 2 and a[0][0] == b[1][0] and a[1][0] == b[0][0] and (len(a[1]) == 1 or len(b[1]) == 1):
        return 2  # given and middle name swapped
    if level and len(a) > 1 and len(b) > 1 and "-" not in a[0] + b[0] and a[1][0] != b[1][0]:
        return 0  # middle initials differ
    return level


@lru_cache(maxsize=1 << 16)
def _families(a: str, b: str) -> int:
    """0 different, 1 one slip or a part of a double name, 2 equal."""
    if a == b:
        return 2
    if not a or not b:
        return 0
    if close(a, b, 1 if min(len(a), len(b)) < 7 else 2):
        return 1
    if "-" in a or "-" in b:
        x, y = a.split("-"), b.split("-")
        if any(close(p, q, 1) for p in x for q in y if min(len(p), len(q)) > 3):
            return 1
    return 1 if _flat(a) == _flat(b) else 0


def _organisations(a: str, b: str) -> int:
    """2: the same words; 1: all but one are the same and that one is cut short or has a slip; 0: other."""
    x, y = sorted(a.split()), sorted(b.split())
    if x == y:
        return 2
    slip = _slip(a, b)
    return 1 if slip else 0


@lru_cache(maxsize=1 << 14)
def _slip(a: str, b: str) -> tuple[str, str] | None:
    """The one word in which two organisations' names differ by being cut short or by a slip."""
    x, y = Counter(a.split()), Counter(b.split())
    one, other = list((x - y).elements()), list((y - x).elements())
    if len(one) != 1 or len(other) != 1:
        return None
    v, w = sorted((one[0], other[0]), key=len)
    if len(v) > 2 and (w.startswith(v) or close(v, w, 1)):
        return one[0], other[0]
    return None


def compatible(a: tuple[str, tuple[str, ...], str], b: tuple[str, tuple[str, ...], str]) -> int:
    """How well two spellings agree: 0 not at all; family 1 or 2 plus given level 1 to 3; organisations 4 or 5."""
    (fa, ga, ka), (fb, gb, kb) = a, b
    if ka == "p" and kb == "p":
        f = _families(fa, fb)
        if f and (g := _given_level(ga, gb)):
            return f + g
        if ga and gb and len(ga[0]) > 2 and len(gb[0]) > 1 and (fa == gb[0] or close(fa, gb[0], 1)) and (fb == ga[0] or close(fb, ga[0], 1)):
            return 4
        return 0
    if ka == "o" and kb == "o":
        o = _organisations(fa, fb)
        return o and o + 3
    if "a" in (ka, kb) and "p" not in (ka, kb):
        if ka == kb:
            return 5 if fa == fb and ga == gb else 0
        short, place, full = (fa, ga[0], fb) if ka == "a" else (fb, gb[0], fa)
        w = full.split()
        letters = sorted(x[0] for x in w)
        return 5 if letters in (sorted(short), sorted(short.removesuffix("g"))) and any(close(x, place, 1) for x in w) else 0
    return 0


SPELLING = "struct<fam:string,giv:array<string>,kind:string>"


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for n, f, l in zip(b["n"], b["first_name"], b["last_name"]):
            fam, giv, kind = parse(f, l)
            rows.append((n, fam, giv, kind, name_keys(fam, giv, kind) if kind != "p" else []))
        yield pd.DataFrame(rows, columns=["n", "fam", "giv", "kind", "keys"])


@lru_cache(maxsize=1 << 16)
def _parts(given: str) -> tuple[str, ...]:
    return tuple(given.split())


@F.pandas_udf(T.IntegerType())
def _fit(fa: pd.Series, ga: pd.Series, ka: pd.Series, fb: pd.Series, gb: pd.Series, kb: pd.Series) -> pd.Series:
    return pd.Series([compatible((f, _parts(g), k), (h, _parts(i), m)) for f, g, k, h, i, m in zip(fa, ga, ka, fb, gb, kb)], dtype="int32")


def _agree(sx: set[tuple], sy: set[tuple]) -> int:
    """The best agreement of any spelling of one profile with any of the other."""
    full_x = {s[1] for s in sx if s[2] == "p" and s[1] and len(s[1][0]) > 2}
    full_y = {s[1] for s in sy if s[2] == "p" and s[1] and len(s[1][0]) > 2}
    best = max((compatible(p, q) for p in sx for q in sy), default=0)
    # whole given names on both sides, none of which agree: two people who share initials
    if best and full_x and full_y and not any(_given_level(p, q) for p in full_x for q in full_y) and not any(p[0] == s[0] for p in full_x for s in sy) and not any(q[0] == s[0] for q in full_y for s in sx):
        return 0
    return best


def _spellings(x) -> set[tuple]:
    return {(s["fam"], tuple(s["giv"]), s["kind"]) for s in x}


@F.pandas_udf(T.StructType([T.StructField("v", T.StringType()), T.StructField("w", T.StringType())]))
def _slips(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The words of a slip (not of a word cut short) between two organisations' names, null if there is none."""
    out = []
    for x, y in zip(a, b):
        s = _slip(x, y)
        out.append((None, None) if s is None or s[0].startswith(s[1]) or s[1].startswith(s[0]) else s)
    return pd.DataFrame(out, columns=["v", "w"])


@F.pandas_udf(T.IntegerType())
def _best(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_agree(_spellings(x), _spellings(y)) for x, y in zip(a, b)], dtype="int32")


def _gather(b: pd.DataFrame) -> pd.DataFrame:
    """Of a pair that merges and the profiles whose best match is one of the two: who may join, the best first, each compared with all that joined before."""
    b = b.sort_values(["score", "label"], ascending=[False, True])
    inside, spelled, orcid = [], set(), None
    for label, fit, s, o, apart in zip(b["label"], b["fit"], b["s"], b["o"], b["apart"]):
        s = _spellings(s)
        if fit >= 0 and (o and orcid and o != orcid or apart is not None and not set(inside).isdisjoint(apart) or _agree(spelled, s) < fit):
            continue
        inside.append(label)
        spelled |= s
        orcid = orcid or o
    return pd.DataFrame({"label": inside, "to": min(inside)})


#: Words of a title's beginning and end that place it in a reference typed as one text.
WINDOW = 5
_DIGEST = T.ArrayType(T.LongType())


def _digest(text: str) -> int:
    return xxh3_64_intdigest(text) - (1 << 63)


@F.pandas_udf(T.StructType([T.StructField("keys", _DIGEST), T.StructField("ends", _DIGEST)]))
def _title_keys(title: pd.Series, d: pd.Series, raw: pd.Series) -> pd.DataFrame:
    """Digests of DOI and whole title, and of the title's first and last words."""
    keys, ends = [], []
    for t, x, r in zip(title, d, raw):
        k = [_digest(f"d:{v}") for v in {doi(x), doi(r) if r and "10." in r else None} if v]
        e = None
        if t:
            w = content(title_words(t))
            whole = "".join(w)
            if len(whole) >= 12:
                k.append(_digest(f"t:{whole}"))
            if len(w) > WINDOW:
                e = [_digest(" ".join(w[:WINDOW])), _digest(" ".join(w[-WINDOW:]))]
        keys.append(k)
        ends.append(e)
    return pd.DataFrame({"keys": keys, "ends": ends})


@F.pandas_udf(_DIGEST)
def _windows(raw: pd.Series) -> pd.Series:
    """Digests of every run of as many words of a text."""
    out = []
    for t in raw:
        w = content(title_words(t))
        out.append([_digest(" ".join(w[k : k + WINDOW])) for k in range(len(w) - WINDOW + 1)])
    return pd.Series(out)


@F.pandas_udf(_DIGEST)
def _family_digests(fam: pd.Series) -> pd.Series:
    return pd.Series([[_digest(k) for k in name_keys(f, [], "p")] for f in fam])


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_families(x, y) > 0 for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(_DIGEST)
def _half_digests(fam: pd.Series, given: pd.Series) -> pd.Series:
    return pd.Series([[_digest(f"{x}|{y}") for x in half_keys(f) for y in half_keys(g)] for f, g in zip(fam, given)])


@F.pandas_udf(T.BooleanType())
def _crossed(fa: pd.Series, ga: pd.Series, fb: pd.Series, gb: pd.Series) -> pd.Series:
    return pd.Series([close(f, i, 1) and close(h, g, 1) for f, g, h, i in zip(fa, ga, fb, gb)], dtype=bool)


def _person_keys(shape: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, own, near), keys of profiles: of two profiles with names whose families agree, or that agree with family and given name swapped, one has a key in `own` that the other has in `own` or `near`.

    Distinct families are compared once, not under every fellow author. A family
    is a key of itself and is `near` for the families that agree with it and are
    typed less often: the keys of the many stay few. Keys of 32 bits may coincide,
    which adds pairs to compare and loses none.
    """
    own = shape.where("s.kind = 'p' AND s.fam <> ''").select("n", F.col("s.fam").alias("fam"), F.get("s.giv", F.lit(0)).alias("g"))
    own = cut(own.join(labels, "n").select("label", "fam", "g").distinct())
    fams = own.groupBy("fam").agg(F.count(F.lit(1)).alias("w"))
    forms = fams.select("fam", "w", F.explode(_family_digests("fam")).alias("form"))
    met = F.collect_list(F.struct("w", "fam")).over(Window.partitionBy("form"))
    both = forms.withColumn("met", met).where("size(met) > 1").select("fam", "w", F.explode("met").alias("x")).where("(w, fam) > (x.w, x.fam)").select("fam", F.col("x.fam").alias("rare")).distinct()
    near = both.where(_near("fam", "rare")).groupBy(F.col("rare").alias("fam")).agg(F.collect_list(F.hash("fam")).alias("near"))
    keyed = own.select("label", "fam").distinct().join(near, "fam", "left").select("label", F.hash("fam").alias("own"), "near")
    spelled = own.where("length(g) > 1").select("fam", "g").distinct()
    sides = [spelled.select(F.col("fam").alias(f"f{c}"), F.col("g").alias(f"g{c}"), F.explode(_half_digests(*order)).alias("half")) for c, order in (("a", ("fam", "g")), ("b", ("g", "fam")))]
    swap = sides[0].join(sides[1], "half").where("greatest(length(ga), length(gb)) > 2 AND (fa, ga) < (fb, gb)").select("fa", "ga", "fb", "gb").distinct()
    swap = cut(swap.where(_crossed("fa", "ga", "fb", "gb")).withColumn("key", F.hash("fa", "ga", F.lit("swap"))))
    swap_keys = swap.select(F.col("fa").alias("fam"), F.col("ga").alias("g"), "key").unionByName(swap.select(F.col("fb").alias("fam"), F.col("gb").alias("g"), "key")).distinct()
    keyed = keyed.unionByName(own.join(swap_keys, ["fam", "g"]).select("label", F.col("key").alias("own"), F.lit(None).cast("array<int>").alias("near")))
    keyed = keyed.groupBy("label").agg(F.collect_set("own").alias("own"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    keyed = cut(keyed.select("label", "own", F.array_except("near", "own").alias("near")))
    release(own, swap)
    return keyed


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, label): the least node reachable from each node.

    In each round a node that has a smaller neighbour goes over to the least one,
    and by pointer jumps to the end of the way that one goes; the edges left
    between different ends are the next round's, so rounds get smaller.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    steps = []
    while rows_of(e):
        step = e.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("label"))
        while True:
            was, up = step, step.select(F.col("n").alias("label"), F.col("label").alias("up"))
            step = cut(step.join(up, "label", "left").select("n", F.coalesce("up", "label").alias("label"), F.col("up").isNotNull().alias("went")))
            release(was)
            if step.where("went").isEmpty():
                break
        steps.append(step)
        ta, tb = (steps[-1].select(F.col("n").alias(c), F.col("label").alias(f"t{c}")) for c in "ab")
        rest = e.join(ta, "a", "left").join(tb, "b").select(F.coalesce("ta", "a").alias("ta"), "tb").where("ta <> tb")
        was, e = e, cut(rest.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        release(was)
    labels = None
    for step in reversed(steps):
        if labels is None:
            labels = step.select("n", "label")
        else:  # ends take part in later rounds, and no node that went over does
            later = labels.select(F.col("n").alias("label"), F.col("label").alias("up"))
            labels = step.join(later, "label", "left").select("n", F.coalesce("up", "label").alias("label")).unionByName(labels)
    labels = nodes.select("n", F.col("n").alias("label")) if labels is None else nodes.join(labels, "n", "left").select("n", F.coalesce("label", "n").alias("label"))
    labels = cut(labels)
    release(e, *steps)
    trim(nodes.sparkSession)
    return labels


def _works(papers: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, work) of papers, copies joined by DOI or title, and (n, work) of cited lead authors."""
    p = cut(papers.select("item", _title_keys("title", "doi", F.lit(None).cast("string")).alias("k")).select("item", "k.keys", "k.ends").distinct())
    keys = p.select("item", F.explode("keys").alias("key"))
    first = keys.groupBy("key").agg(F.min("item").alias("b"))
    pairs = keys.join(first, "key").select(F.col("item").alias("a"), "b")
    same = components(p.select(F.col("item").alias("n")).distinct(), pairs)
    work = same.select(F.col("n").alias("item"), F.col("label").alias("work"))
    of_key = keys.join(work, "item").select("key", "work").distinct()
    bare = F.when(F.col("doi").isNull(), F.col("raw"))
    r = refs.select("n", _title_keys("title", "doi", bare).alias("k"), F.when(F.col("title").isNull(), F.col("raw")).alias("raw"))
    r = r.select("n", "k.keys", F.coalesce("k.ends", F.when(F.col("raw").isNotNull(), _windows("raw"))).alias("runs"))
    r = cut(r)
    cited = r.select("n", F.explode("keys").alias("key")).join(of_key, "key").select("n", "work")
    # both ends of a title stand in the reference's title or, where none was parsed, in its text; many titles
    # begin or end alike, so the ends found in a reference meet those of works as pairs
    ends = p.where("ends IS NOT NULL").join(work, "item").groupBy("work").agg(F.collect_set(F.col("ends")[0]).alias("starts"), F.collect_set(F.col("ends")[1]).alias("stops"))
    is_end = ends.select(F.explode("starts").alias("key"), F.lit(True).alias("first")).unionByName(ends.select(F.explode("stops").alias("key"), F.lit(False).alias("first"))).distinct()
    paired = lambda df, c: df.select(c, F.explode("starts").alias("start"), "stops").select(c, "start", F.explode("stops").alias("stop")).select(c, F.xxhash64("start", "stop").alias("both"))
    found = r.select("n", F.explode("runs").alias("key")).join(is_end, "key").groupBy("n")
    found = found.agg(F.collect_set(F.when(F.col("first"), F.col("key"))).alias("starts"), F.collect_set(F.when(~F.col("first"), F.col("key"))).alias("stops"))
    placed = paired(found, "n").join(paired(ends, "work"), "both").select("n", "work")
    work._written = same._written
    return work, cited.unionByName(placed)


def resolve(names: DataFrame, papers: DataFrame, refs: DataFrame, use_orcid: bool = True) -> DataFrame:
    """(n, entity): one row per stored name; names of one entity share `entity`, the least of its ids.

    names: name_id, first_name, last_name. papers: item_id, title, doi,
    creators (name_id, orcid, affiliations, email). refs: author_name_id,
    title, doi, raw. Repeated rows count once; null ids are ignored; a name
    without words or evidence stays alone. Equal spelling alone links nothing.
    """
    spelled = names.where(F.col("name_id").isNotNull()).select(F.col("name_id").cast("bigint").alias("n"), "first_name", "last_name").distinct()
    spelled = spelled.mapInPandas(_parse_batches, "n bigint, fam string, giv array<string>, kind string, keys array<string>")
    spelled = cut(spelled)
    held = papers.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item"), "title", "doi", "creators")
    occ = held.select("item", F.posexplode("creators").alias("pos", "c")).select("item", "pos", F.col("c.name_id").cast("bigint").alias("n"), F.col("c.orcid").alias("orcid"), F.col("c.email").alias("email"), F.col("c.affiliations").alias("affs"))
    occ = cut(occ.where(F.col("n").isNotNull()))
    cites = refs.where(F.col("author_name_id").isNotNull()).select(F.col("author_name_id").cast("bigint").alias("n"), "title", "doi", "raw")
    work, cited = _works(held.select("item", "title", "doi"), cites)
    slots = cut(occ.join(work, "item").select("n", "work", "pos").unionByName(cited.select("n", "work", F.lit(0).alias("pos"))).distinct())

    # identifiers
    orcid = F.upper(F.regexp_extract("orcid", r"(\d{4}-?\d{4}-?\d{4}-?\d{3}[\dXx])", 1))
    ids = occ.select("n", F.regexp_replace(orcid, "-", "").alias("orcid"), F.lower(F.trim("email")).alias("email"))
    orcids = cut(ids.where(F.length("orcid") == 16).select("n", "orcid").distinct()) if use_orcid else cut(ids.select("n", "orcid").limit(0))
    marks = orcids.select("n", F.concat(F.lit("o"), "orcid").alias("key")).unionByName(ids.where(F.length("email") > 3).select("n", F.concat(F.lit("e"), "email").alias("key"))).distinct()
    by_id = marks.join(marks.groupBy("key").agg(F.min("n").alias("b")), "key").select(F.col("n").alias("a"), "b")

    # one work, one place: compatible names
    shape = spelled.select("n", F.struct("fam", "giv", "kind").alias("s"), F.when(F.col("kind") != "p", F.transform("keys", lambda k: F.xxhash64(k))).alias("keys"))
    typed = spelled.select("n", "fam", F.array_join("giv", " ").alias("giv"), "kind")
    placed = slots.join(typed, "n").repartition("work").groupBy("work", F.col("pos").cast("short").alias("pos"), "fam", "giv", "kind").agg(F.min("n").alias("n"), F.collect_set("n").alias("all"))
    placed = cut(placed.groupBy("work").agg(F.collect_list(F.struct("n", "pos", "fam", "giv", "kind", "all")).alias("names")))
    # one spelling at one place is one person, however many names were typed so; spellings are compared once
    stars = placed.select(F.explode("names").alias("x")).where("size(x.all) > 1 AND x.fam <> ''").select(F.explode("x.all").alias("a"), F.col("x.n").alias("b"), F.lit(5).alias("fit")).where("a <> b")
    near = _alike(placed.select(F.transform("names", lambda x: x.dropFields("all")).alias("names")))
    agreed = near.unionByName(stars).groupBy("a", "b").agg(F.max("fit").alias("fit"))
    held_in = cut(occ.select("n", "item").distinct())
    agreed = alike = cut(agreed)
    agreed = agreed.join(_share(agreed, held_in.select(F.col("n").alias("label"), "item")), ["a", "b"], "left_anti")

    # an organisation is its name
    named = _same_organisations(shape)

    strong = by_id.withColumn("fit", F.lit(9)).unionByName(agreed.select("a", "b", "fit")).unionByName(named.withColumn("fit", F.lit(5)))
    strong = cut(_without_conflicts(strong, orcids))
    labels = _bounded_components(spelled.select("n").distinct(), strong, orcids, held_in)
    release(placed, alike, strong, work)

    affil = occ.select("n", F.explode("affs").alias("aff")).select("n", _affiliation(F.col("aff")).alias("aff")).where(F.length("aff") > 5)
    of_name = [slots.select("n", "work"), affil.select("n", F.xxhash64("aff")), held_in.select("n", "item")]
    of_name = reduce(DataFrame.union, [df.toDF("n", "id").withColumn("kind", F.lit(k)) for k, df in enumerate(of_name, 1)])
    held = of_name.join(labels, "n").select("label", "id", "kind").distinct().union(labels.select("label", "n", F.lit(0)))
    state = State(*cut_parts(held, "kind", 4), _person_keys(shape, labels))
    release(slots, held_in, occ, labels)
    while True:
        state, merged = _rematch(state, shape, orcids)
        trim(names.sparkSession)
        if not merged:
            break
    release(orcids, spelled, state.keys, state.active)
    return state.labels.select("n", F.col("label").alias("entity"))


def _pairs(df: DataFrame, by: str, of: str) -> DataFrame:
    """(a, b), a < b, of values of `of` that share `by`."""
    return df.select(by, F.col(of).alias("a")).join(df.select(by, F.col(of).alias("b")), by).where("a < b").select("a", "b")


def _alike(slots: DataFrame) -> DataFrame:
    """(a, b, fit) of names that share a slot (one row: names) and agree well enough: 2 at one place of it, 4 at any.

    All spellings of a slot meet, as a slip may spoil any letter a key could
    rest on. What `compatible` refuses at any rate is dropped before it runs; a
    slip that swaps neighbours counts twice in a Levenshtein distance.
    """
    both = slots.where("size(names) > 1").select(F.explode("names").alias("x"), "names").select("x", F.explode("names").alias("y")).where("x.n < y.n")
    both = both.select(*[F.col(f"{v}.{c}").alias(f"{c}_{side}") for v, side in ("xa", "yb") for c in ("n", "pos", "fam", "giv", "kind")])
    fa, fb = F.col("fam_a"), F.col("fam_b")
    first = lambda g: F.substring_index(g, " ", 1)
    swapped = (F.length("giv_a") > 0) & (F.length("giv_b") > 0) & (F.levenshtein("fam_a", first("giv_b"), 2) >= 0) & (F.levenshtein("fam_b", first("giv_a"), 2) >= 0)
    slips = F.when(F.least(F.length(fa), F.length(fb)) < 7, F.levenshtein(fa, fb, 2)).otherwise(F.levenshtein(fa, fb, 4)) >= 0
    flat = lambda f: F.replace(F.replace(F.replace(f, F.lit("oe"), F.lit("o")), F.lit("ue"), F.lit("u")), F.lit("ae"), F.lit("a"))
    like = slips | fa.contains("-") | fb.contains("-") | swapped | (flat(fa) == flat(fb))
    people = (F.col("kind_a") == "p") & (F.col("kind_b") == "p")
    both = both.where(people & like | (F.col("kind_a") != "p") & (F.col("kind_b") != "p"))
    both = both.withColumn("fit", _fit("fam_a", "giv_a", "kind_a", "fam_b", "giv_b", "kind_b"))
    return both.where((F.col("fit") >= 4) | (F.col("fit") >= 2) & (F.col("pos_a") == F.col("pos_b"))).select(F.col("n_a").alias("a"), F.col("n_b").alias("b"), "fit")


def _same_organisations(shape: DataFrame) -> DataFrame:
    """(a, b): names of one organisation.

    Spellings are compared once, however many names were typed so. Of two words
    that differ by a slip the rarer is taken for a slip of the other only if it
    is much rarer: two places that are both named often are two places.
    """
    orgs = shape.where("s.kind <> 'p'").select("n", "s", "keys")
    # group by the whole spelling: its id is the least name typed so
    spelled = cut(orgs.groupBy("s").agg(F.min("n").alias("rep"), F.first("keys").alias("keys"), F.collect_set("n").alias("all")))
    stars = spelled.select(F.explode("all").alias("a"), F.col("rep").alias("b")).where("a <> b")
    keyed = spelled.select("rep", F.col("s.kind").alias("kind"), F.explode("keys").alias("key"))
    pairs = _pairs(keyed.where("kind = 'o'"), "key", "rep").unionByName(
        keyed.where("kind = 'a'").select("key", F.col("rep").alias("a")).join(keyed.select("key", F.col("rep").alias("b")), "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    x, y = (spelled.select(F.col("rep").alias(c), F.col("s.fam").alias(f"f{c}"), F.array_join("s.giv", " ").alias(f"g{c}"), F.col("s.kind").alias(f"k{c}")) for c in "ab")
    fit = pairs.distinct().join(x, "a").join(y, "b").withColumn("fit", _fit("fa", "ga", "ka", "fb", "gb", "kb")).where("fit >= 4")
    slip = F.when((F.col("ka") == "o") & (F.col("kb") == "o"), _slips("fa", "fb"))
    fit = cut(fit.select("a", "b", slip.alias("slip")).select("a", "b", "slip.v", "slip.w"))
    counts = orgs.where("s.kind = 'o'").select(F.explode(F.array_distinct(F.split("s.fam", " "))).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    slips = fit.where("v IS NOT NULL").join(counts, "v").join(counts.select(F.col("v").alias("w"), F.col("c").alias("d")), "w")
    sure = slips.where((F.least("c", "d") == 1) | (F.least("c", "d") * 5 <= F.greatest("c", "d"))).select("a", "b")
    return fit.where("v IS NULL").select("a", "b").unionByName(sure).unionByName(stars)


def _share(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b) of the pairs that hold a record in common, looked up for the side with fewer records."""
    n = items.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    both = pairs.select("a", "b").distinct().join(n.select(F.col("label").alias("a"), F.col("c").alias("ca")), "a").join(n.select(F.col("label").alias("b"), F.col("c").alias("cb")), "b")
    few = both.select("a", "b", F.when(F.col("ca") <= F.col("cb"), F.col("a")).otherwise(F.col("b")).alias("label"), F.when(F.col("ca") <= F.col("cb"), F.col("b")).otherwise(F.col("a")).alias("other"))
    rows = few.join(items, "label").select("a", "b", F.col("other").alias("label"), "item")
    return rows.join(items, ["label", "item"], "left_semi").select("a", "b").distinct()


def _bounded_components(nodes: DataFrame, edges: DataFrame, orcids: DataFrame, items: DataFrame) -> DataFrame:
    """(n, label): components of edges (a, b, fit), none with two ORCIDs or two authors of one record.

    A component that would break a bound is built up instead: in each round
    every profile names its best link that breaks none, profiles that name
    each other merge, and so do all that name the same one of these, if together
    they keep the bounds.
    """
    labels = components(nodes, edges)
    held = items.join(labels, "n")
    split = held.groupBy("label", "item").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("label")
    split = split.unionByName(orcids.join(labels, "n").groupBy("label").agg(F.countDistinct("orcid").alias("c")).where("c > 1").select("label")).distinct()
    split = cut(split)
    if not rows_of(split):
        release(split)
        return labels
    inside = cut(labels.join(split, "label", "left_semi").select("n"))
    e = cut(edges.join(inside.select(F.col("n").alias("a")), "a", "left_semi"))
    mine = inside.withColumn("label", F.col("n"))
    own_items, own_ids = cut(items.join(inside, "n", "left_semi")), cut(orcids.join(inside, "n", "left_semi"))
    while True:
        la, lb = (mine.select(F.col("n").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        link = e.join(la, "a").join(lb, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"), "fit").groupBy("a", "b").agg(F.max("fit").alias("fit"))
        link = met = cut(link)
        its = own_items.join(mine, "n").select("label", "item").distinct()
        ids = own_ids.join(mine, "n").select("label", "orcid").distinct()
        link = link.join(_share(link, its), ["a", "b"], "left_anti")
        o = ids.groupBy("label").agg(F.min("orcid").alias("o"))
        link = link.join(o.select(F.col("label").alias("a"), F.col("o").alias("oa")), "a", "left").join(o.select(F.col("label").alias("b"), F.col("o").alias("ob")), "b", "left").where("oa IS NULL OR ob IS NULL OR oa = ob")
        rank = F.struct("fit", F.xxhash64("a", "b").alias("draw"), F.col("a").alias("x"), F.col("b").alias("y"))
        both = link.select("a", "b", rank.alias("rank")).unionByName(link.select(F.col("b").alias("a"), F.col("a").alias("b"), rank.alias("rank")))
        best = cut(both.groupBy("a").agg(F.max_by("b", "rank").alias("b")))
        mutual = cut(best.join(best.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).where("a < b"))
        if not rows_of(mutual):
            out = cut(labels.join(inside, "n", "left_anti").unionByName(mine))
            release(labels, split, inside, e, mine, own_items, own_ids, met, best, mutual)
            return out
        # a pair and all that name its first member: merged if their ORCIDs and records allow it, else the pair alone
        star = mutual.select(F.col("a").alias("hub"), F.explode(F.array("a", "b")).alias("label")).unionByName(best.join(mutual.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").where("a <> c").select(F.col("b").alias("hub"), F.col("a").alias("label")))
        star = cut(star)
        broken = star.join(its, "label").groupBy("hub", "item").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("hub")
        broken = broken.unionByName(star.join(ids, "label").groupBy("hub").agg(F.countDistinct("orcid").alias("c")).where("c > 1").select("hub")).distinct()
        to = star.join(broken, "hub", "left_anti").unionByName(mutual.join(broken.select(F.col("hub").alias("a")), "a", "left_semi").select(F.col("a").alias("hub"), F.col("b").alias("label")))
        was = mine
        mine = cut(mine.join(to.where("hub <> label"), "label", "left").select("n", F.coalesce("hub", "label").alias("label")))
        release(was, met, best, mutual, star)
        trim(nodes.sparkSession)


def _without_conflicts(edges: DataFrame, orcids: DataFrame) -> DataFrame:
    """Edges but those between names of different ORCIDs."""
    o = orcids.groupBy("n").agg(F.min("orcid").alias("o"))
    e = edges.join(o.select(F.col("n").alias("a"), F.col("o").alias("oa")), "a", "left").join(o.select(F.col("n").alias("b"), F.col("o").alias("ob")), "b", "left")
    return e.where("oa IS NULL OR ob IS NULL OR oa = ob").select("a", "b", "fit").distinct()


def _affiliation(aff: Column) -> Column:
    """The institution of an affiliation (its last part), in one spelling."""
    last = F.element_at(F.split(F.lower(aff), ","), -1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"\bunivs?\b\.?", "university"), r"\binst\b\.?", "institute"), r"[^\p{L}]+", " "))


#: Weight of a common affiliation against common fellow authors.
AFFILIATION = 1.5


@dataclass
class State:
    """What rounds hand on: ids that profiles hold (of names, works, affiliations and records, by kind and apart), their keys, and whom the next round looks at (None: all)."""

    held: DataFrame
    parts: list[DataFrame]
    keys: DataFrame
    active: DataFrame | None = None

    def __post_init__(self) -> None:
        self.labels, self.on, self.affil, self.items = (df.withColumnRenamed("id", c) for df, c in zip(self.parts, ("n", "work", "aff", "item")))


def _met(keys: DataFrame, fellow: DataFrame, affil: DataFrame) -> DataFrame:
    """(a, b, common), a < b: profiles, at least one of them active, with a fellow author or an affiliation in common and families that agree.

    keys: label, own, near, active. Rows go to their fellow author with all keys,
    and are set against each other by key only there; an affiliation, which very
    many may share, is split by key before.
    """
    who = F.struct("label", "active").alias("who")
    by_fellow = fellow.join(keys, "label").select(F.col("fellow").alias("block"), F.col("fellow").alias("tie"), F.lit(False).alias("aff"), who, "own", "near")
    at = affil.join(keys, "label").select(F.xxhash64("aff").alias("tie"), who, "own", "near")
    none = F.array().cast("array<int>")
    by_affil = [at.select(F.explode(c).alias("key"), "tie", "who").select(F.xxhash64("tie", "key").alias("block"), "tie", F.lit(True).alias("aff"), "who", *[(F.array("key") if c == side else none).alias(side) for side in ("own", "near")]) for c in ("own", "near")]
    rows = by_fellow.unionByName(by_affil[0]).unionByName(by_affil[1]).repartition("block")
    sides = F.concat(F.transform("own", lambda k: F.struct(k.alias("key"), F.lit(True).alias("mine"))), F.transform("near", lambda k: F.struct(k.alias("key"), F.lit(False).alias("mine"))))
    rows = rows.select("block", "tie", "aff", "who", F.explode(sides).alias("k")).select("block", "tie", "aff", "who", "k.key", "k.mine")
    met = F.collect_list("who").over(Window.partitionBy("block", "tie", "aff", "key"))
    pair = rows.withColumn("met", met).where("mine AND size(met) > 1").select("block", "tie", "aff", F.col("who").alias("x"), F.explode("met").alias("y"))
    pair = pair.where("(x.active OR y.active) AND x.label <> y.label")
    pair = pair.select("block", "tie", "aff", F.least("x.label", "y.label").alias("a"), F.greatest("x.label", "y.label").alias("b")).distinct()
    pair = pair.select("a", "b", "tie", "aff").repartition("a", "b").distinct()
    return pair.groupBy("a", "b").agg(F.sum(F.when(F.col("aff"), AFFILIATION).otherwise(1.0)).alias("common"))


def _rematch(st: State, shape: DataFrame, orcids: DataFrame) -> tuple[State, bool]:
    """One round: merged profiles are blocked again and each joins its best match; False if no two merge.

    Two profiles that are each other's best match merge, and those whose best
    match is one of the two join them where identifiers, records and spellings
    of all that joined allow it.

    After the first round only pairs can be new in which one side was merged,
    has a merged fellow author, or was put off for a better match.
    """
    on, who = st.on, st.active if st.active is None else broadcast_if_few(st.active)
    # fellow authors as profiles; a profile's fellows are counted once however many works they share
    if who is None:
        by_work = on.repartition("work")  # one exchange serves both sides
        half = cut(by_work.join(by_work.select("work", F.col("label").alias("fellow")), "work").where("label < fellow").select("label", "fellow").distinct())
        fellow = theirs = half.unionByName(half.select(F.col("fellow").alias("label"), F.col("label").alias("fellow")))
        affil, keys = st.affil, st.keys.withColumn("active", F.lit(True))
    else:
        half = fellow = cut(on.join(who, "label", "left_semi").join(on.select(F.col("label").alias("fellow"), "work"), "work").where("label <> fellow").select("label", "fellow").distinct())
        # all that have a fellow author or an affiliation of the active ones, which are among them
        via = on.join(fellow.select(F.col("fellow").alias("label")).distinct(), "label", "left_semi").select(F.col("label").alias("fellow"), "work")
        theirs = on.join(via, "work").where("label <> fellow").select("label", "fellow").distinct()
        affil = st.affil.join(st.affil.join(who, "label", "left_semi").select("aff").distinct(), "aff", "left_semi").distinct()
        keys = st.keys.groupBy("label").agg(*[F.array_distinct(F.flatten(F.collect_list(k))).alias(k) for k in ("own", "near")])
        keys = keys.join(who.withColumn("active", F.lit(True)), "label", "left").withColumn("active", F.coalesce("active", F.lit(False)))
    pair = _met(keys, theirs, affil)
    # never two ORCIDs
    own = cut(orcids.join(st.labels, "n").groupBy("label").agg(F.min("orcid").alias("o")))
    pair = pair.join(own.select(F.col("label").alias("a"), F.col("o").alias("oa")), "a", "left").join(own.select(F.col("label").alias("b"), F.col("o").alias("ob")), "b", "left")
    pair = tied = cut(pair.where("oa IS NULL OR ob IS NULL OR oa = ob").select("a", "b", "common"))
    met = cut(pair.select(F.col("a").alias("label")).unionByName(pair.select(F.col("b").alias("label"))).distinct())
    members = cut(st.labels.join(broadcast_if_few(met), "label", "left_semi"))
    profile = shape.select("n", "s").join(broadcast_if_few(members), "n").groupBy("label").agg(F.collect_set("s").alias("s"))
    profile = cut(profile)
    pair = pair.join(profile.select(F.col("label").alias("a"), F.col("s").alias("sa")), "a").join(profile.select(F.col("label").alias("b"), F.col("s").alias("sb")), "b")
    pair = pair.withColumn("fit", _best("sa", "sb")).select("a", "b", "common", "fit")
    # whole given names need one tie, initials two
    pair = fits = cut(pair.where((F.col("fit") >= 5) & (F.col("common") >= 1) | (F.col("fit") == 4) & (F.col("common") >= 1.5) | (F.col("fit") == 3) & (F.col("common") >= 2.5)))
    # never two authors of one record
    met_fit = cut(fits.select(F.col("a").alias("label")).unionByName(fits.select(F.col("b").alias("label"))).distinct())
    items = cut(st.items.join(broadcast_if_few(met_fit), "label", "left_semi"))
    pair = cut(pair.join(_share(pair, items), ["a", "b"], "left_anti"))
    release(tied, fits, met, members, met_fit)
    score = F.col("common") + 2 * F.col("fit")
    # no two pairs rank alike: equal scores are drawn by a hash, so that of many profiles alike a share merges in each round
    rank = F.struct(score.alias("score"), F.xxhash64("a", "b").alias("draw"), F.col("a").alias("x"), F.col("b").alias("y"), "fit").alias("rank")
    both = pair.select("a", "b", rank).unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"), rank))
    best = cut(both.groupBy("a").agg(F.max_by("b", "rank").alias("b"), F.max("rank").alias("rank")))
    back = best.select(F.col("a").alias("b"), F.col("b").alias("a"))
    mutual = cut(best.select("a", "b").join(back, ["a", "b"]).where("a < b"))
    if not rows_of(mutual):
        release(half, own, profile, items, pair, best, mutual)
        return st, False
    # profiles whose best match merges join it in the same round
    core = mutual.select("a", F.col("a").alias("hub")).unionByName(mutual.select(F.col("b").alias("a"), F.col("a").alias("hub")))
    more = best.join(core.select("a"), "a", "left_anti").join(core.select(F.col("a").alias("b"), "hub"), "b")
    more = cut(more.select("hub", F.col("a").alias("label"), "rank.score", "rank.fit"))
    joined = mutual.select(F.col("b").alias("label"), F.col("a").alias("to"))
    if rows_of(more):
        among = core.select("hub", F.col("a").alias("label"), F.lit(float("inf")).alias("score"), F.lit(-1).alias("fit")).join(more.select("hub").distinct(), "hub", "left_semi").unionByName(more)
        # who of those that want to join one pair holds a record in common
        rows = among.select("hub", "label").join(items, "label")
        never = rows.select("hub", "item", F.col("label").alias("a")).join(rows.select("hub", "item", F.col("label").alias("b")), ["hub", "item"]).where("a < b").select("a", "b").distinct()
        never = never.select("a", "b").unionByName(never.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("label")).agg(F.collect_list("b").alias("apart"))
        among = among.join(profile, "label").join(own, "label", "left").join(never, "label", "left")
        gathered = among.groupBy("hub").applyInPandas(_gather, "label bigint, to bigint").where("label <> to")
        joined = joined.join(more.select(F.col("hub").alias("to")).distinct(), "to", "left_anti").select("label", "to").unionByName(gathered)
    to = cut(joined)

    step = broadcast_if_few(to)

    def moved(df: DataFrame) -> DataFrame:
        # the few rows that now agree may stay: what is made of them is made distinct
        return df.join(step, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")

    grown = to.select(F.col("to").alias("label"))
    put_off = pair.select(F.explode(F.array("a", "b")).alias("label"))
    near = fellow.join(to.select(F.explode(F.array("to", "label")).alias("fellow")), "fellow", "left_semi").select("label")
    active = cut(moved(put_off.unionByName(near).distinct()).unionByName(grown).distinct())
    new = State(*cut_parts(moved(st.held), "kind", 4), cut(moved(st.keys)), active)
    release(st.held, st.keys, st.active, half, own, profile, items, pair, best, mutual, more, to)
    return new, True


def entity_pairs(entities: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of names of one entity."""
    a = entities.select("entity", F.col("n").alias("name_a"))
    return a.join(entities.select("entity", F.col("n").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b")
