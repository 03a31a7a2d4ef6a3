"""Author identities over paper-author signatures, one name block at a time.

Within a block of one full name, rows are tied by identifiers first; evidence
between two rows is scored from mail addresses, affiliations, shared coauthors
and the likeness of subjects. Rows without an ORCID take the best supported one
unless a rival is too close; pairs that both stay without are joined where the
evidence carries. Different ORCIDs never join, nor two rows of one paper.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.functions import ids, text

#: Teams above this size say nothing about who knows whom.
LARGEST_TEAM = 64
#: A row is compared with so many following rows that share a posting with it.
WINDOW = 16
#: Rows are compared with so many ORCIDs of a posting however far apart; a row with more takes no ORCID from evidence.
ANCHORS = 32
PASSES = 3
SCHEMA = "paper string, pos int, author string, identity string"


def signatures(papers: DataFrame) -> DataFrame:
    """(paper, pos, name, orcid, email, affils, team, words, oids), one row per creator with a full name."""
    p = papers.select("id", "title", F.substring("abstract", 1, 1200).alias("abstract"), "creators").distinct()
    words = F.array_distinct(F.regexp_extract_all(text.norm(F.concat_ws(" ", "title", "abstract")), F.lit(r"[\p{L}]{4,}"), F.lit(0)))
    team = F.when(F.size("creators") <= LARGEST_TEAM, F.array_distinct(F.filter(F.transform("creators", lambda c: ids.author_key(c["first_name"], c["last_name"])), lambda k: k.isNotNull()))).otherwise(F.array().cast("array<string>"))
    oids = F.array_distinct(F.filter(F.transform("creators", lambda c: ids.orcid(c["orcid"])), lambda o: o.isNotNull()))
    rows = p.select(F.col("id").alias("paper"), oids.alias("oids"), words.alias("words"), team.alias("team"), F.posexplode("creators").alias("pos", "c"))
    return rows.select(
        "paper", "pos", ids.author_key(F.col("c.first_name"), F.col("c.last_name")).alias("name"), ids.orcid(F.col("c.orcid")).alias("orcid"), F.lower("c.email").alias("email"),
        F.filter(F.transform(F.coalesce("c.affiliations", F.array().cast("array<string>")), text.norm), lambda a: F.length(a) >= 12).alias("affils"), "team", "words", "oids",
    ).where("name IS NOT NULL")


def evidence(a: dict, b: dict, verified: frozenset[str] = frozenset()) -> float:
    """Support for two rows being one person; 0 where no gate opens."""
    if a["paper"] == b["paper"]:
        return 0.0
    if a["orcid"] and b["orcid"]:
        return 100.0 if a["orcid"] == b["orcid"] else 0.0
    shared = (a["team"] & b["team"]) - {a["name"]}
    known = len(shared & verified) + len((a.get("oids", frozenset()) & b.get("oids", frozenset())) - {a["orcid"], b["orcid"]})
    low = min(len(a["words"]), len(b["words"]))
    like = len(a["words"] & b["words"]) / low if low else 0.0
    mail = bool(a["email"]) and a["email"] == b["email"]
    place = bool(a["affils"] & b["affils"])
    if not (mail or (known >= 1 and like >= 0.18) or len(shared) >= 2 or (shared and like >= 0.18) or (place and like >= 0.3)):
        return 0.0
    return 20.0 * mail + 5.0 * place + 3.0 * min(known, 3) + 2.0 * min(len(shared), 6) + min(like, 1.0)


def resolve_block(rows: list[dict], verified: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """(author id, kind of identity) of each row of one name, in the order given."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["paper"], rows[i]["pos"]))
    root = list(range(len(rows)))
    own = {i: ({rows[i]["orcid"]} if rows[i]["orcid"] else set()) for i in order}
    held = {i: {rows[i]["paper"]} for i in order}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> bool:
        i, j = find(i), find(j)
        if i == j:
            return True
        if own[i] and own[j] and own[i] != own[j] or (held[i] & held[j] and not (own[i] and own[i] == own[j])):
            return False
        i, j = min(i, j), max(i, j)
        root[j] = i
        own[i] |= own[j]
        held[i] |= held[j]
        return True

    by_orcid: dict[str, int] = {}
    for i in order:
        if rows[i]["orcid"]:
            join(by_orcid.setdefault(rows[i]["orcid"], i), i)
    postings: dict[tuple, list[int]] = defaultdict(list)
    for i in order:
        r = rows[i]
        for key in sorted([("c", t) for t in r["team"] if t != r["name"]] + [("a", t) for t in r["affils"]] + ([("e", r["email"])] if r["email"] else []) + [("o", t) for t in r.get("oids", ()) if t != r["orcid"]]):
            postings[key].append(i)
    score: dict[tuple[int, int], float] = {}
    for key in sorted(postings):
        p = postings[key]
        for k, i in enumerate(p):
            for j in p[k + 1 : k + 1 + WINDOW]:
                pair = (min(i, j), max(i, j))
                if pair not in score:
                    score[pair] = evidence(rows[i], rows[j], verified)
    incomplete: set[int] = set()
    for key in sorted(postings):
        p = postings[key]
        anchors = list({rows[i]["orcid"]: i for i in p if rows[i]["orcid"]}.values())
        if len(anchors) > ANCHORS:
            incomplete |= set(p)
        for i in p:
            for j in anchors[:ANCHORS]:
                pair = (min(i, j), max(i, j))
                if i != j and pair not in score:
                    score[pair] = evidence(rows[i], rows[j], verified)
    near: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for (i, j), s in score.items():
        if s > 0:
            near[i].append((j, s))
            near[j].append((i, s))
    for _ in range(PASSES):
        moved = False
        for i in order:
            if own[find(i)] or i in incomplete:
                continue
            best: dict[str, float] = {}
            for j, s in near[i]:
                for o in own[find(j)]:
                    best[o] = max(best.get(o, 0.0), s)
            ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))
            if not ranked:
                continue
            top, second = ranked[0][1], ranked[1][1] if len(ranked) > 1 else 0.0
            if second and (top < 6 or top - second < 3 or top < 1.4 * second):
                continue
            # an anchor in direct conflict is not bypassed by support through others
            rival = max((s for j, s in near[i] if rows[j]["orcid"] and rows[j]["orcid"] != ranked[0][0]), default=0.0)
            if rival and (top - rival < 3 or top < 1.4 * rival):
                continue
            moved |= join(by_orcid[ranked[0][0]], i)
        if not moved:
            break
    for (i, j), s in sorted(score.items()):
        if s > 0 and not own[find(i)] and not own[find(j)]:
            join(i, j)
    groups: dict[int, list[int]] = defaultdict(list)
    for i in order:
        groups[find(i)].append(i)
    split = len(by_orcid) > 1 or sum(len(g) > 1 for g in groups.values()) > 1 or len({rows[i]["paper"] for i in order}) < len(order)
    out: list[tuple[str, str]] = [("", "")] * len(rows)
    for g in groups.values():
        first = rows[g[0]]
        orcid = next(iter(own[find(g[0])]), None)
        if orcid:
            ident = (f"author:orcid:{orcid}", "orcid")
        elif not split:
            ident = (f"author:{first['name']}", "name")
        else:
            ident = (f"author:{first['name']}#{first['paper']},{first['pos']}", "coauthor-evidence" if len(g) > 1 else "unresolved")
        for i in g:
            out[i] = ident
    return out


def author_identities(papers: DataFrame) -> DataFrame:
    """(paper, pos, author, identity) of every creator with a full name.

    The rules within a block follow one another, so a block is one task's work;
    blocks are full names, and every comparison is bounded by WINDOW.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [dict(paper=p, pos=int(i), name=n, orcid=o, email=e, affils=frozenset(a), team=frozenset(t), words=frozenset(w), oids=frozenset(v)) for p, i, n, o, e, a, t, w, v in zip(
            pdf["paper"], pdf["pos"], pdf["name"], pdf["orcid"], pdf["email"], pdf["affils"], pdf["team"], pdf["words"], pdf["oids"])]
        got = resolve_block(rows)
        return pd.DataFrame({"paper": pdf["paper"].to_numpy(), "pos": pdf["pos"].to_numpy(), "author": [a for a, _ in got], "identity": [k for _, k in got]})

    return signatures(papers).groupBy("name").applyInPandas(solve, SCHEMA)
