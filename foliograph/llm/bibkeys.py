"""Comparable forms of bibliographic fields: titles, DOIs, years, personal names."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import unquote

from foliograph.llm.confusables import canonical
from foliograph.llm.lexicon import NICKNAMES, PARTICLES, fold, given_names

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,40}>")
_WORD = re.compile(r"[^\W_]+")
_DOI = re.compile(r"10\.\d{4,9}/\S+")
_YEAR = re.compile(r"(?<!\d)(?:1[5-9]|20)\d\d(?!\d)")
#: Words whose absence leaves a title the same to a cataloguer.
STOP = frozenset("a an and at by de der die das des du et for from in into la le les mit of on or the to und via von with y el los las en в b".split())
_GIVEN = frozenset(given_names())


def title_words(title: str | None) -> list[str]:
    """The words of a title, accentless and lower case, without mark-up; all scripts, look-alike letters resolved."""
    if not title:
        return []
    if "<" in title:
        title = _TAG.sub("", title)
    return _WORD.findall(fold(canonical(title) or "").replace("μ", "m"))


@lru_cache(maxsize=1 << 16)
def plain_spelling(w: str) -> str:
    """One form for British and American spellings of a folded word (-ise/-ize, ae/e, our/or, ll/l, re/er)."""
    if w.isascii() and len(w) > 4 and w.isalpha():
        w = w.replace("z", "s").replace("ae", "e").replace("oe", "e").replace("our", "or").replace("ll", "l")
        w = re.sub(r"([bt])re(s?)$", r"\1er\2", w)
    return w


def content(words: list[str]) -> list[str]:
    return [plain_spelling(w) for w in words if w not in STOP]


@lru_cache(maxsize=1 << 14)
def doi(text: str | None) -> str | None:
    if not text:
        return None
    m = _DOI.search(unquote(text).strip().lower())
    return m[0].rstrip(".,;:") if m else None


def years(text: str | None) -> list[int]:
    return [int(y) for y in _YEAR.findall(text or "")]


def close(a: str, b: str, most: int = 2) -> bool:
    """Whether b is a with at most `most` typing slips (insert, drop, replace, swap of neighbours)."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return False
    # cut what is equal at both ends, then a banded optimal-string-alignment distance
    i = 0
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    while la > i and lb > i and a[la - 1] == b[lb - 1]:
        la -= 1
        lb -= 1
    a, b = a[i:la], b[i:lb]
    if max(len(a), len(b)) <= 1:
        return True
    if most == 1:
        return len(a) == len(b) == 2 and a[0] == b[1] and a[1] == b[0]
    before, prev = None, list(range(len(b) + 1))
    for x, ca in enumerate(a, 1):
        row = [x]
        for y, cb in enumerate(b, 1):
            v = min(prev[y] + 1, row[y - 1] + 1, prev[y - 1] + (ca != cb))
            if before is not None and y > 1 and ca == b[y - 2] and a[x - 2] == cb:
                v = min(v, before[y - 2] + 1)
            row.append(v)
        if min(row) > most:
            return False
        before, prev = prev, row
    return prev[-1] <= most


_MARKS = re.compile(r"[\d*†‡§]+$")
_PARTICLE_WORDS = frozenset(w for p in PARTICLES for w in p.split())
_SUFFIX = frozenset(("jr", "sr", "ii", "iii", "iv", "phd", "md"))
#: Words that only names of organisations hold.
ORG = frozenset(
    "group network consortium collaboration foundation institute committee society team association center centre initiative study working research "
    "university college academy council agency department laboratory program programme project alliance society trial investigators registry "
    "net inst fdn assoc grp".split()
)


#: Three words or more of which the last is cut short by a full stop, as in 'Dormont Circuit Cons.'.
_CLIPPED = re.compile(r"[^\W\d_]{3,}(?: [^\W\d_]{3,})+(?: [^\W\d_]{2,5}\.){1,2}| ?[^\W\d_]{3,}(?: [^\W\d_]{2,}\.?)+ (?:Ctr|Cons|Stu|Fdn|Inst|Grp|Net)\.?")


def name_words(text: str | None) -> list[str]:
    return [x for w in (text or "").replace("’", "'").split() if (x := _MARKS.sub("", w.strip(".,;()")))]


@lru_cache(maxsize=1 << 15)
def split_name(first: str | None, last: str | None) -> tuple[str, tuple[str, ...], bool]:
    """(family, given parts, is organisation) of a name as typed in two fields or in one.

    Family is folded without blanks, given parts are folded words or single
    initials in order. 'Jarnemire, Ewa A.', 'Ewa A. Jarnemire', 'JARNEMIRE EA'
    and ('Ewa A.', 'Jarnemire') agree. Which of two words is the family name is
    taken from case, comma, initials and a list of given names.
    """
    first, last = (canonical(first) or "").strip(), (canonical(last) or "").strip()
    if any(fold(w) in ORG for w in name_words(f"{first} {last}")) or not first and _CLIPPED.fullmatch(last):
        return " ".join(fold(w) for w in name_words(f"{first} {last}") if fold(w) not in ("the", "of", "for")), (), True
    if first:
        fam, giv = last, first
        fw, gw = name_words(fam), name_words(giv)
        if len(fw) == 1 and fold(fw[0]) in _GIVEN and gw and fold(gw[0]) not in _GIVEN and len(gw[0].strip(".")) > 2:
            fam, giv = giv, fam
    elif "," in last:
        fam, giv = (x.strip() for x in last.split(",", 1))
    else:
        w = name_words(last)
        if len(w) == 1 or not w:
            fam, giv = last, ""
        elif re.fullmatch(r"[A-ZÀ-ÖØ-ÞŁŠŽ]{1,3}", w[-1]) and not re.fullmatch(r"[A-Z]\.?", w[0]):  # FAMILY AB
            fam, giv = " ".join(w[:-1]), w[-1]
        else:
            k = len(w) - 1
            while k > 1 and fold(w[k]) in _SUFFIX:
                k -= 1
            while k > 1 and fold(w[k - 1]) in _PARTICLE_WORDS:
                k -= 1
            if len(w) == 2 and fold(w[1]) in _GIVEN and fold(w[0]) not in _GIVEN and len(w[0].strip(".")) > 2:
                k = 0
                fam, giv = w[0], w[1]
            else:
                fam, giv = " ".join(w[k:]), " ".join(w[:k])
    parts: list[str] = []
    for g in name_words(giv.replace(".", ". ")):
        if g.isupper() and 1 < len(g) <= 3 and "-" not in g and fold(g) not in _GIVEN:
            parts += [fold(c) for c in g]
        elif fold(g) in _PARTICLE_WORDS:
            fam = f"{g} {fam}"
        else:
            parts.append(fold(g))
    words = [fold(w) for w in name_words(fam)]
    while len(words) > 1 and words[-1] in _SUFFIX:
        words.pop()
    return "".join(words).replace("'", ""), tuple(parts), False


_SHORT: dict[str, frozenset[str]] = {}
for _full, _names in NICKNAMES.items():
    for _n in _names.split():
        _SHORT[_n] = _SHORT.get(_n, frozenset()) | {_full}


def full_forms(given: str) -> frozenset[str]:
    """The given names a word may stand for: itself and those it is short for."""
    return _SHORT.get(given, frozenset()) | {given}
