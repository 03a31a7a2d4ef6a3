"""Small fixed word lists about personal names, shared by the name operators."""

from __future__ import annotations

import re
import unicodedata

#: Short forms of given names, in everyday use.
NICKNAMES = {
    "alexander": "alex sasha sandy xander", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny",
    "charles": "charlie chuck", "christopher": "chris kit topher", "daniel": "dan danny", "deborah": "deb debbie debby",
    "dmitri": "dima mitya", "edward": "ed eddie ted ned", "elizabeth": "liz beth betty lisa eliza libby", "frederick": "fred freddie",
    "gabriel": "gabe", "helena": "lena nell", "isabel": "bella izzy", "james": "jim jimmy jamie", "jennifer": "jen jenny",
    "john": "jack johnny", "joseph": "joe joey", "katherine": "kate kathy katie kat", "margaret": "maggie peggy meg margie",
    "matthew": "matt", "michael": "mike mick mikey", "nicholas": "nick nicky", "patricia": "pat patty trish tricia",
    "philip": "phil pip", "rebecca": "becky becca", "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie",
    "samuel": "sam sammy", "stephen": "steve stevie", "susanna": "sue susie suzie", "theodore": "ted theo teddy",
    "thomas": "tom tommy", "victoria": "vicky vicki tori", "william": "bill will billy liam",
}

#: Given names that are no short form.
GIVEN = (
    "ama amina anaïs anil astrid bianca björn chiara chidi elke emil ewa farah freya giulia greta henrik inés ingrid irina jana joana "
    "jürgen kofi leila lotte luca lucía mara marco marek milan ngozi nils noor olga omar oskar paweł pedro petra priya ravi rené rui "
    "sofia sunita sören tomás yusuf zoë an-qi hao-ran hyun-ah jun-wei kai-wen li-na mei-ling min-seo soo-jin tae-ho wen-bo xiao-min "
    "yu-ting zhi-qiang anna maria paul peter martin laura julia david sarah hans karl erik lars ana carlos luis jean pierre marie"
).split()

PARTICLES = ("van der", "van den", "van de", "van", "von der", "von", "de la", "de los", "de las", "del", "de", "di", "da", "dos", "du", "ter", "ten")


def fold(s: str) -> str:
    """Lower case without accents; letters that do not decompose get their usual base."""
    s = s.lower()
    if s.isascii():
        return s
    return _COMBINING.sub("", unicodedata.normalize("NFKD", s)).translate(_BASE)


_COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_BASE = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})


def given_names() -> set[str]:
    """Every listed given name in its usual, accentless, umlaut-expanded and hyphenless spellings, lower case."""
    out = set()
    for n in [*GIVEN, *NICKNAMES, *(x for v in NICKNAMES.values() for x in v.split())]:
        out |= {n, fold(n), fold(n.replace("ö", "oe").replace("ü", "ue").replace("ä", "ae"))}
        if "-" in n:
            out |= {n.replace("-", "")}
    return out
