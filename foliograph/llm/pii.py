"""Personal information inside free text: found, typed, and replaced by pseudonymous placeholders.

Detection reads a line-unwrapped view of each text (hard line breaks and
end-of-line hyphens of scanned pages are looked through) and maps every hit
back to the original characters. Replacement leaves the rest of the text as it
was. Numbers are format-preserving Feistel pseudonyms: digits and letters are
permuted under a key within their format, punctuation and prefix stay, and
check signs that held are made right again, so a valid number stays valid and
equal values stay linked across documents, however they are punctuated. Dates
can be permuted likewise (an option, as they are no kind of their own). Names,
addresses and mail addresses carry a short keyed digest for the same reason.

A name is recognised by a title, by initials, by a listed given name, or, where
none of these helps, by its shape and what stands around it.
"""

from __future__ import annotations

import hashlib
import hmac
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.lexicon import PARTICLES, fold, given_names

KINDS = ("name", "email", "phone", "id_number", "address")
#: Digits of the longest telephone number without extension.
LONGEST_PHONE = 13


_HYPHENED = regex.compile(r"(?<=[^\W_])-\n(?=[^\W_])")
_SOFT_BREAK = regex.compile(r"(?<=[^\n])\n(?=[^\n])")


class Places:
    """Where each character of a view stands in the text it was made from: `shifts` characters more at and after each of `at`."""

    def __init__(self, at: list[int], shifts: list[int]):
        self.at, self.shifts = at, shifts

    def __getitem__(self, k: int) -> int:
        i = bisect_right(self.at, k)
        return k + (self.shifts[i - 1] if i else 0)


def unwrap(text: str) -> tuple[str, Places | None]:
    """A view of the text without hard line breaks, and each of its characters' place in the text.

    Hyphens at a line's end are joined and a single line break reads as a
    blank; blank lines stay, so nothing found crosses a paragraph.
    """
    if "\n" not in text and "\r" not in text:
        return text, None
    at, shifts, out, k, gone = [], [], [], 0, 0
    for m in _HYPHENED.finditer(text):
        # a hyphen between letters, the second small, only breaks the word; any other belongs to it
        keep = not (text[m.start() - 1].isalpha() and text[m.end()].islower())
        out.append(text[k : m.start() + keep])
        k = m.end()
        gone += 2 - keep
        at.append(k - gone)
        shifts.append(gone)
    out.append(text[k:])
    return _SOFT_BREAK.sub(" ", "".join(out)).replace("\r", " "), Places(at, shifts)


# --- mail addresses -----------------------------------------------------------------------------------------------
_AT = r"(?:[ ]?@[ ]?|[ ]?[\[(]\s?at\s?[\])][ ]?)"
_DOT = r"(?:\.|[ ]?[\[(]\s?dot\s?[\])][ ]?)"
_EMAIL = regex.compile(
    rf"(?<![\w.+-])[\w+-](?:[\w.+%-]*[\w+-])?{_AT}[\p{{L}}\d](?:[\p{{L}}\d-]*[\p{{L}}\d])?(?:{_DOT}[\p{{L}}\d](?:[\p{{L}}\d-]*[\p{{L}}\d])?)*{_DOT}\p{{L}}{{2,24}}(?![\w-])",
    regex.I,
)

_SIGN = regex.compile(_AT, regex.I)


def _emails(v: str) -> Iterator[tuple[int, int]]:
    """Mail addresses, looked for around each sign or word for 'at' only."""
    for m in _SIGN.finditer(v):
        a = m.start()
        while a and (v[a - 1].isalnum() or v[a - 1] in "_.+%-"):
            a -= 1
        if found := _EMAIL.match(v, a):
            yield found.span()


# --- identity numbers ---------------------------------------------------------------------------------------------
_B, _E = r"(?<![\w./:-]|\w[–])", r"(?![\w]|[-–./]\d)"
_ID = regex.compile(
    _B
    + "(?:"
    + "|".join([
        r"\d{4}-\d{4}-\d{4}-\d{3}[\dXx]", r"\d{4} \d{4} \d{4} \d{3}[\dXx]", r"\d{15}[\dXx]",  # researcher
        r"[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3}(?: ?\d\d)?",  # social security, 13 digits and a key
        r"\p{Lu}{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",  # account, told by its check digits
        r"(?!000|666)\d{3}-(?!00)\d\d-(?!0000)\d{4}", r"(?!000|666)\d{3} (?!00)\d\d (?!0000)\d{4}",  # social security, 3-2-4
        r"\p{Lu}{2} ?\d\d ?\d\d ?\d\d ?[A-D]",  # national insurance
        r"\d\d \d{3} \d{3} \d{3}", r"\d{11}",  # tax
        r"\p{Lu}\d{7}\p{Lu}\d", r"\p{Lu}\p{Lu}?\d{7}[A-Z]?", r"\p{Lu}\d{8}", r"\d\d\p{Lu}\p{Lu}\d{5}",  # card, passport
        r"\d\d\.?\d{3}\.?\d{3}[- ]?\p{Lu}", r"[XYZ]-?\d{7}-?\p{Lu}", r"\p{Lu}[A-Z0-9]{2}\d{6}", 
    ])
    + ")"
    + _E
)

# --- telephone numbers --------------------------------------------------------------------------------------------
_EXT = r"(?P<ext>[ ,]{0,2}(?:ext\.?|x|extension|poste|Durchwahl)[ ]?\d{1,5})?"
_PHONE = regex.compile(
    r"(?<![\w.:–-])(?:(?=\+)|(?<!\d[ /]))(?:"
    + "|".join([
        r"(?:\+|\(\+|00)[1-9]\d{0,2}\)?(?:[ ./-]?\(0\))?(?:[ ./-]?\(?\d{1,12}\)?){1,6}",  # international
        r"(?:1[ .-])?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}", r"(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}", r"[2-9]\d\d-\d{4}",  # 3-3-4
        r"\(0\d{1,5}\)[ ./-]?\d{2,}(?:[ ./-]?\d{2,}){0,4}", r"0(?!00)\d{1,5}(?:[ ./-]\d{2,8}){1,4}", r"0(?!00)\d{9,10}",  # national
        r"[6-9]\d\d[ .-]\d{3}[ .-]\d{3}", r"[6-9]\d\d(?:[ .-]\d\d){3}",  # nine digits
    ])
    + ")"
    + _EXT
    + r"(?![\w]|[-–]\d|\.\d|[ ]?%)"
)
#: Stretches that may hold a number of seven digits or more.
_NUMBERISH = regex.compile(r"[(+]*\d[\d ()+./-]{5,}")
_CUED = regex.compile(
    r"(?:\b(?:tel|tél|phone|telephone|téléphone|teléfono|telefon|fax|mobil|mobile|móvil|call|cell|handy)\b\.?[ ]?:?[ ]{0,2})(?P<n>[+(]?\d[\d ()./-]{4,20}\d)(?![\w])", regex.I
)

# --- addresses ----------------------------------------------------------------------------------------------------
_CAP = r"\p{Lu}[\p{L}’'-]+"
_TOWN = r"\p{Lu}\p{Ll}[\p{L}’'-]*"
_EN_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Drive|Dr|Court|Ct|Square|Sq|Way|Terrace|Place|Pl|Crescent|Boulevard|Blvd|Row|Gardens|Hill|Park|Grove|Walk|Mews)\b\.?"
_ADDRESS = [
    regex.compile(rf"(?<![\w-])(?:P\.?[ ]?O\.?[ ]?Box|P\.?O\.?[ ]?BOX|PO[ ]Box|Post[ ][Oo]ffice[ ]Box|Postfach|B\.?P\.?|[Bb]oîte[ ]postale|Apartado(?:[ ]de[ ][Cc]orreos)?|Apdo\.?(?:[ ]de[ ][Cc]orreos)?)[ ](?:n[.º°o]+[ ]?)?\d+(?:[ ]\d+)*(?:,[ ](?:(?:\p{{Lu}}-)?\d{{4,5}}[ ])?{_TOWN}(?:[ ]Cedex)?)?"),
    regex.compile(
        rf"(?<![\w.,-])(?:(?:Flat|Apt\.?|Apartment|Suite|Unit|Room)[ ]\d+[A-Za-z]?,[ ]|)\d{{1,4}}[A-Za-z]?,?[ ]{_CAP}(?:[ ]{_CAP})?[ ]{_EN_STREET}"
        rf"(?:,[ ](?:Flat|Apt\.?|Apartment|Suite|Unit)[ ]\d+[A-Za-z]?)?(?:,[ ]{_TOWN})?(?:,?[ ](?:\p{{Lu}}{{1,2}}\d{{1,2}}[A-Z]?[ ]\d\p{{Lu}}{{2}}|\p{{Lu}}{{2}}[ ]\d{{5}}(?:-\d{{4}})?))?"
    ),
    regex.compile(
        rf"(?<![\w-])(?:\p{{Lu}}\p{{L}}+(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm|steig|pfad|chaussee)|(?:Am|An der|Im|Auf der|Zum|Zur)[ ]{_CAP}|{_CAP}[ ](?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee))"
        rf"[ ]\d{{1,4}}[ ]?[a-z]?\b(?:,[ ](?:D-|A-|CH-)?\d{{4,5}}[ ]{_TOWN})?"
    ),
    regex.compile(
        rf"(?<![\w-])\d{{1,4}}(?:[ ]?(?:bis|ter|[A-Za-z]))?,?[ ](?:[Rr]ue|[Aa]venue|[Aa]v\.?|[Bb]d\.?|[Bb]oul\.?|[Bb]oulevard|[Cc]hemin|[Pp]lace|[Pp]l\.?|[Aa]llée|[Ii]mpasse|[Qq]uai|[Rr]oute|[Cc]ours|[Ss]quare|[Pp]assage|[Ss]entier|[Rr]te\.?)[ ](?:(?:de la|de l’|de l'|du|des|de|d’|d')[ ]?)?{_CAP}(?:[ ]{_CAP})?"
        rf"(?:,[ ](?:F-)?\d{{5}}[ ]{_TOWN}(?:[ ]Cedex)?)?"
    ),
    regex.compile(
        rf"(?<![\w-])(?:Calle|C/|C\.|Avenida|Avda\.?|Av\.|Paseo|P\.º|Pº|Plaza|Pza\.?|Camino|Ronda|Travesía|Carretera|Ctra\.?|Glorieta)[ ]?(?:(?:de la|de los|de las|del|de)[ ])?{_CAP}(?:[ ]{_CAP})?,?[ ](?:n[.º°]+[ ]?)?(?:\d{{1,4}}[A-Za-z]?|s/n)\b"
        rf"(?:,[ ]\d{{1,2}}[.]?[ºª°](?:[ ]?\p{{Lu}}\b|[ ](?:izq|dcha)\b\.?)?)?(?:,[ ](?:\d{{5}}[ ])?{_TOWN})?"
    ),
]

# --- names --------------------------------------------------------------------------------------------------------
_GIVEN = given_names()
_PART = "(?:" + "|".join(regex.escape(p) for p in PARTICLES) + ")"
_SUR = rf"(?:{_PART}[ ])?(?:Mc|Mac|O['’])?\p{{Lu}}[\p{{Ll}}’']+(?:-\p{{Lu}}[\p{{Ll}}]+)*"
_SURUP = rf"(?:(?:{_PART}|{_PART.upper()})[ ])?(?:Mc|O['’])?\p{{Lu}}[\p{{Lu}}’']+(?:-\p{{Lu}}+)*"
_SURLOW = rf"(?:{_PART}[ ])?\p{{Ll}}[\p{{Ll}}’']+(?:-\p{{Ll}}+)*"
_INI = r"\p{Lu}\.(?:[ -]?\p{Lu}\.){0,3}"
_TITLE = r"(?:(?:Dr|Prof|Pr|Mr|Mrs|Ms|Sr|Sra|Srta|Dra|Dres|Mme|Mlle|Ing|Dipl|Profs|PD)\b\.?|(?:Professor|Professeur|Profesora?|Doctora?|Docteur|Doktor|Herrn?|Frau|Madame|Monsieur|Mademoiselle|Señora?|Señorita|Don|Doña|Sir|Dame|Miss)\b)"
_L = r"(?<![\p{L}\d@_’'-]|[\p{L}\d]\.)"
_R = r"(?![\p{L}\d@_]|[-’']\p{L}|\.\p{L}{2})"
_G = r"(?P<g>\L<given>)"
_MID = r"(?:[ ](?:\p{Lu}\.[ -]?)*\p{Lu}\.(?=[ ]))?"
_TITLED = regex.compile(
    rf"{_L}(?:{_TITLE}[ ]{{1,2}})+(?:(?:et|und|y|and|&)[ ])?(?P<n>(?:(?:{_INI}|\p{{L}}[\p{{L}}-]+)[ ]?)??(?:(?:\p{{L}}\.[ -]?)+)?(?:{_SURUP}|{_SUR}|{_SURLOW}))(?P<rest>(?:,[ ]{_INI})?){_R}"
)
_WORD = r"\p{L}+(?:-\p{L}+)*"
#: A listed given name (checked by its caller) with what follows it.
_FULL = regex.compile(rf"{_L}(?P<n>(?P<g>{_WORD})(?P<g2>[ ]{_WORD}(?=[ ]))?{_MID}(?:[ ]\p{{Lu}}(?=[ ]))?[ ](?P<s>{_SURUP}|{_SUR}|{_SURLOW})){_R}", regex.I)
_FULL1 = regex.compile(rf"{_L}(?P<n>(?P<g>{_WORD}){_MID}(?:[ ]\p{{Lu}}(?=[ ]))?[ ](?P<s>{_SURUP}|{_SUR}|{_SURLOW})){_R}", regex.I)
_BEFORE_COMMA = regex.compile(rf"{_L}(?P<s>{_SURUP}|{_SUR}|{_SURLOW}),[ ]", regex.I)
_AFTER_COMMA = regex.compile(rf"{_WORD}(?:[ ](?:\p{{Lu}}\.[ -]?)+)?{_R}", regex.I)
#: Two or three capitalised words that may be a name no list knows.
_SHAPED = regex.compile(rf"{_L}(?P<n>(?P<g>\p{{Lu}}\p{{Ll}}+(?:-\p{{L}}\p{{Ll}}+)*)(?:[ ](?P<m>\p{{Lu}}\.))?[ ](?P<s>{_SUR}|{_SURUP})){_R}")
_SHAPED_REVERSED = regex.compile(rf"{_L}(?P<n>(?P<s>{_SURUP}|{_SUR}),[ ](?P<g>\p{{Lu}}\p{{Ll}}+(?:-\p{{L}}\p{{Ll}}+)*)(?:[ ](?P<m>\p{{Lu}}\.))?){_R}")
_INITIALS = regex.compile(rf"(?<![\p{{L}}\d@_’'.-]|\p{{Lu}}\.[ ])(?P<n>{_INI}[ ]?(?:{_SURUP}|{_SUR})){_R}")
_TRAILING = regex.compile(rf"{_L}(?P<n>(?:{_SURUP}|{_SUR}),[ ]{_INI})(?![\p{{L}}\d@_])")
#: Capitalised words that follow or stand before an initial without being a surname.
_NO_SURNAME = {
    "box", "the", "this", "that", "these", "data", "figure", "see", "table", "no", "cat", "and", "but", "for", "slides", "please", "correspondence",
    "signed", "cordialement", "saludos", "grüßen", "grussen", "sincerely", "regards", "yours", "salutations", "atentamente", "thanks", "best", "hello", "dear", "merci",
    "danke", "gracias", "bonjour", "hola", "hallo", "reprints", "address", "phone", "fax", "call", "write", "contact", "send", "signed", "reviewer", "strain", "reads", "image", "recordings",
}
_STOP = {"und", "and", "et", "y", "was", "is", "are", "has", "the", "a", "of", "in", "wrote", "schrieb", "escribió", "last", "about", "for", "at", "on", "to", "les", "sont", "llegaron", "liegen", "den", "die", "das", "der", "von", "zu", "que", "con", "por", "para"}


def _case(s: str) -> str:
    letters = [c for c in s if c.isalpha()]
    if letters and all(c.isupper() for c in letters):
        return "u"
    return "l" if letters and all(c.islower() for c in letters) else "c"


_WORDS = regex.compile(r"\p{L}+(?:-\p{L}+)*")
#: Words of the closed classes of the four languages, weekdays and months; none begins or ends a name.
_CLOSED = frozenset(
    "a an the this that these those my our your his her its their we you he she it they i who which what when where why how and or but if as at by for from in of on to "
    "with not no all any some each every both many most more other such only also then than so as is are was were be been has have had do does did will would can could may "
    "der die das den dem des ein eine einen einem einer eines kein keine wir ihr sie er es ich und oder aber wenn als an auf aus bei bis durch für gegen in mit nach ohne seit "
    "über um unter von vor während zu zum zur im am vom beim nicht alle diese dieser dieses jede jeder welche welcher welches was wie wo warum ist sind war waren wird werden hat haben siehe anders "
    "le la les un une des du de ce cet cette ces mon notre votre leur nous vous il elle ils elles je et ou mais si dans sur sous avec pour par sans chez est sont était étaient "
    "el los las un una unos unas este esta estos estas mi nuestro su nosotros ellos y o pero si en con por para sin sobre es son era eran no se lo al del "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember".split()
)
#: Words of institutions, places, publications and salutations.
_NOT_PERSONAL = frozenset(
    "university college institute hospital school department laboratory center centre foundation society association journal press street road avenue company council "
    "committee group network consortium academy agency ministry museum library clinic city county state states kingdom republic river lake mount north south east west new saint "
    "universität institut klinik schule abteilung gesellschaft verlag université hôpital école laboratoire société universidad instituto escuela departamento laboratorio sociedad "
    "figure fig table section chapter appendix supplementary volume issue page review letters reports annals archives proceedings advances international national european american "
    "dear sincerely regards yours kind best hello signed telephone telefon phone fax mail email".split()
)
#: What stands before a person's name; a colon, dash or bullet may stand between.
_CUES = frozenset(
    "by thank thanks dear ask contact author authors reviewer reviewers editor signed sincerely regards correspondence colleague supervisor student professor named called met met-with investigator "
    "von danken dank gez gutachten gutachter korrespondenz liebe lieber herr herrn frau grüßen autor fragen "
    "par remercions remercie demander auteur relecture correspondance cher chère copie signé "
    "por agradecemos autor revisado correspondencia estimado estimada preguntar firmado saludos atentamente "
    "attn cc re from with to an à con a mit".split()
)
#: Cues too common to carry a name by themselves.
_WEAK_CUES = frozenset("from with to an à con a mit re von".split())
#: What stands after a person's name.
_SAYS = frozenset("wrote writes said says agreed asked replied reported suggested explained noted argues claims told called who whose schrieb sagt sagte meint fragte écrit dit demande escribió dice dijo pregunta".split())
_LEFT_WORDS = regex.compile(r"(\p{L}+)[\s.:;,—–*(-]*$")
_RIGHT_WORD = regex.compile(r"[\s,]*(?:a |has |have |hat |ha )?(\p{L}+)")
_ONLY_TITLE = regex.compile(_TITLE)


def _shape_score(v: str, m: regex.Match, small: frozenset[str], named_ends: set[int], german: bool) -> int:
    """Evidence that capitalised words are a person's name: 2 and more carries it, 3 in German, where all nouns are capitalised."""
    g, s = m["g"], m["s"]
    words = [w.lower() for w in _WORDS.findall(f"{g} {s}")]
    if len(s) < 3 or s.isupper() and len(s) < 4 or any(w in _CLOSED and w not in _PART_WORDS or w in _NOT_PERSONAL for w in words) or _ONLY_TITLE.fullmatch(g) or _ONLY_TITLE.fullmatch(s) or fold(s) in _NO_SURNAME or fold(g) in _NO_SURNAME:
        return -9
    a, b = m.span("n")
    left, right = v[max(0, a - 40) : a], v[b : b + 40]
    score = -2 * sum(w in small for w in words)
    after = _RIGHT_WORD.match(right)
    if regex.match(r"[ ]\p{Lu}\p{Ll}", right) or regex.search(r"\p{Lu}[\p{L}-]+[ ]$", left) and not _cue(left):
        score -= 2  # part of a longer run of capitalised words
    cue = _cue(left)
    if cue:
        score += 1 if cue in _WEAK_CUES else 3
    if regex.search(r"(?:^|\n|[—*•(]\s?)$", left) and regex.match(r"\s*(?:$|\n|[,;)<—]|\(|[.]?\s*(?:Tel|Fax|Phone|E-?mail))", right):
        score += 2  # a signature, a list entry, brackets
    if regex.match(r"\s*[<(\[,;:—-]*\s*[\w.+-]+\s?(?:@|[\[(]\s?at)", right):
        score += 3  # a mail address follows
    if after and after[1].lower() in _SAYS:
        score += 3
    if m["m"]:
        score += 2  # an initial between
    joined = regex.search(r"(?:,|;|&|\b(?:and|or|et|und|y|e|ou|oder)\b)[ ]$", left)
    if joined and any(a - len(joined[0]) - 2 <= e <= a for e in named_ends):
        score += 3  # listed after another name
    if german and score == 2:
        score = 1 if not cue or cue in _WEAK_CUES else 2
    return score


def _cue(left: str) -> str | None:
    m = _LEFT_WORDS.search(left)
    return m[1].lower() if m and m[1].lower() in _CUES and "." not in m[0].removeprefix(m[1])[1:] else None


_PART_WORDS = frozenset(w for p in PARTICLES for w in p.split())
_GERMAN = frozenset("der die das und ist nicht mit eine wurde wurden".split())


def _names(v: str, given: frozenset[str] = frozenset(_GIVEN)) -> Iterator[tuple[int, int]]:
    # words are looked up in the list one by one; patterns run only where a listed name stands
    words = [(m.start(), m.end(), m[0]) for m in _WORDS.finditer(v)]
    small = {w for _, _, w in words if w.islower()}
    german = len(_GERMAN & small) >= 3
    titled: set[int] = set()
    for m in _TITLED.finditer(v):
        n = m["n"]
        last = n.split()[-1]
        if fold(last) in _STOP or fold(last) in _NO_SURNAME:
            continue
        parts = n.split()
        titled.add(m.start("n"))
        # without a listed given name or initial before it only the first word is sure to be the surname
        if len(parts) > 1 and parts[0][-1] != "." and fold(parts[0]) not in given and not any(n.startswith(p + " ") for p in PARTICLES):
            w = last.lower()
            both = not german and last[0].isupper() and w not in small and w not in _CLOSED and w not in _NOT_PERSONAL and not regex.match(r"[.:]", v[m.end("n") :])
            yield m.start("n"), m.end("n") if both else m.start("n") + len(parts[0])
        else:
            yield m.start("n"), m.end("rest")
    ends: set[int] = set()
    reach = -1
    for k, (a, b, g) in enumerate(words):
        if g.lower() not in given:
            continue
        if a >= reach and (m := _given_first(v, a, given)):
            reach = m.end("n")
            ends.add(m.end("n"))
            yield m.start("n"), m.end("n")
        if v[a - 2 : a] == ", " and (span := _family_first(v, a, words, k)):
            ends.add(span[1])
            yield span
    for m in _INITIALS.finditer(v):
        last = regex.split(r"[. ]", m["n"])[-1]
        if fold(last) not in _NO_SURNAME and len(last) > 2:
            ends.add(m.end("n"))
            yield m.start("n"), m.end("n")
    if regex.search(r",[ ]\p{Lu}\.", v):
        for m in _TRAILING.finditer(v):
            if fold(m["n"].split(",")[0]) not in _NO_SURNAME:
                ends.add(m.end("n"))
                yield m.start("n"), m.end("n")
    for pattern in (_SHAPED, _SHAPED_REVERSED):
        at = 0
        while m := pattern.search(v, at):
            if m.start("n") not in titled and _shape_score(v, m, small, ends, german) >= (2 if pattern is _SHAPED else 4):
                ends.add(m.end("n"))
                at = m.end("n")
                yield m.start("n"), m.end("n")
            else:
                at = m.end("g") if pattern is _SHAPED else m.end("s")


def _given_first(v: str, a: int, given: frozenset[str]) -> regex.Match | None:
    """The name that begins with the listed given name at a, its case being that of a name."""
    m = _FULL.match(v, a)
    if m and m["g2"] and m["g2"].strip().lower() not in given:
        m = None
    m = m or _FULL1.match(v, a)
    if not m:
        return None
    g, s = m["g"], m["s"]
    cg, cs = _case(g), _case(s)
    if fold(s) in _STOP or cg == "l" and (cs != "l" or len(g) < 3 or len(s) < 3) or cg == "c" and (not g[0].isupper() or cs == "l") or cg == "u" and len(g) > 1 and cs == "l":
        return None
    return m


def _family_first(v: str, a: int, words: list[tuple[int, int, str]], k: int) -> tuple[int, int] | None:
    """The span of 'Family, Given' whose listed given name is the word numbered k, at a."""
    after = _AFTER_COMMA.match(v, a)
    if not after or not k or words[k - 1][1] != a - 2:
        return None
    for back in (4, 3, 2, 1):  # particles before the family name
        if k - back >= 0 and (m := _BEFORE_COMMA.match(v, words[k - back][0])) and m.end() == a:
            g, s = words[k][2], m["s"]
            if fold(s) in _NO_SURNAME or _case(s) == "l" and (_case(g) != "l" or len(s) < 4) or _case(s) != "l" and _case(g) == "l":
                return None
            return m.start("s"), after.end()
    return None


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


class _Taken:
    """Disjoint stretches of a text, kept in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.rows: list[tuple[int, int, str]] = []

    def add(self, a: int, b: int, kind: str) -> bool:
        k = bisect_left(self.starts, a)
        if k and self.rows[k - 1][1] > a or k < len(self.rows) and self.rows[k][0] < b:
            return False
        self.starts.insert(k, a)
        self.rows.insert(k, (a, b, kind))
        return True


def find(text: str, dates: bool = False) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every occurrence in the text, in order, without overlaps; offsets count code points. `dates` adds the kind 'date'."""
    if not text:
        return []
    v, place = unwrap(text)
    taken = _Taken()
    digits = any(c.isdigit() for c in v)
    for a, b in _emails(v):
        taken.add(a, b, "email")
    for pattern in _ADDRESS if digits or "s/n" in v else ():
        for m in pattern.finditer(v):
            taken.add(*m.span(), "address")
    if digits:
        _numbers(text, v, place, taken)
        if dates:
            for m in _DATE.finditer(v):
                if _day(m) is not None:
                    taken.add(*m.span(), "date")
    for a, b in sorted(set(_names(v)), key=lambda x: (x[0], -x[1])):
        taken.add(a, b, "name")
    if place is None:
        return [(k, a, b) for a, b, k in taken.rows]
    return [(k, place[a], place[b - 1] + 1) for a, b, k in taken.rows]


def _numbers(text: str, v: str, place: Places | None, taken: _Taken) -> None:
    for m in _ID.finditer(v):
        plain = _plain(m[0])
        if not regex.match(r"\p{Lu}{2}\d\d\w{8}", plain) or _iban_ok(plain):
            taken.add(*m.span(), "id_number")
    for near in _NUMBERISH.finditer(v):
        at, end = near.start(), min(len(v), near.end() + 40)  # an extension and what must not follow lie within
        while at < near.end() and (m := _PHONE.search(v, at, end)) and m.start() < near.end():
            a, b = m.span()
            bare = v[a:b] if m["ext"] is None else v[a : m.start("ext")]
            most = LONGEST_PHONE + 2 * bare.startswith("00")
            while len(_digits(bare)) > most and " " in bare:  # the next line's number
                bare = bare[: bare.rindex(" ")]
                b = a + len(bare)
            at = b
            if 7 <= len(_digits(bare)) <= most and not _is_date(bare):
                taken.add(a, b, "phone")
    if place is not None:  # a number that opens a line after another number
        hard = _HYPHENED.sub(lambda m: "" if text[m.start() - 1].isalpha() and text[m.end()].islower() else "-", text)
        for m in _PHONE.finditer(hard):
            if 7 <= len(_digits(m[0])) <= LONGEST_PHONE and not _is_date(m[0]):
                taken.add(*m.span(), "phone")
    for m in _CUED.finditer(v):
        if 6 <= len(_digits(m["n"])) <= 15:
            taken.add(*m.span("n"), "phone")


# --- pseudonyms ---------------------------------------------------------------------------------------------------
def _round(key: bytes, i: int, other: int, format_: str, modulus: int) -> int:
    return int.from_bytes(hmac.digest(key, f"{i}:{format_}:{other}".encode(), "sha256")[:16], "big") % modulus


def _mixed(values: list[int], radices: list[int], key: bytes, inverse: bool = False, rounds: int = 8) -> list[int]:
    """A keyed permutation of the numbers with these radices: a Feistel network over two halves of the places."""
    if not values:
        return []
    half = len(values) // 2
    format_ = ",".join(map(str, radices))
    sides, moduli = [], []
    for part in (slice(0, half), slice(half, None)):
        n, m = 0, 1
        for x, r in zip(values[part], radices[part]):
            n, m = n * r + x, m * r
        sides.append(n)
        moduli.append(m)
    for i in reversed(range(rounds)) if inverse else range(rounds):
        k = i % 2
        step = _round(key, i, sides[1 - k], format_, moduli[k])
        sides[k] = (sides[k] + (-step if inverse else step)) % moduli[k]
    out: list[int] = []
    for part, n in zip((slice(0, half), slice(half, None)), sides):
        back = []
        for r in reversed(radices[part]):
            n, x = divmod(n, r)
            back.append(x)
        out += reversed(back)
    return out


def feistel(digits: str, key: bytes) -> str:
    """A keyed permutation of the decimal strings of one length."""
    return "".join(map(str, _mixed([int(c) for c in digits], [10] * len(digits), key)))


def unfeistel(digits: str, key: bytes) -> str:
    """The inverse of feistel."""
    return "".join(map(str, _mixed([int(c) for c in digits], [10] * len(digits), key, inverse=True)))


def _permuted(plain: str, key: bytes, fixed: int = 0) -> str:
    """plain with its digits and letters A-Z permuted within their kinds; the first `fixed` signs stay."""
    at = [k for k, c in enumerate(plain) if k >= fixed and (c.isascii() and c.isalnum())]
    radices = [10 if plain[k].isdigit() else 26 for k in at]
    got = _mixed([int(plain[k]) if plain[k].isdigit() else ord(plain[k]) - 65 for k in at], radices, key)
    out = list(plain)
    for k, x, r in zip(at, got, radices):
        out[k] = str(x) if r == 10 else chr(65 + x)
    return "".join(out)


def _plain(value: str) -> str:
    return regex.sub(r"[^\p{L}\d]", "", value).upper()


def _mod11_2(body: str) -> str:
    s = 0
    for d in body:
        s = (s + int(d)) * 2
    c = (12 - s % 11) % 11
    return "X" if c == 10 else str(c)


def _mod11_10(body: str) -> str:
    p = 10
    for d in body:
        p = ((p + int(d)) % 10 or 10) * 2 % 11
    return str((11 - p) % 10)


def _dni(body: str) -> str:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(body.translate(str.maketrans("XYZ", "012"))) % 23]


def _nir(body: str) -> str:
    return f"{97 - int(body) % 97:02}"


def _iban_number(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4]))


def _iban_ok(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and plain.isascii() and _iban_number(plain) % 97 == 1


#: (format, signs kept at the front, check signs of a body): a number of this format whose check signs hold gets them made anew.
_CHECKED = (
    (regex.compile(r"\d{15}[\dX]"), 0, 1, _mod11_2),
    (regex.compile(r"\d{8}[A-Z]"), 0, 1, _dni),
    (regex.compile(r"[XYZ]\d{7}[A-Z]"), 1, 1, _dni),
    (regex.compile(r"[12]\d{14}"), 1, 2, _nir),
    (regex.compile(r"\d{11}"), 0, 1, _mod11_10),
)


def _number(plain: str, key: bytes) -> str:
    """The stand-in of an identity number in its plain form: same kinds of signs in the same places, valid if it was."""
    if regex.fullmatch(r"\p{Lu}{2}\d\d\w{8,30}", plain) and _iban_ok(plain):
        body = plain[:2] + "00" + _permuted(plain[4:], key)
        return f"{plain[:2]}{98 - _iban_number(body) % 97:02}{body[4:]}"
    for format_, fixed, signs, check in _CHECKED:
        if format_.fullmatch(plain) and check(plain[:-signs]) == plain[-signs:]:
            body = _permuted(plain[:-signs], key, fixed)
            return body + check(body)
    if regex.fullmatch(r"\d{9}", plain):  # no group of a social security number is zero
        new = _permuted(plain, key)
        while new[:3] in ("000", "666") or new[3:5] == "00" or new[5:] == "0000":
            new = _permuted(new, key)
        return new
    if regex.fullmatch(r"[A-Z]{2}\d{6}[A-D]", plain):
        *rest, last = _mixed([*(ord(c) - 65 for c in plain[:2]), *map(int, plain[2:8]), ord(plain[8]) - 65], [26] * 2 + [10] * 6 + [4], key)
        return "".join(chr(65 + x) for x in rest[:2]) + "".join(map(str, rest[2:])) + chr(65 + last)
    return _permuted(plain, key)


def _in_format(value: str, plain: str) -> str:
    """The signs of `plain` in the places of the letters and digits of `value`, small where it has small letters."""
    new = iter(plain)
    return "".join((x.lower() if c.islower() else x) if c.isalnum() and (x := next(new, "")) else c for c in value)


_MONTHS = (
    "january february march april may june july august september october november december", "januar februar märz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
)
_MONTH = {m: (k, names.split()) for names in reversed(_MONTHS) for k, m in enumerate(names.split(), 1)}
_DATE = regex.compile(
    r"(?<![\w./-])(?:(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)|(?P<d2>\d{1,2})(?P<sep>[./])[ ]?(?P<m2>\d{1,2})(?P=sep)[ ]?(?P<y2>\d{4})"
    rf"|(?P<d3>\d{{1,2}})\.?[ ](?:de[ ])?(?P<m3>(?i:{'|'.join(sorted(_MONTH, key=len, reverse=True))}))[ ](?:de[ ])?(?P<y3>\d{{4}}))(?![\w/-]|\.\d)"
)
_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _day(m: regex.Match) -> int | None:
    """The day of a date since 1900, None if it is none or lies outside of two centuries."""
    y, d = m["y"] or m["y2"] or m["y3"], m["d"] or m["d2"] or m["d3"]
    month = _MONTH[m["m3"].lower()][0] if m["m3"] else int(m["m"] or m["m2"])
    try:
        n = (date(int(y), month, int(d)) - _FIRST_DAY).days
    except ValueError:
        return None
    return n if 0 <= n < _DAYS else None


def _is_date(value: str) -> bool:
    m = _DATE.fullmatch(value)
    return m is not None and _day(m) is not None


def _date(value: str, key: bytes) -> str:
    """Another date in the same format; equal dates agree in whatever format they are written."""
    m = _DATE.fullmatch(value)
    n = _day(m)
    while True:
        n = int("".join(map(str, _mixed([int(c) for c in f"{n:05}"], [10] * 5, key))))
        if n < _DAYS:
            break
    new = _FIRST_DAY + timedelta(days=n)
    out = list(value)
    y, mo, d = next((a, b, c) for a, b, c in (("y", "m", "d"), ("y2", "m2", "d2"), ("y3", "m3", "d3")) if m[a])
    for name, text in sorted(((y, f"{new.year}"), (mo, f"{new.month:0{len(m[mo])}}" if mo != "m3" else _MONTH[m[mo].lower()][1][new.month - 1]), (d, f"{new.day:0{len(m[d])}}")), key=lambda x: -m.start(x[0])):
        if name == "m3" and m[name][0].isupper():
            text = text.capitalize()
        out[m.start(name) : m.end(name)] = text
    return "".join(out)


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """The value's stand-in. Numbers and dates keep their format; their letters and digits alone decide, so differently punctuated equal values agree in these."""
    if kind == "date":
        return _date(value, key)
    if kind == "phone":
        number = _digits(value)
        lead = 2 if number.startswith("00") else 1 if number.startswith("0") else 0
        new = "".join(iter(feistel(number[lead:], key)))
        it = iter(number[:lead] + new)
        return "".join(next(it) if c.isdigit() else c for c in value)
    if kind == "id_number":
        return _in_format(value, _number(_plain(value), key))
    if kind == "name":
        words = sorted(w for w in regex.split(r"[\s.,]+", fold(value)) if w)
        value = " ".join(words)
    elif kind == "email":
        value = regex.sub(r"[\[(]\s?at\s?[\])]", "@", fold(value))
        value = regex.sub(r"\s", "", regex.sub(r"[\[(]\s?dot\s?[\])]", ".", value))
    else:
        value = regex.sub(r"[\W_]+", " ", fold(value)).strip()
    return hmac.new(key, f"{kind}:{value}".encode(), hashlib.sha256).hexdigest()[:8]


def redact(text: str, key: bytes, dates: bool = False) -> str:
    """The text with each occurrence replaced by [KIND:pseudonym], otherwise unchanged."""
    out, at = [], 0
    for kind, a, b in find(text, dates):
        out += [text[at:a], f"[{kind.upper()}:{pseudonym(kind, unwrap(text[a:b])[0], key)}]"]
        at = b
    return "".join([*out, text[at:]])


def _find_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, k, s, e) for i, t in zip(b["_id"], b["_text"]) for k, s, e in find(t)]
        yield pd.DataFrame(rows, columns=["_id", "kind", "start_char", "end_char"])


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, start_char, end_char) of every occurrence; null and empty texts have none.

    Rows are independent: no shuffle, no state, whole texts of any length.
    Repeated rows give repeated results, as each row is one text; columns of
    docs other than key and text are ignored.
    """
    slim = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_text")).where(F.length("_text") > 0)
    return slim.mapInPandas(_find_batches, "_id bigint, kind string, start_char int, end_char int").withColumnRenamed("_id", key)


def redact_pii(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text", out: str = "redacted", dates: bool = False) -> DataFrame:
    """Key and the redacted text of each row; a null text stays null, an empty one empty. `dates` replaces dates too."""
    raw = secret.encode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "_out": [None if t is None else redact(t, raw, dates) for t in b["_text"]]})

    slim = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    return slim.mapInPandas(run, "_id bigint, _out string").select(F.col("_id").alias(key), F.col("_out").alias(out))
