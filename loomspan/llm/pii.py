"""Personal information in free text: found, typed and replaced by linked pseudonyms.

Numbers validated by their format (phone and identity numbers; ``checked`` tells whether the checksum holds, too) are keyed-permuted within their
format by a Feistel network over their digits, so equal values stay equal in all
documents while separators, prefix and length remain. Emails, addresses and
names get a keyed tag. Both stand in a typed placeholder, as in
``<PHONE +1 226 584 9012>`` or ``<NAME kitavobarunepo>``; the rest of the text is untouched, of a JSON message
every character outside of the texts that change.

Texts are read whole, one row at a time within Arrow batches: no shuffle, and no
state but the name lexicon, whose size is checked before it is sent to the workers.

Defined results: NULL and empty texts have no finding and stay as they are;
messages that are no JSON are read as plain text; a NULL id is -1; repeated rows each have their
findings; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.runtime import small_rows, spread

TYPES = ("email", "phone", "national_id", "address", "name")
#: Rows of a lexicon that may be sent to every worker.
LEXICON_LIMIT = 2_000_000


class Lexicon(NamedTuple):
    given: frozenset[str]
    family: frozenset[str]


class Span(NamedTuple):
    start: int
    end: int
    kind: str


# ---- emails -----------------------------------------------------------------------------------------------
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_EMAIL = re.compile(
    rf"(?<![\w.+@-])[A-Za-z0-9_][\w.+-]*@{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,24}}(?![\w-]|\.\w|@|:[\w/~.])"
)
_HIDDEN = re.compile(
    rf"(?<![\w.+@-])[A-Za-z0-9_][\w.+-]*\s?(?:\(at\)|\[at\]|\{{at\}})\s?{_LABEL}"
    rf"(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{{dot\}})\s?){_LABEL})*(?:\.|\s?(?:\(dot\)|\[dot\]|\{{dot\}})\s?)[A-Za-z]{{2,24}}(?!\w)",
    re.I,
)
_SPOKEN = re.compile(
    rf"(?<![\w.+@-])[A-Za-z0-9_][\w.+-]*(?: (?:dot|underscore|dash|plus) [\w+-]+)* at {_LABEL}(?: dot {_LABEL})* dot [A-Za-z]{{2,24}}(?!\w)", re.I
)
# File endings that are no top-level domains.
_FILE_ENDINGS = frozenset("png jpg jpeg gif svg webp js ts css html json yaml yml py go rs md txt log gz zip".split())


def _emails(t: str) -> Iterator[Span]:
    if "@" in t:
        for m in _EMAIL.finditer(t):
            before = t[max(0, m.start() - 3) : m.start()]
            if before.endswith("//") or m.group().rpartition(".")[2].lower() in _FILE_ENDINGS:
                continue
            yield Span(m.start(), m.end(), "email")
    low = t.lower()
    if "at)" in low or "at]" in low or "at}" in low:
        for m in _HIDDEN.finditer(t):
            yield Span(m.start(), m.end(), "email")
    if " at " in low and " dot " in low:
        for m in _SPOKEN.finditer(t):
            yield Span(m.start(), m.end(), "email")


# ---- street addresses -------------------------------------------------------------------------------------
_CAP = r"[A-ZÀ-ÞŠŽ][\w'’À-ÿ-]*"
# a town of one or two words; what opens a sentence or a name is given back by ``_trim``
_TOWN = rf"{_CAP}(?: {_CAP})?"
_TOWN_UP = r"[A-ZÀ-Þ'-]{3,}(?: [A-ZÀ-Þ'-]{3,})*"
# a postal code behind the town, unless it begins a longer number
_ZIP = r" \d{4,5}(?!\d| ?\d{3}(?!\d))"
# Words that end or open the name of a street.
_EN_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Place|Pl|Terrace|Way|Close|Square|Hill)"
_DE_STREET = r"(?:weg|ring|gasse|straße|strasse|str\.|platz|allee|ufer|damm)"
_ADDRESS = (
    # 31 Old Ferry Lane, Apt 19, Norrstadt 19046; without a town it may be anything that is counted
    re.compile(
        rf"(?<![\w.:#-])(?<!\d/)\d{{1,5}}[a-z]? (?:{_CAP} ){{1,4}}{_EN_STREET}\b\.?(?:,? (?:Apt|Unit|Suite|Flat|No)\.? ?\d\w{{0,4}})?"
        rf"(?:(?:,|,?\n) ?{_TOWN}(?:{_ZIP})?)"
    ),
    re.compile(
        rf"(?<![\w.:#-])(?<!\d/)\d{{1,5}} (?:[A-Z]{{2,}} ){{1,4}}{_EN_STREET.upper()}\b\.?(?:,? (?:APT|UNIT|SUITE|FLAT|NO)\.? ?\d\w{{0,4}})?"
        rf"(?:(?:,|,?\n) ?{_TOWN_UP}(?:{_ZIP})?)"
    ),
    # Kupferweg 61a, 92709 Silt Creek
    re.compile(
        rf"(?<!\w)[A-ZÄÖÜ][a-zäöüß-]+{_DE_STREET} \d{{1,4}}(?: ?[a-z]\b)?(?:, (?:D-)?\d{{5}} {_TOWN})?(?!\w)"
        rf"|(?<!\w)[A-ZÄÖÜ]{{3,}}(?:WEG|RING|GASSE|STRASSE|PLATZ|ALLEE) \d{{1,4}}(?: ?[A-Za-z]\b)?(?:, \d{{5}} {_TOWN_UP})?(?!\w)"
    ),
    # Calle del Brezal 138, 2º B, 86916 Silt Creek
    re.compile(
        rf"(?<!\w)(?:Calle|Avenida|Avda\.|Plaza|Paseo|C/)(?: (?:de|del|la|las|los|el|{_CAP}))* {_CAP},? \d{{1,4}}"
        rf"(?:, \d{{1,2}}[ºª°]? ?[A-Z]?\b)?(?:, \d{{5}} {_TOWN})?"
        rf"|(?<!\w)(?:CALLE|AVENIDA|PLAZA|PASEO)(?: [A-ZÀ-Þ]+)+,? \d{{1,4}}(?:, \d{{1,2}}[ºª°]? ?[A-Z]?\b)?(?:, \d{{5}} {_TOWN_UP})?"
    ),
    # 163 bis rue des Osiers, 66796 Port Vassal
    re.compile(
        rf"(?<![\w.:#-])(?<!\d/)\d{{1,4}},?(?: (?:bis|ter))? (?:rue|avenue|boulevard|place|chemin|quai|impasse)"
        rf"(?: (?:de|du|des|la|le|les|l'))* {_CAP}(?:, \d{{5}} {_TOWN})?"
        rf"|(?<![\w.:#-])(?<!\d/)\d{{1,4}},?(?: (?:BIS|TER))? (?:RUE|AVENUE|BOULEVARD|PLACE|CHEMIN|QUAI)(?: [A-ZÀ-Þ']+)+(?:, \d{{5}} {_TOWN_UP})?"
    ),
)
_ADDRESS_HINT = re.compile(
    r"\d{1,5}[a-z]?,? (?:[A-Za-zÀ-ÿ'-]+ ){0,5}(?:st|street|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd|court|ct|place|pl|terrace|way|close|square|hill|rue|chemin|quai|impasse)\b"
    r"|(?:weg|ring|gasse|straße|strasse|str\.|platz|allee|ufer|damm) \d|\b(?:calle|avenida|avda\.|plaza|paseo|c/) ",
    re.I,
)


_LAST_TWO = re.compile(rf"{_CAP}( ({_CAP}))$")
_NEXT = re.compile(rf" ?(?:{_CAP}|[A-ZÀ-Þ]\.)")


def _trim(text: str, end: int, start: int, lex: Lexicon) -> int:
    """Where an address ends: a second word of its town that is a title, a given or family name, or opens a sentence is none of it."""
    m = _LAST_TWO.search(text, start, end)
    if not m:
        return end
    w = plain(m.group(2))
    if w in lex.given or w in lex.family or w in _TITLES or w in _NO_NAME or w == "will" or text[end : end + 1] == "'":
        return m.start(1)
    # a capital word behind it too: the second word opens what follows, unless what follows is a name itself
    n = _NEXT.match(text, end)
    if n and plain(n.group().strip(" .")) not in lex.given and plain(n.group().strip(" .")) not in _TITLES and plain(n.group().strip(" .")) not in _NO_NAME and len(n.group().strip(" .")) > 1:
        return m.start(1)
    return end


def _addresses(t: str, lex: Lexicon) -> Iterator[Span]:
    if _ADDRESS_HINT.search(t):
        for p in _ADDRESS:
            for m in p.finditer(t):
                yield Span(m.start(), _trim(t, m.end(), m.start(), lex), "address")


# ---- numbers ----------------------------------------------------------------------------------------------
_ID = re.compile(
    r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"  # social security number
    r"|(?<![\w.-])(?<!\d )\d{3} \d{2} \d{4}(?![\w-])(?! \d)"
    r"|\bSSN[:# ]{1,3}(?:no\.? ?)?\d{9}(?!\w)"
    r"|(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])"  # national insurance number
    r"|(?i:\bpassport(?: (?:no|number|nr)\.?)?[:# ]{1,2})[A-Z]{1,2}\d{6,8}(?!\w)"
    r"|(?i:\b(?:DNI|NIF|NIE)[:# ]{1,2})[XYZ]?\d{7,8}-?[A-Z](?!\w)"
    r"|(?i:\b(?:Steuer-?ID|Steuer-?IdNr\.?|IdNr\.?)[:# ]{1,2})\d{2,3} ?\d{3} ?\d{3} ?\d{2,3}(?!\w)"
    r"|(?i:\b(?:NIR|numéro de sécurité sociale)[:# ]{1,2})[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?(?!\w)"
)
_EXT = r"(?:,? ?(?:ext\.?|x|extension) ?\d{1,5})?"
_PHONE = re.compile(
    rf"(?<![\w.+-])\+1[ .-]?\(?[2-9]\d{{2}}\)?[ .-]?\d{{3}}[ .-]?\d{{4}}{_EXT}(?![\w-])"
    r"|(?<![\w.+])\+[2-9]\d{0,2}(?:[ .-]?\(\d{1,4}\))?(?:[ ./-]?\d{1,5}){2,6}(?![\w-])"
    r"|(?<![\w.+-])00[1-9]\d{9,12}(?![\w-])"
    r"|(?<![\w.+-])00[1-9]\d{0,2}(?:[ ./-]\d{1,5}){2,5}(?![\w-])"
    r"|(?<![\w.+-])0[1-9]\d{2,4}[ /-]\d{3}[ -]?\d{3,4}(?![\w-])"
    rf"|(?<![\w.+-])(?:1[ .-])?\([2-9]\d{{2}}\) ?\d{{3}}[ .-]\d{{4}}{_EXT}(?![\w-])"
    rf"|(?<![\w.+-])(?:1[.-])?[2-9]\d{{2}}([.-])\d{{3}}\1\d{{4}}{_EXT}(?![\w-])"
)
_NUMBERS_HINT = re.compile(r"\d[\d ().+/-]{6,}\d|[A-Z]{2} ?\d\d ?\d\d|(?i:passport|dni |steuer)")


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _ids(t: str) -> Iterator[Span]:
    for m in _ID.finditer(t):
        yield Span(m.start(), m.end(), "national_id")


def _phones(t: str) -> Iterator[Span]:
    for m in _PHONE.finditer(t):
        if 9 <= _digits(re.split(r",? ?(?:ext|x)", m.group())[0]) <= 15:
            yield Span(m.start(), m.end(), "phone")


# The check letters of the Spanish number, prefixes that no British number has.
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_NINO_NEVER = ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")


def checked(value: str, kind: str) -> bool | None:
    """Whether a number passes the rule of its kind: its checksum, or the ranges that are issued; None if it has no rule."""
    d = re.sub(r"\D", "", value)
    if kind == "phone":
        return 9 <= len(re.sub(r"\D", "", re.split(r",? ?(?:ext|x)", value)[0])) <= 15
    low = value.lower()
    if "passport" in low:
        return None
    if low.startswith(("dni", "nif", "nie")):
        m = re.search(r"([XYZ]?)(\d{7,8})-?([A-Z])$", value)
        return bool(m) and _DNI_LETTERS[int(str("XYZ".index(m.group(1)) if m.group(1) else "") + m.group(2)) % 23] == m.group(3)
    if "steuer" in low or low.startswith("idnr"):
        p = 10
        for c in d[:-1]:
            p = ((int(c) + p) % 10 or 10) * 2 % 11
        return len(d) == 11 and (11 - p) % 10 == int(d[-1])
    if low.startswith(("nir", "num")):
        return len(d) == 15 and 97 - int(d[:13]) % 97 == int(d[13:])
    if m := re.fullmatch(r"([A-Z]{2}) ?\d\d ?\d\d ?\d\d ?[A-D]", value):
        return m.group(1) not in _NINO_NEVER and m.group(1)[0] not in "DFIQUV" and m.group(1)[1] not in "DFIOQUV"
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


# ---- names ------------------------------------------------------------------------------------------------
# Titles, particles, machine accounts, and words that open sentences or follow given names that are also plain words.
_TITLES = frozenset("mr mrs ms miss dr prof mr. mrs. ms. dr. prof. sir herr frau señor señora mme m.".split())
_PARTICLES = frozenset("de la del von van der den le du di da".split())
_MACHINES = frozenset(
    "dev ci ops build runner workspace code src source internal work root admin agent agents service svc bot test user users shared public data app www git deploy system local tmp"
    " tools frontend backend docs site server web home".split()
)
_NO_NAME = frozenset(
    "the a an this that these those it its in on at of for from to with by as and or but if when while after before since once whenever"
    " please can could would should will may might must do does did is are was were has have had be not no yes why what where who how which"
    " i we you he she they my our your their his her add ask call ring send ship parcel talked note signed reviewed cc my office"
    " der die das den dem des ein eine einer und oder aber nach vor bei mit von zu im am in auf aus für wenn weil dass daher der"
    " el la los las un una unos en de del al y o pero con por para que se si no como cuando"
    " le les un une des du au aux en dans et ou mais avec pour par que qui il elle on nous vous ce cette comme quand"
    " mode period done time done line turn page test run step name number list day week month bash read write edit grep glob task webfetch"
    " monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split()
)
_TOKEN = re.compile(r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’]*(?:-[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’]*)*\.?")
_WORD = r"[A-ZÀ-Þ][A-Za-zÀ-ÿ'’]*(?:-[A-ZÀ-Þ][A-Za-zÀ-ÿ'’]*)*"
_FAMILY = rf"(?:(?:de la|de|del|von|van der|van|du|DE LA|DE|VON) )?{_WORD}"
_PERSON = re.compile(
    rf"(?<![\w@/.-])(?:"
    rf"(?P<title>(?:Mr|Mrs|Ms|Miss|Dr|Prof|MR|MRS|MS|DR|PROF|Herr|Frau|Mme)\b\.?) (?:[A-ZÀ-Þ]\. )?(?P<tlast>{_FAMILY})(?P<tmore> {_FAMILY})?"
    rf"|(?P<initial>[A-ZÀ-Þ]\.)(?: [A-ZÀ-Þ]\.)? (?P<ilast>{_FAMILY})"
    rf"|(?P<given>{_WORD})(?P<middle> [A-ZÀ-Þ]\.)? (?P<last>{_FAMILY})"
    rf"|(?P<rlast>{_FAMILY}), (?P<rfirst>{_WORD})"
    rf")(?![\w@-])"
)
_CUE_BEFORE = re.compile(
    r"(?:talked to|spoke (?:to|with)|ask|cc|signed,|signed|regards,|thanks,|assignee[=:]|owner[=:]|author[=:]?|name is|note from|from|contact|reviewed-by:|approved-by:|by:|attn:?)\s*$",
    re.I,
)
_CUE_AFTER = re.compile(r"\s*(?:reported|said|says|wrote|asked|told|noted|confirmed|thinks|asks|replied|added|agreed|approved|about|and (?:the|our|my) (?:[a-z-]+ )?(?:agent|team|engineer|manager|reviewer|developer|user|customer|client|colleague)s?)\b")
_HOME = re.compile(r"(?:[/\\](?:home|Users|users|clients|people|staff|customers)[/\\])([A-Za-zÀ-ÿ'’-]+(?:[._ ][A-Za-zÀ-ÿ'’-]+){1,4})(?=[/\\]|$|[\s\"'])")


def plain(s: str) -> str:
    return s.casefold().replace("’", "'")


def _names(t: str, lex: Lexicon) -> Iterator[Span]:
    for m in _HOME.finditer(t):
        parts = re.split(r"[._ ]", m.group(1))
        if 2 <= len(parts) and not any(p.casefold() in _MACHINES for p in parts) and all(len(p) > 1 for p in parts):
            yield Span(m.start(1), m.end(1), "name")
    at = 0
    while m := _PERSON.search(t, at):
        at = _person_end(m, t, lex)
        if at:
            yield Span(m.start(), at, "name")
        else:
            # go on behind the first word only: the next may open a name
            w = _TOKEN.match(t, m.start())
            at = max(m.start() + 1, w.end() if w else 0)


def _person_end(m: re.Match, t: str, lex: Lexicon) -> int:
    """Where the person's name ends, 0 if the match is none."""
    g = m.groupdict()
    if g["title"]:
        last, more = g["tlast"], (g["tmore"] or "").strip()
        if not _open(last):
            return 0
        # a second word belongs to the name only behind a given name
        given = plain(last) in lex.given or _known(more, lex)
        return m.end() if more and given and _open(more) else m.end("tlast")
    return m.end() if _is_person(g, m, t, lex) else 0


def _bare(s: str) -> str:
    return plain(s).rpartition(" ")[2]


def _open(w: str) -> bool:
    """Whether a word may be part of a name at all."""
    return _bare(w) not in _NO_NAME and len(w) > 1


def _known(s: str, lex: Lexicon) -> bool:
    return plain(s) in lex.family or _bare(s) in lex.family


def _is_person(g: dict[str, str | None], m: re.Match, t: str, lex: Lexicon) -> bool:
    cued = lambda: bool(_CUE_BEFORE.search(t, max(0, m.start() - 16), m.start()) or _CUE_AFTER.match(t, m.end()))
    special = lambda s: " " in s or "'" in s or "’" in s
    if g["initial"]:
        last = g["ilast"]
        return _open(last) and (_known(last, lex) or special(last) or cued())
    if g["given"]:
        first, last = plain(g["given"]), g["last"]
        if not _open(last) or (plain(last) in lex.given and not _known(last, lex)):
            return False
        if first in lex.given:
            return True
        if first == "will":  # a given name and a verb
            return _known(last, lex) or special(last) or cued()
        if not _open(g["given"]) or first in lex.family:
            return False
        return _known(last, lex) or bool(g["middle"]) or cued()
    first, last = plain(g["rfirst"]), g["rlast"]
    if _known(last, lex):
        return _open(g["rfirst"]) or first == "will"
    if not _open(last) or plain(last) in lex.given:
        return False
    if first in lex.given:
        return cued() or special(last)
    return (_open(g["rfirst"]) or first == "will") and cued() and first not in lex.family


# ---- all --------------------------------------------------------------------------------------------------
_DIGIT = re.compile(r"\d")


def find(text: str, lex: Lexicon) -> list[Span]:
    """All findings of a text in order, without overlaps. What is part of an earlier kind is no later one."""
    spans: list[Span] = []
    starts: list[int] = []
    masked = text

    def take(found: Iterator[Span]) -> None:
        nonlocal masked
        parts, at = [], 0
        for s in sorted(found):
            k = bisect.bisect_left(starts, s.end)
            if k and spans[k - 1].end > s.start:
                continue
            starts.insert(k, s.start)
            spans.insert(k, s)
            parts += [masked[at : s.start], "\x01" * (s.end - s.start)]
            at = s.end
        if parts:
            masked = "".join(parts) + masked[at:]

    take(_emails(masked))
    if _DIGIT.search(masked):
        take(_addresses(masked, lex))
        if _NUMBERS_HINT.search(masked):
            take(_ids(masked))
            take(_phones(masked))
    take(_names(masked, lex))
    return spans


# ---- pseudonyms -------------------------------------------------------------------------------------------
ROUNDS = 10


def _round(key: bytes, tweak: bytes, r: int, half: str, mod: int) -> int:
    return int.from_bytes(hmac.new(key, tweak + bytes([r]) + half.encode(), hashlib.sha256).digest()[:12], "big") % mod


def feistel(digits: str, key: bytes, tweak: bytes, back: bool = False) -> str:
    """A keyed permutation of the decimal strings of one length, by a balanced Feistel network."""
    n = len(digits)
    if n < 2:
        if not n:
            return ""
        k = _round(key, tweak, 0, "", 10)
        return str((int(digits) + (-k if back else k)) % 10)
    u = n // 2
    a, b = digits[:u], digits[u:]
    for i in range(ROUNDS) if not back else reversed(range(ROUNDS)):
        if i % 2 == 0:
            f = _round(key, tweak, i, b, 10 ** len(a))
            a = str((int(a) + (-f if back else f)) % 10 ** len(a)).zfill(len(a))
        else:
            f = _round(key, tweak, i, a, 10 ** len(b))
            b = str((int(b) + (-f if back else f)) % 10 ** len(b)).zfill(len(b))
    return a + b


def permute_number(value: str, kind: str, key: bytes, back: bool = False) -> str:
    """Permutes the digits of a number in place; letters, separators, an extension and a phone's prefix stay.

    Of a phone number the last eight digits are permuted, so its national and
    international spellings stay linked.
    """
    head, ext = value, ""
    if kind == "phone" and (m := re.search(r",? ?(?:ext\.?|x|extension) ?\d{1,5}$", value)):
        head, ext = value[: m.start()], value[m.start() :]
    at = [i for i, c in enumerate(head) if c.isdigit()]
    if kind == "phone":
        at = at[-min(8, len(at)) :]
    new = feistel("".join(head[i] for i in at), key, kind.encode(), back)
    out = list(head)
    for i, c in zip(at, new):
        out[i] = c
    return "".join(out) + ext


#: Syllables of a tag: 3e14 of them, so two of a million names share one with a chance of 0.2 %.
TAG_SYLLABLES = 8
_SYLLABLES = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]


def tag(value: str, kind: str, key: bytes) -> str:
    """A readable keyed tag; spellings that differ in case and blanks share it."""
    norm = re.sub(r"\s+", " ", value.casefold().strip())
    h = int.from_bytes(hmac.new(key, kind.encode() + b"\0" + norm.encode(), hashlib.sha256).digest()[:8], "big")
    out = ""
    for _ in range(TAG_SYLLABLES):
        h, k = divmod(h, len(_SYLLABLES))
        out += _SYLLABLES[k]
    return out


def placeholder(value: str, kind: str, key: bytes) -> str:
    inner = permute_number(value, kind, key) if kind in ("phone", "national_id") else tag(value, kind, key)
    return f"<{kind.upper()} {inner}>"


def redact_text(text: str, lex: Lexicon, key: bytes) -> tuple[str, list[str]]:
    """The text with placeholders, and the kind of each finding."""
    spans = find(text, lex)
    parts, at = [], 0
    for s in spans:
        parts += [text[at : s.start], placeholder(text[s.start : s.end], s.kind, key)]
        at = s.end
    return ("".join(parts) + text[at:] if spans else text), [s.kind for s in spans]


#: String and number tokens of a JSON text.
_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?')
_IDENTIFIER = re.compile(r'"[a-z_]*"')
# Names of fields whose digits are a number of that kind, however they are written.
_PHONE_FIELD = re.compile(r"(?:^|[_.-])(?:phone|mobile|tel|telephone|fax)(?:$|[_.-]?(?:no|nr|num|number)$)", re.I)
_ID_FIELD = re.compile(r"(?:^|[_.-])(?:ssn|social_?security|national_?id|passport|dni|nif|nie|steuer_?id|nino|tax_?id)(?:$|[_.-]?(?:no|nr|num|number)$)", re.I)
_BARE = re.compile(r"\+?[\d ().\-/]{6,20}|[A-Z0-9]{6,15}")


def _texts(message: str) -> tuple[list[str], bool] | None:
    """All texts of a JSON message that may hold something, names of fields included, and whether a name tells a number; None if it is no JSON."""
    try:
        top = json.loads(message, object_pairs_hook=list)  # pairs, so a name that is there twice keeps both values
    except ValueError:
        return None
    except RecursionError:
        if message.lstrip()[:1] not in ("{", "["):
            return None
        return [t.text for t in _tokens(message)], True  # too deep for the parser, but opened like one
    out: list[str] = []
    telling = False
    todo = [top]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            for y in x:
                if isinstance(y, tuple):
                    name, value = y
                    worth, tells = _looked_at(name)
                    if worth:
                        out.append(name)
                    telling = telling or tells
                    if isinstance(value, (str, list)):
                        todo.append(value)
                elif isinstance(y, (str, list)):
                    todo.append(y)
    return out, telling


_NAME = re.compile(r"[a-z_]*")


@lru_cache(maxsize=10_000)
def _looked_at(name: str) -> tuple[bool, bool]:
    """Whether a field's name may itself hold something, and whether it tells a number; names repeat."""
    return not _NAME.fullmatch(name), bool(_PHONE_FIELD.search(name) or _ID_FIELD.search(name))


def _decoded(token: str) -> str:
    return json.loads(token) if "\\" in token else token[1:-1]


class Token(NamedTuple):
    start: int
    end: int
    text: str
    field: str | None  # kind of a number that its field's name tells


def _tokens(message: str) -> list[Token]:
    """The texts of a JSON message that may hold something: values and names of fields, and numbers under a telling name."""
    out: list[Token] = []
    name = ""
    for m in _JSON_TOKEN.finditer(message):
        t = m.group()
        if t[0] != '"':
            kind = _field_kind(name, t)
            if kind:
                out.append(Token(m.start(), m.end(), t, kind))
            continue
        is_name = message[m.end() : m.end() + 8].lstrip()[:1] == ":"
        if _IDENTIFIER.fullmatch(t):  # nothing matches a plain lower-case word
            name = t[1:-1] if is_name else name
            continue
        x = _decoded(t)
        if is_name:
            name = x
        out.append(Token(m.start(), m.end(), x, None if is_name else _field_kind(name, x)))
    return out


def _field_kind(name: str, value: str) -> str | None:
    n = _digits(value)
    if n < 7 or not _BARE.fullmatch(value):
        return None
    return "phone" if n <= 15 and _PHONE_FIELD.search(name) else "national_id" if _ID_FIELD.search(name) else None


def redact_message(message: str, lex: Lexicon, key: bytes) -> tuple[str, list[str]]:
    """The same for a JSON message: each of its texts on its own, in place, so all else stays as it is written.

    A number under a telling name becomes a text, as a placeholder is none.
    """
    got = _texts(message)
    if got is None:
        return redact_text(message, lex, key)
    # one scan over all texts tells whether there is anything; a text's end ends every pattern
    if not got[1] and not find(" \x00\n ".join(got[0]), lex):
        return message, []
    tokens = _tokens(message)
    parts, at = [], 0
    kinds: list[str] = []
    for t in tokens:
        new, found = redact_text(t.text, lex, key)
        if not found and t.field:
            new, found = placeholder(t.text, t.field, key), [t.field]
        if found:
            kinds += found
            parts += [message[at : t.start], json.dumps(new, ensure_ascii=False)]
            at = t.end
    return "".join(parts) + message[at:], kinds


def read_lexicon(names: DataFrame) -> Lexicon:
    """The lexicon (name_part, part_kind), if it is small enough to be sent around."""
    rows = small_rows(names.select("name_part", "part_kind"), LEXICON_LIMIT, "name lexicon")
    part = lambda k: frozenset(plain(r[0].strip()) for r in rows if r[0] and r[1] == k)
    return Lexicon(part("given"), part("family"))


def findings(lines: DataFrame, names: DataFrame, key: bytes = b"") -> DataFrame:
    """line_id, field_name, pii_type: one row per line, field and type that was replaced."""
    spark = lines.sparkSession
    shared = spark.sparkContext.broadcast(read_lexicon(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        paths: dict[str, tuple[str, ...]] = {}  # working directories repeat
        for b in batches:
            rows = []
            for i, message, cwd in zip(b["line_id"], b["message"], b["cwd"]):
                if isinstance(message, str) and message:
                    rows += [(i, "message", k) for k in set(redact_message(message, lex, key)[1])]
                if isinstance(cwd, str) and cwd:
                    if cwd not in paths:
                        if len(paths) > 50_000:
                            paths.clear()
                        paths[cwd] = tuple(set(redact_text(cwd, lex, key)[1]))
                    rows += [(i, "cwd", k) for k in paths[cwd]]
            yield pd.DataFrame(rows, columns=["line_id", "field_name", "pii_type"])

    return spread(lines.select(F.coalesce("line_id", F.lit(-1)).alias("line_id"), "message", "cwd")).mapInPandas(run, "line_id bigint, field_name string, pii_type string")


def numbers(lines: DataFrame, names: DataFrame) -> DataFrame:
    """pii_type, passes (NULL: its kind has no rule), n_values: how many of the numbers found in messages pass the rule of their kind."""
    shared = lines.sparkSession.sparkContext.broadcast(read_lexicon(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for m in b["message"]:
                texts = [] if not isinstance(m, str) else (_texts(m) or ([m], False))[0]
                rows += [(s.kind, checked(t[s.start : s.end], s.kind)) for t in texts for s in find(t, shared.value) if s.kind in ("phone", "national_id")]
            yield pd.DataFrame(rows, columns=["pii_type", "passes"]).astype({"passes": "boolean"})

    return spread(lines.select("message")).mapInPandas(run, "pii_type string, passes boolean").groupBy("pii_type", "passes").agg(F.count(F.lit(1)).alias("n_values"))


def redacted(lines: DataFrame, names: DataFrame, key: bytes) -> DataFrame:
    """line_id, message, cwd with placeholders, n_found."""
    shared = lines.sparkSession.sparkContext.broadcast(read_lexicon(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        for b in batches:
            rows = []
            for i, message, cwd in zip(b["line_id"], b["message"], b["cwd"]):
                m, k = redact_message(message, lex, key) if isinstance(message, str) else (None, [])
                c, k2 = redact_text(cwd, lex, key) if isinstance(cwd, str) else (None, [])
                rows.append((i, m, c, len(k) + len(k2)))
            yield pd.DataFrame(rows, columns=["line_id", "message", "cwd", "n_found"])

    return spread(lines.select(F.coalesce("line_id", F.lit(-1)).alias("line_id"), "message", "cwd")).mapInPandas(run, "line_id bigint, message string, cwd string, n_found int")
