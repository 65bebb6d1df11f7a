"""All valid readings of a written time, as microseconds UTC."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from typing import NamedTuple
from zoneinfo import ZoneInfo

_EPOCH = datetime(1970, 1, 1)
#: Instants outside this span are taken as no reading of an epoch number.
LOW_US, HIGH_US = 946_684_800_000_000, 4_102_444_800_000_000  # 2000-01-01, 2100-01-01


class Reading(NamedTuple):
    form: str
    utc_us: int
    cost: float


#: What a reading costs that goes against the stated conventions (month first
#: with slashes, day first with dots, first of two equal wall-clock hours). It
#: is above twice the highest cost of one step, so order alone can't outweigh it.
AGAINST = 6.0
#: What an abbreviation costs in the sense of another zone than the writer's, where it has one in the writer's; no convention
#: speaks for either, so one jump back in time that it spares outweighs it. ``RARER`` orders senses that are otherwise equal.
STRANGE, RARER = 0.9, 0.01

# Zone abbreviations with their offsets in minutes.
ABBREVIATIONS = {
    "UTC": (0,), "GMT": (0,), "Z": (0,), "WET": (0,), "BST": (60,), "WEST": (60,), "CET": (60,), "CEST": (120,),
    "EET": (120,), "EEST": (180,), "MSK": (180,), "IST": (330, 60, 120), "JST": (540,), "KST": (540,), "SGT": (480,),
    "AEST": (600,), "AEDT": (660,), "EST": (-300,), "EDT": (-240,), "CST": (-360, 480), "CDT": (-300,),
    "MST": (-420,), "MDT": (-360,), "PST": (-480,), "PDT": (-420,),
}
_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

_ISO = re.compile(
    r"(\d{4})-(\d{2})-(\d{2})(?:[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?"
    r"\s*([Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,5})?(?:\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?"
)
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})(?:[.,](\d+))?([Zz]|[+-]\d{2}:?\d{2})?")
_MAIL = re.compile(
    r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{2}):(\d{2})(?::(\d{2}))?"
    r"\s*([+-]\d{4}|[A-Z]{1,5})?"
)
_PARTED = re.compile(
    r"(\d{1,2})([/.])(\d{1,2})\2(\d{4})(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp][Mm])?)?"
    r"\s*([Zz]|[+-]\d{2}:?\d{2}|[A-Z]{3,5})?"
)
_NUMBER = re.compile(r"(\d{9,20})(?:\.(\d+))?")
_UNITS = (("s", 1_000_000, 1), ("ms", 1_000, 1), ("us", 1, 1), ("ns", 1, 1_000))


@lru_cache(maxsize=1024)
def zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _us(y: str | int, mo: str | int, d: str | int, h: str | int, mi: str | int, s: str | int, frac: str | None) -> int | None:
    try:
        t = datetime(int(y), int(mo), int(d), int(h), int(mi), int(s))
    except ValueError:
        return None
    x = t - _EPOCH
    return (x.days * 86400 + x.seconds) * 1_000_000 + int((frac or "").ljust(6, "0")[:6])


def _at_wall_clock(us: int, tz: ZoneInfo) -> list[int]:
    """UTC instants at which clocks of the zone show ``us``: none in a gap, two where an hour repeats."""
    wall = _EPOCH + timedelta(microseconds=us)
    found: list[int] = []
    for fold in (0, 1):
        off = wall.replace(tzinfo=tz, fold=fold).utcoffset()
        utc = wall - off
        if utc.replace(tzinfo=timezone.utc).astimezone(tz).replace(tzinfo=None) == wall:
            x = utc - _EPOCH
            v = (x.days * 86400 + x.seconds) * 1_000_000 + x.microseconds
            if v not in found:
                found.append(v)
    return sorted(found)


def _offset(us: int, tz: str | None) -> int | None:
    """Minutes by which clocks of the zone are ahead at a UTC instant."""
    z = zone(tz) if tz else None
    if z is None:
        return None
    return int((_EPOCH + timedelta(microseconds=us)).replace(tzinfo=timezone.utc).astimezone(z).utcoffset().total_seconds()) // 60


def _zoned(form: str, us: int | None, mark: str | None, named: str | None, tz: str | None, cost: float = 0.0) -> list[Reading]:
    if us is None:
        return []
    if mark in ("Z", "z"):
        return [Reading(form + "z", us, cost)]
    if mark and mark[0] in "+-":
        h, m = int(mark[1:3]), int(mark[-2:]) if len(mark) > 3 else 0
        if h > 15 or m > 59:
            return []
        return [Reading(form + "o", us - (1 if mark[0] == "+" else -1) * (h * 60 + m) * 60_000_000, cost)]
    if mark:
        offsets = ABBREVIATIONS.get(mark)
        if offsets is None:
            return []
        at = [us - o * 60_000_000 for o in offsets]
        own = [len(at) > 1 and _offset(u, tz) == o for u, o in zip(at, offsets)]
        return [Reading(form + "a", u, cost + RARER * k + STRANGE * (any(own) and not own[k])) for k, u in enumerate(at)]
    z = zone(named or tz or "UTC") or (None if named else zone("UTC"))
    if z is None:
        return []
    return [Reading(form + "w", v, cost + AGAINST * k) for k, v in enumerate(_at_wall_clock(us, z))]


def readings(text: str, tz: str | None) -> list[Reading]:
    """Every valid reading of ``text``, cheapest first; empty if it stands for no time.

    ``tz`` is the zone of the writer's wall clock (NULL: UTC), used where the
    text has no zone information. Digits finer than a microsecond are cut off.
    """
    s = text.strip()
    if not s:
        return []
    out: list[Reading] = []
    if m := _NUMBER.fullmatch(s):
        n, frac = int(m.group(1)), m.group(2)
        for unit, up, down in _UNITS:
            us = n * up // down + (int(frac.ljust(6, "0")[:6]) if frac and unit == "s" else int(frac.ljust(3, "0")[:3]) if frac and unit == "ms" else 0)
            if LOW_US <= us < HIGH_US:
                out.append(Reading(f"epoch_{unit}", us, 0.0))
    elif m := _ISO.fullmatch(s):
        y, mo, d, h, mi, sec, frac, mark, named = m.groups()
        out = _zoned("iso" + ("" if h else "d"), _us(y, mo, d, h or 0, mi or 0, sec or 0, frac), mark, named, tz)
    elif m := _COMPACT.fullmatch(s):
        out = _zoned("compact", _us(*m.groups()[:7]), m.group(8), None, tz)
    elif m := _PARTED.fullmatch(s):
        a, sep, b, y, h, mi, sec, frac, half, mark = m.groups()
        hour = int(h or 0)
        if half:
            if not 1 <= hour <= 12:
                return []
            hour = hour % 12 + 12 * (half[0] in "Pp")
        for first, cost in (("m", AGAINST * (sep == ".")), ("d", AGAINST * (sep == "/"))):
            mo, d = (a, b) if first == "m" else (b, a)
            out += _zoned(f"{sep}{first}", _us(y, mo, d, hour, mi or 0, sec or 0, frac), mark, None, tz, cost)
        # an impossible reading by the convention leaves only the other one: that is no time under the convention
        if out and min(r.cost for r in out) >= AGAINST:
            out = []
    elif m := _MAIL.fullmatch(s):
        d, mon, y, h, mi, sec, mark = m.groups()
        if mo := _MONTHS.get(mon.lower()):
            out = _zoned("mail", _us(y, mo, d, h, mi, sec or 0, None), mark, None, tz)
    out = [r for r in out if r.utc_us > 0]
    return sorted(out, key=lambda r: (r.cost, r.utc_us))
