"""One timestamp string, its source's zone and locale -> one UTC instant, or nothing."""

from __future__ import annotations

import functools
import re
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

EPOCH = date(1970, 1, 1).toordinal()
#: Month names of en, de, fr and es, and their usual short forms (fixed values).
MONTHS = {
    name: number
    for number, names in enumerate(
        (
            "january jan januar jän jänner janvier janv enero ene",
            "february feb februar février févr fév febrero",
            "march mar märz mär mrz mars marzo",
            "april apr avril avr abril abr",
            "may mai mayo",
            "june jun juni juin junio",
            "july jul juli juillet juil julio",
            "august aug août aou agosto ago",
            "september sep sept septembre septiembre",
            "october oct oktober okt octobre octubre",
            "november nov novembre noviembre",
            "december dec dezember dez décembre déc diciembre dic",
        ),
        1,
    )
    for name in names.split()
}
#: Weekday names and their short forms in the same languages (fixed values).
DAYS = (
    "monday mon tuesday tue tues wednesday wed thursday thu thur thurs friday fri saturday sat sunday sun "
    "montag mo dienstag di mittwoch mi donnerstag do freitag fr samstag sa sonntag so "
    "lundi lun mardi mercredi mer jeudi jeu vendredi ven samedi sam dimanche dim "
    "lunes martes miércoles mié jueves jue viernes vie sábado sáb domingo dom"
).split()
#: Minutes east of UTC of abbreviations where the source's own zone doesn't use them (fixed values).
ZONES = {
    "z": 0, "utc": 0, "ut": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "met": 60, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "kst": 540, "hkt": 480, "sgt": 480, "awst": 480, "acst": 570, "acdt": 630,
    "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "ast": -240, "adt": -180, "nst": -210, "ndt": -150, "brt": -180, "brst": -120, "art": -180,
    "msd": 240, "trt": 180, "gst": 240, "pkt": 300, "npt": 345, "ict": 420, "wib": 420, "wita": 480, "wit": 540, "myt": 480, "pht": 480, "sast": 120, "eat": 180, "cat": 120, "wat": 60,
    "clt": -240, "clst": -180, "cot": -300, "pet": -300, "uyt": -180,
}

#: Zones whose abbreviation has stood for other offsets in other years (fixed values).
HOMES = {"msk": "Europe/Moscow", "msd": "Europe/Moscow"}

_month = "(?P<mon>" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\.?"
_dates = [
    r"(?P<y>\d{4})([-/.])(?P<m>\d{1,2})\2(?P<d>\d{1,2})",
    r"(?P<y>\d{4})-?w(?P<week>\d{2})-?(?P<wd>\d)",
    r"(?P<y>\d{4})-(?P<doy>\d{3})(?=t)",
    r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?=t|\s|\d{6}$|\d{4}$)",
    r"(?P<d>\d{1,2})\.\s?(?P<m>\d{1,2})\.\s?(?P<y>\d{4}|\d{2})(?!\d)",
    r"(?P<a>\d{1,2})([-/])(?P<b>\d{1,2})\2(?P<y>\d{4}|\d{2})(?!\d)",
    r"(?P<d>\d{1,2})(?:\.|st|nd|rd|th|er|º)?[\s-]+(?:de\s+|of\s+)?" + _month + r"[\s,-]+(?:de\s+|del\s+)?(?P<y>\d{4}|\d{2})(?!\d)",
    _month + r"\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})(?!\d)",
]
DATES = [re.compile(p) for p in _dates]
TIME = re.compile(
    r"(?:t|\s*,\s*|\s+)(?:at\s+|à\s+|um\s+|a\s+las\s+|@\s*)?(?P<h>\d{1,2})\s?[:h.]\s?(?P<mi>\d{2})(?:\s?:\s?(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?\s?(?P<ap>[ap]\.?\s?m\b\.?)?\s?(?:uhr|h\b|hrs)?"
    r"|t?(?P<h2>\d{2})(?P<mi2>\d{2})(?P<s2>\d{2})?(?:[.,](?P<f2>\d+))?(?=z|[+-]|\s|$|\[)"
)
OFFSET = re.compile(r"(?:(?:gmt|utc|z)\s?)?(?P<sign>[+-])(?P<oh>\d{1,2})(?::?(?P<om>\d{2}))?(?:\s*\(.*\)|\s*\[[\w/+-]+\])?$")
NAMED = re.compile(r"\[?(?P<iana>[a-z]+(?:/[a-z_+-]+)+)\]?$")
ABBREVIATION = re.compile(r"(?P<abbr>[a-z]{1,5})(?:\s*\(.*\))?$")
PREFIX = re.compile(r"(?:[^\W\d_]+\s*:\s*|(?:on|updated|published|posted|am|le|el|publié|veröffentlicht|publicado)\s+)+(?=\w)")
WEEKDAY = re.compile("(?:" + "|".join(sorted(DAYS, key=len, reverse=True)) + r")\b\.?\s*,?\s*")
EPOCH_TEXT = re.compile(r"(-?\d{9,11})(?:[.,](\d+))?$|(-?\d{13})(?:[.,](\d+))?$|(\d{16})$|(\d{19})$")
WRAPPED = re.compile(r"/date\((-?\d+)(?:[+-]\d{4})?\)/$")
#: Locales that write the month first in all-digit dates (fixed values).
MONTH_FIRST = {"en-US", "en-PH", "fil-PH"}


@functools.cache
def zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


@functools.cache
def known_zone(lower: str) -> ZoneInfo | None:
    """A zone by its name in lower case."""
    parts = ["/".join(x) for x in ([_title(p) for p in lower.split("/")],)]
    return zone(parts[0])


def _title(part: str) -> str:
    return "_".join("-".join(w if w in ("of", "es") else w.capitalize() for w in x.split("-")) for x in part.split("_"))


@functools.lru_cache(200_000)
def own_abbreviation(abbr: str, tz_name: str, day: int) -> int | None:
    """Minutes east of UTC of an abbreviation as the zone uses it on a day, or in that year's other season."""
    z = zone(tz_name) if tz_name else None
    if not z or not 366 < day < date.max.toordinal() - 366:
        return None
    for shift in (0, 182, -182, 91, -91):
        t = datetime.fromordinal(day + shift).replace(hour=12, tzinfo=z)
        n = (t.tzname() or "").lower()
        if n.isalpha() and (n == abbr or tz_name.startswith("Australia/") and n == "a" + abbr):  # written without the leading A there, too
            return int(t.utcoffset().total_seconds() // 60)
    return None


def _local(day: int, us: int, z: ZoneInfo | None) -> int | None:
    """Local wall time -> microseconds of UTC; None if the zone's clocks skip it or pass it twice."""
    if z is None:
        return None
    wall = datetime.fromordinal(day) + timedelta(microseconds=us)
    first, second = wall.replace(tzinfo=z, fold=0).utcoffset(), wall.replace(tzinfo=z, fold=1).utcoffset()
    if first != second:
        return None
    return (day - EPOCH) * 86_400_000_000 + us - int(first.total_seconds() * 1_000_000)


def _day(m: re.Match, locale: str | None) -> int | None:
    g = m.groupdict()
    y = int(g["y"])
    if len(g["y"]) == 2:
        y += 2000 if y < 69 else 1900
    try:
        if g.get("week"):
            return date.fromisocalendar(y, int(g["week"]), int(g["wd"])).toordinal()
        if g.get("doy"):
            out = date(y, 1, 1).toordinal() + int(g["doy"]) - 1
            return out if int(g["doy"]) and date.fromordinal(out).year == y else None
        if g.get("a"):
            if not locale:
                return None
            a, b = int(g["a"]), int(g["b"])
            mo, d = (a, b) if locale in MONTH_FIRST else (b, a)
        else:
            mo, d = MONTHS[g["mon"]] if g.get("mon") else int(g["m"]), int(g["d"])
        return date(y, mo, d).toordinal()
    except ValueError:
        return None


def parse_instant(text: str | None, tz_name: str | None, locale: str | None) -> int | None:
    """Microseconds since 1970-01-01 UTC of the one definite instant that text names, else None.

    None comes of null and empty texts, texts without a time of day, relative phrases, impossible dates and times (24:00 and
    second 60 among them), local times that clocks skip or pass twice, and local times of sources without a zone. An
    abbreviation has the offset that it had at the stated date. The text may be of any length. Digits beyond microseconds are cut.
    """
    if not text:
        return None
    s = " ".join(text.replace("−", "-").split()).lower()
    if m := EPOCH_TEXT.match(s):
        sec, frac, ms, msf, us, ns = m.groups()
        if sec:
            return int(sec) * 1_000_000 + (-1 if sec[0] == "-" else 1) * int(((frac or "") + "000000")[:6])
        if ms:
            return int(ms) * 1000 + int(((msf or "") + "000")[:3])
        return int(us) if us else int(ns) // 1000
    if m := WRAPPED.match(s):
        return int(m[1]) * 1000
    if m := PREFIX.match(s):
        s = s[m.end() :]
    if m := WEEKDAY.match(s):
        s = s[m.end() :]
    for p in DATES:
        if m := p.match(s):
            break
    else:
        return None
    day = _day(m, locale)
    if day is None:
        return None
    t = TIME.match(s, m.end())
    if not t:
        return None
    g = t.groupdict()
    h, mi, sec, f = (g["h"], g["mi"], g["s"], g["f"]) if g["h"] else (g["h2"], g["mi2"], g["s2"], g["f2"])
    h, mi, sec = int(h), int(mi), int(sec or 0)
    if g["ap"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["ap"][0] == "p" else 0)
    if h > 23 or mi > 59 or sec > 59:
        return None
    us = ((h * 60 + mi) * 60 + sec) * 1_000_000 + int(((f or "") + "000000")[:6])
    rest = s[t.end() :].strip()
    if rest.startswith("(") and rest.endswith(")"):
        rest = rest[1:-1].strip()
    if not rest:
        return _local(day, us, zone(tz_name)) if tz_name else None
    if m := OFFSET.match(rest):
        oh, om = int(m["oh"]), int(m["om"] or 0)
        if m["om"] is None and oh > 14 or oh > 18 or om > 59:
            return None
        minutes = (oh * 60 + om) * (-1 if m["sign"] == "-" else 1)
    elif m := NAMED.match(rest):
        return _local(day, us, known_zone(m["iana"]))
    elif m := ABBREVIATION.match(rest):
        minutes = own_abbreviation(m["abbr"], tz_name or "", day)
        if minutes is None:
            minutes = own_abbreviation(m["abbr"], HOMES.get(m["abbr"], ""), day)
        if minutes is None:
            minutes = ZONES.get(m["abbr"])
        if minutes is None:
            return None
    else:
        return None
    return (day - EPOCH) * 86_400_000_000 + us - minutes * 60_000_000
