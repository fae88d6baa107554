"""What a posting's text states of pay, experience, commuting distance and working time: units first, then their context."""

from __future__ import annotations

import math
import re
from bisect import bisect_left

from .unit_text import AND_HALF, BLANK, NUMBER_WORDS, dimension, number, parted, segment

#: What a sentence about each quantity speaks of, in en, de, fr and es (fixed values); "+" at an end marks a stem, which
#: any letters may follow, "+" at the start also one that may stand within a word.
TOPICS = {
    "pay": (
        "salar+ pay paid pays wage+ compensat+ remunerat+ earn+ budgeted band bands rate expect+ we_offer stipulat+ +gehalt+ +gehält+ +vergüt+ entlohn+ +lohn bezahl+ zahlen zahlt verdien+ "
        "salair+ rémunér+ payons paie payé+ versons verse fourchette+ proposons gagne+ sueldo+ retribu+ pagamos paga pagan banda ofrecemos percib+ cobrar+ remunera+"
    ),
    "experience": (
        "experienc+ practice practise+ background prior_work previous_work worked track_record seniority +erfahrung+ +praxis+ vorkenntnis+ "
        "expérience+ pratique+ ancienneté experiencia+ práctica+ trayectoria antigüedad"
    ),
    "distance": (
        "live lives living home reside+ residing commut+ radius away distance farther further drive within office wohn+ +wohnort+ +arbeitsweg+ umkreis+ pendel+ entfern+ anfahrt+ "
        "résid+ domicil+ habit+ rayon trajet+ radio resid+ vivir vivas domicilio+ distancia+ desplaz+ trayecto+"
    ),
    "worktime": (
        "work works working hours week weekly schedule position post role job workload full-time part-time +arbeitszeit+ arbeit+ umfang stelle wochenstunden stunden pensum +zeitmodell "
        "travail+ temps volume durée poste horaire+ jornada+ dedicación trabaj+ horas puesto"
    ),
}
#: What a sentence about other money, time, distances and hours speaks of (fixed values).
OTHERS = (
    "bonus+ +prämie+ prime primes budget budgets +budget fund funds funding fondo+ raised raises round revenue+ turnover sales umsatz+ +finanz+ levé captó ingresos chiffre_d'affaires "
    "pension+ retirement 401k matching allowance+ stipend+ equity +zuschuss+ zuschüsse subvention+ ayuda "
    "founded since existe+ gegründet gibt fundad+ contract+ contrat+ contrato+ +vertrag+ befristet notice préavis preaviso +kündigung+ probation probezeit vacation holiday+ leave urlaub+ congés vacaciones "
    "viewed users customers readers partners readership fibre glasfaser fibra fleet vans support supported staffed open opening deliver+ train+ formation formación learning lern+ "
    "valid cookie+ consent session ago old age retention stored"
)
#: Words for units of figures that stand elsewhere in the record (fixed values).
UNIT_LABELS = (
    "figures|amounts|currency|basis|period|unit|units|montants|devise|base|période|unité|beträge|währung|abrechnung|zeitraum|einheit|importes|moneda|periodo|período|unidad"
)
LABEL = re.compile(rf"(?<!\w)(?:{UNIT_LABELS})(?!\w)[^\n.;:0-9]*?(?::|\bin\b|\ben\b)")
AFTER_LABEL = re.compile(r"\s*(?:(?:in|en|the|der|per|pro)\s+)?[(\[]?\s*")
#: Ends of sentences and list items; abbreviations end no sentence (fixed values).
STOP = re.compile(r"[\n;!?]|\.(?=\s|$)|\s[-–—*•]\s(?=[^\W\d_])")
SHORT = re.compile(r"(?:\b(?:approx|ca|min|max|mind|inkl|incl|rs|sfr|u\.s|z\.b|bzw|tsd|mio|mrd|std|nr|n|no|st|mr|mrs|dr|p\.a|env)|\b[a-z])$")
#: Words between a topic and a bare figure of it (fixed values).
LEADS = re.compile(
    r"(?:\s|[:(~≥>=]|(?:is|are|of|at|from|for|between|range|ranges|up to|approx\.?|about|around|min\.?|minimum|at least|more than|over|"
    r"liegt|bei|beträgt|von|ab|zwischen|mindestens|mehr als|über|bis zu|ca\.?|brut|brute|bruta|bruto|brutto|gross|annoncée|anunciada|salarial|"
    r"est|de|d'|entre|au moins|plus de|à partir de|es|desde|al menos|más de|mínimo|un mínimo de|un|una|a|the)(?!\w))*"
)
BETWEEN = re.compile(r"\s*(?:[-–—]|\bto\b|\bbis\b|\bà\b|\ba\b|\band\b|\bund\b|\bet\b|\by\b)\s*")
JOINED = re.compile(r"\s*(?:and|und|et|y)\s+")
MONEY_BEFORE = re.compile(r"(us\s?\$|ca\s?\$|c\$|\$|€|£|₹|usd|eur|gbp|chf|sfr\.?|cad|inr|rs\.?)\s?(?:between\s+|from\s+|de\s+|entre\s+|zwischen\s+)?")
MONEY_SIGN = re.compile(r"(?:(?<!\w)(?:us\s?\$|ca\s?\$|c\$|usd|eur|gbp|chf|sfr\.?|cad|inr|rs\.?)|[$€£₹])\s?(?:(?:between|from|de|entre|zwischen)\s+)?$")
SIGNS = {"us$": "USD", "$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP", "₹": "INR", "inr": "INR", "rs": "INR", "chf": "CHF", "sfr": "CHF", "ca$": "CAD", "c$": "CAD", "cad": "CAD"}
CLOCK = re.compile(r"(\d{1,3})(?::|h)(\d{2})\b(?!\s*[ap]\.?m)")
#: Where a number may start in a sentence on a topic: figures, number words, articles and fractions.
START = re.compile(
    r"(?<![\w.,])\d|(?<=[a-z$€£₹])(?<![a-z]{4})\d|(?<![^\W\d_])(?:"
    + "|".join(sorted({w for words in NUMBER_WORDS.values() for w in words.split() if not w.startswith(("un", "ein"))}, key=len, reverse=True))
    + r"|(?:an?|half|halbe[sn]?|ein\w{0,2}|une?|una|uno?|demie?|media|medio)(?=[\s-])|anderthalb|ein\w*und|eineinhalb)"
)
#: Where a figure of working time may start in any sentence.
WORK = re.compile(r"(?<![\w.,])\d[\d.,:]*\s?(?=h|std|stund|min|fte|vz|etp|%|per|pro|por|pour)")
#: Months of longer spans (fixed values).
YEARS = {"decade": 10, "lustrum": 5}


def _stems() -> list[tuple[str, str, bool, bool]]:
    out = []
    for field, words in [*TOPICS.items(), ("", OTHERS)]:
        for w in words.split():
            out.append((w.strip("+").replace("_", " "), field, w.startswith("+"), w.endswith("+")))
    return out


#: (stem, field, may start within a word, may end within one)
STEMS = _stems()


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    by_stem: dict[str, list] = {}
    for stem, field, inner, open_ in STEMS:
        by_stem.setdefault(stem, []).append((field, len(stem), inner, open_))
    for stem, value in by_stem.items():
        a.add_word(stem, tuple(value))
    a.make_automaton()
    return a


class Value:
    __slots__ = ("x", "sign", "atoms", "end", "start")

    def __init__(self, x: float, sign: str | None, atoms: list, end: int, start: int = 0):
        self.x, self.sign, self.atoms, self.end, self.start = x, sign, atoms, end, start


def _kinds(atoms: list, kind: str) -> list:
    return [v for k, v in atoms if k == kind]


def _value(s: str, i: int, field: str) -> Value | None:
    """One figure with the sign before it and the unit string after it."""
    sign = None
    if field == "pay" and (m := MONEY_BEFORE.match(s, i)):
        sign, i = SIGNS[m[1].rstrip(".").replace(" ", "")], m.end()
    if field == "worktime" and (m := CLOCK.match(s, i)):
        x, j = int(m[1]) + int(m[2]) / 60, m.end()
        end, atoms = segment(s, field, j)
        if s[m.end(1)] == "h":
            return Value(x, None, [("time", "hour"), *atoms], max(end, j))
        return Value(x, None, atoms, max(end, j))
    n = number(s, i)
    if (not n or n[0] == 1 and not s[i].isdigit()) and field in ("experience", "distance") and (p := parted(s, i)):
        n = p
    if not n:
        return None
    x, j = n
    if m := AND_HALF.match(s, j):
        x, j = x + 0.5, m.end()
    while s[j : j + 1] == "+":
        j += 1
    end, atoms = segment(s, field, j)
    if field == "pay" and atoms and atoms[0][0] == "time":
        end, atoms = j, []  # "98 to 110 Day to day you ...": a period needs a sign of "per" or a currency before it
    end = max(end, j)
    if field == "experience" and atoms and (m := AND_HALF.match(s, end)):
        x, end = x + 0.5, m.end()
    if atoms and atoms[-1][0] == "scale" and s[end : end + 1] == ".":
        end += 1
    return Value(x, sign, atoms, end)


def _fits(v: Value, field: str) -> bool:
    """Whether the unit string has the dimension of the field."""
    money, time, length = dimension(v.atoms)
    if field == "pay":
        return length == 0 and time in (0, -1) and (money == 1 or money == 0)
    if field == "experience":
        return (money, time, length) == (0, 1, 0) and _kinds(v.atoms, "time")[0] in ("year", "month", "week", "decade", "lustrum")
    if field == "distance":
        return (money, time, length) == (0, 0, 1)
    kinds = {k for k, _ in v.atoms}
    if money or length:
        return False
    if kinds & {"share", "percent"}:
        return time == 0
    t = _kinds(v.atoms, "time")
    return bool(t) and t[0] in ("hour", "minute") and time in (0, 1)


def _complete(v: Value, field: str) -> bool:
    """Whether the unit string alone says that it is the field's."""
    kinds = {k for k, _ in v.atoms}
    if field == "worktime":
        return "share" in kinds or {"percent", "full"} <= kinds or bool(_kinds(v.atoms, "time")) and dimension(v.atoms)[1] == 0
    return False


def measured(s: str, i: int, field: str) -> list[Value] | None:
    """The figure, or the two ends of a range, that start at s[i:], if their units are of the field's dimension."""
    v = _value(s, i, field)
    if not v:
        return None
    if field == "experience" and (m := JOINED.match(s, v.end)) and (w := _value(s, m.end(), field)) and _kinds(w.atoms, "time") == ["month"] and _kinds(v.atoms, "time") == ["year"]:
        v.x, v.end = v.x + w.x / 12, w.end
        return [v]
    if m := BETWEEN.match(s, v.end):
        w = _value(s, m.end(), field)
        if w and (w.x >= v.x or _kinds(w.atoms, "scale")) and (w.atoms and _fits(w, field) or field == "pay" and not w.atoms) and (not v.atoms or _fits(v, field)):
            return [v, w]
    if (v.atoms or field == "pay") and _fits(v, field):
        return [v]
    return None


class Factors:
    """The factors of the table of units (quantity, unit) -> factor."""

    def __init__(self, rows: list[tuple[str, str, float]]):
        self.of = {(q, u): f for q, u, f in rows}

    def result(self, values: list[Value], field: str, header: dict) -> tuple[int, int] | None:
        out = getattr(self, "_" + field)(values, header)
        if out is None or any(x is None for x in out):
            return None
        low, high = (math.floor(x + 0.5 + 1e-9) for x in (out[0], out[-1]))
        return low, high

    def _experience(self, values, header):
        unit = next((t[0] for v in reversed(values) if (t := _kinds(v.atoms, "time"))), None)
        out = []
        for v in values:
            u = (_kinds(v.atoms, "time") or [unit])[0]
            f = self.of.get(("experience", "year" if u in YEARS else u))
            out.append(None if f is None else v.x * f * YEARS.get(u, 1))
        return out

    def _distance(self, values, header):
        last = next(v.atoms for v in reversed(values) if _kinds(v.atoms, "length"))
        out = []
        for v in values:
            atoms = v.atoms if _kinds(v.atoms, "length") else last
            f = self.of.get(("distance", _kinds(atoms, "length")[0]))
            for p in _kinds(atoms, "prefix"):
                f = f and f * p
            out.append(None if f is None else v.x * f)
        return out

    def _worktime(self, values, header):
        atoms = values[-1].atoms
        kinds = {k for k, _ in atoms}
        full = self.of.get(("worktime", "full time"))
        out = []
        for v in values:
            if kinds & {"share", "percent"}:
                out.append(None if full is None else v.x * full / (1 if "share" in kinds else 100))
            else:
                t = [v for k, v in atoms if k in ("time", "adverb")]
                f = self.of.get(("worktime", f"{t[0]} per {t[1] if len(t) > 1 else 'week'}")) if t else None
                out.append(None if f is None else v.x * f)
        return out

    def _pay(self, values, header):
        currency = next((c for v in values for c in ([v.sign] if v.sign else _kinds(v.atoms, "currency"))), None) or header.get("currency")
        last = values[-1].atoms
        period = next((v for k, v in last if k in ("time", "adverb")), header.get("period"))
        if currency is None and any(x in (1e5, 1e7) for v in values for x in _kinds(v.atoms, "scale")):
            currency = "INR"  # counted in lakhs and crores
        c, p = self.of.get(("pay_currency", currency)), self.of.get(("pay_period", period))
        if c is None or p is None:
            return None
        stated = bool(values[-1].sign or _kinds(last, "currency"))
        scales = [_kinds(v.atoms, "scale") for v in values]
        if not stated and not scales[-1] and header.get("scale"):
            scales = [[header["scale"]]] * len(values)
        out = []
        for v, own in zip(values, scales):
            scale = own[0] if own else 1
            if not own and scales[-1] and len(values) > 1 and v.x <= values[-1].x:  # "128-138k": one scale for both ends
                scale = scales[-1][0]
            out.append(v.x * scale * c * p)
        return out


class Context:
    """Sentences of a text and the topics spoken of in them."""

    def __init__(self, s: str, known):
        self.s = s
        best: dict[int, tuple[int, str]] = {}
        for last, stems in known.iter(s):
            end = last + 1
            for field, n, inner, open_ in stems:
                start = end - n
                if not inner and start and s[start - 1].isalnum() or not open_ and s[end : end + 1].isalnum():
                    continue
                if end > best.get(start, (0, ""))[0]:
                    best[start] = (end, field)
        self.topics: list[tuple[int, int, str]] = []
        reach = -1
        for start in sorted(best):
            end, field = best[start]
            if start >= reach:
                while end < len(s) and s[end].isalpha():
                    end += 1
                self.topics.append((start, end, field))
                reach = end
        self.starts = [t[0] for t in self.topics]
        self.stops = [m.start() for m in STOP.finditer(s) if m[0] != "." or not SHORT.search(s, max(0, m.start() - 8), m.start())]

    def figures(self):
        """(place, sentence start, sentence end, fields) of all numbers that may be a figure of a field."""
        found = {m.start(): ("worktime",) for m in WORK.finditer(self.s)}
        spans: dict[tuple[int, int], set[str]] = {}
        for start, _, field in self.topics:
            if field:
                spans.setdefault(self.sentence(start), set()).add(field)
        for (a, b), fields in spans.items():
            known = tuple(f for f in TOPICS if f in fields or f == "worktime")
            for m in START.finditer(self.s, a, b):
                found[m.start()] = known
        for i in sorted(found):
            yield (i, *self.sentence(i), found[i])

    def sentence(self, i: int) -> tuple[int, int]:
        k = bisect_left(self.stops, i)
        return (self.stops[k - 1] + 1 if k else 0), (self.stops[k] if k < len(self.stops) else len(self.s))

    def spoken(self, a: int, b: int, i: int, j: int, field: str) -> tuple[str | None, int]:
        """What is spoken of nearest before a figure s[i:j] in the sentence s[a:b], else after it: the field, "" for
        another matter, None for nothing; and where that word ends (-1 if it stands after the figure)."""
        lo, mid, after, hi = (bisect_left(self.starts, x) for x in (a, i, j, b))
        for k in range(mid - 1, lo - 1, -1):
            if self.topics[k][2] in (field, ""):
                return self.topics[k][2], self.topics[k][1]
        for k in range(after, hi):
            if self.topics[k][2] in (field, ""):
                return self.topics[k][2], -1
        return None, -1


def read_labels(s: str) -> tuple[dict, list[tuple[int, int]]]:
    """Currency, scale and period that the record states for its bare figures, and where it does."""
    out: dict = {}
    spans = []
    for m in LABEL.finditer(s):
        start = AFTER_LABEL.match(s, m.end()).end()
        end, atoms = segment(s, "pay", start)
        if not atoms:
            continue
        spans.append((m.start(), end))
        if more := re.compile(r"\s*[(\[]\s*").match(s, end):  # "USD (thousands)"
            atoms = atoms + [a for a in segment(s, "pay", more.end())[1] if a[0] == "scale"]
        for kind, key in (("currency", "currency"), ("scale", "scale"), ("time", "period"), ("adverb", "period")):
            for v in _kinds(atoms, kind):
                out.setdefault(key, v)
    return out, spans


def quantities(text: str, known, factors: Factors) -> list[tuple[str, int, int]]:
    """(quantity, low, high) of a text in lower case; known is the automaton of topics."""
    s = text
    context = Context(s, known)
    header, labels = read_labels(s)
    done: dict[str, tuple[int, int]] = {}
    past = -1
    for at_figure, a, b, fields in context.figures():
        i = at_figure
        if i < past or len(done) == 4 or any(x <= i < y for x, y in labels):
            continue
        if "pay" in fields and (sign := MONEY_SIGN.search(s, max(0, i - 16), i)):
            i = sign.start()
        for field in fields:
            if field in done:
                continue
            values = measured(s, i if field == "pay" else at_figure, field)
            if not values:
                continue
            end = values[-1].end
            said, at = context.spoken(a, max(b, end), i, end, field)
            if said == "" or said is None and not _complete(values[-1], field):
                continue
            if field == "pay":
                bare = not (values[-1].sign or values[0].sign or any(_kinds(v.atoms, "currency") for v in values))
                if bare and (at < 0 or LEADS.fullmatch(s, at, i) is None):
                    continue
            if r := factors.result(values, field, header):
                done[field] = r
                past = end
                break
    return [(k, *v) for k, v in done.items()]


__all__ = ["BLANK", "Factors", "automaton", "measured", "quantities", "read_labels"]
