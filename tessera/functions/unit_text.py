"""Quantities in running text: numbers in figures or words, and unit strings segmented over tries of prefixes, roots and
exponents."""

from __future__ import annotations

import re

#: Multiples that stand before a currency, with or without a blank (fixed values).
SCALES = {
    1e3: "k|thousand|thousands|thousands of|tausend|tsd|mille|milliers|milliers de|mil|miles|miles de|tds",
    1e5: "l|lakh|lakhs|lac|lacs",
    1e6: "m|mn|mm|million|millions|mio|millionen|millón|millones",
    1e7: "cr|crore|crores",
    1e9: "bn|billion|billions|mrd|milliarde|milliarden|milliard|milliards",
}
#: Decimal prefixes, which stand before a root without a blank (fixed values).
PREFIXES = {
    1e6: "mega|méga|megá", 1e3: "k|kilo|kiló", 1e2: "h|hecto|hekto|hectó", 1e1: "da|deca|deka|déca|decá", 1e-1: "d|deci|dezi|déci|decí",
    1e-2: "c|centi|zenti|centí", 1e-3: "m|milli|mili|milí", 1e-6: "µ|μ|micro|mikro|micró", 1e-9: "n|nano",
}
#: Roots by dimension and unit (fixed values).
ROOTS = {
    ("currency", "USD"): "$|usd|us$|us-$|dollar|dollars|u.s. dollars|u.s. dollar|us dollars|us dollar|dólares|dólares estadounidenses|dollars us",
    ("currency", "EUR"): "€|eur|euro|euros",
    ("currency", "GBP"): "£|gbp|pound|pounds|pounds sterling|pfund|livres|livres sterling|libras|libras esterlinas",
    ("currency", "INR"): "₹|inr|rs|rupee|rupees|rupien|roupies|rupias",
    ("currency", "CHF"): "chf|sfr|franken|francs|swiss francs|francs suisses|schweizer franken|francos suizos",
    ("currency", "CAD"): "ca$|c$|can$|cad|canadian dollars|canadian dollar|dollars canadiens|dólares canadienses|kanadische dollar",
    ("time", "decade"): "decade|decades|jahrzehnt|jahrzehnte|jahrzehnten|décennie|décennies|década|décadas",
    ("time", "lustrum"): "lustro|lustros",
    ("time", "year"): "yr|yrs|year|years|annum|jahr|jahre|jahren|jahres|an|ans|année|années|año|años",
    ("time", "month"): "mo|mos|mth|mths|month|months|monat|monate|monaten|mois|mes|meses",
    ("time", "week"): "wk|wks|w|week|weeks|woche|wochen|semaine|semaines|semana|semanas",
    ("time", "day"): "d|day|days|tag|tage|tagen|jour|jours|día|días|dia|dias",
    ("time", "hour"): "h|hr|hrs|hour|hours|std|stdn|stunde|stunden|heure|heures|hora|horas",
    ("time", "minute"): "min|mins|minute|minutes|minuten|minuto|minutos",
    ("time", "second"): "s|sec|secs|second|seconds|sekunde|sekunden|seconde|secondes|segundo|segundos",
    ("length", "metre"): "m|metre|metres|meter|meters|metern|mètre|mètres|metro|metros|mètre|mètres",
    ("length", "mile"): "mi|mile|miles|meile|meilen|milla|millas|mille|milles",
    ("share", "full time"): "fte|ftes|vzä|etp",
    ("percent", "%"): "%|percent|per cent|prozent|pour cent|por ciento",
    ("full", "full time"): (
        "full time|full-time|fulltime|full position|vollzeit|vollzeitstelle|einer vollzeitstelle|temps plein|temps complet|jornada completa|tiempo completo|einer stelle"
    ),
}
#: Words that say "per" a period by themselves (fixed values).
ADVERBS = {
    "year": "annually|yearly|annual|p.a|p. a|pa|jährlich|annuel|annuels|annuelle|annuellement|anual|anuales|anualmente|im jahr|par an|/an|l'an|al año",
    "month": "monthly|monatlich|mensuel|mensuels|mensuelle|mensual|mensuales|mensualmente|pm|p.m|p. m",
    "week": "weekly|wöchentlich|hebdomadaire|hebdomadaires|semanal|semanales|semanalmente",
    "day": "daily|täglich|journalier|journaliers|journalière|par jour|diario|diarios|diaria|daily rate",
    "hour": "hourly|stündlich|horaire|horaires|por hora",
}
#: Exponents, before or after a root (fixed values).
EXPONENTS = {2: "²|^2|squared|carrés|carré|cuadrados|cuadrado", 3: "³|^3|cubed|cubes|cúbicos", -1: "⁻¹|^-1"}
LEADING = {2: "sq|sq.|square|quadrat", 3: "cubic|cu|kubik"}
#: Words between a unit and its divisor, and words that change nothing (fixed values).
PER = "/|d'|d'un|d'une|d’|d’un|d’une|per|a|an|each|every|pro|je|im|in|der|die|am|par|de|del|della|al|à|la|le|por|un|una|l'|el|the|cada|los|las|x|p|of"
NOISE = "gross|net|netto|brutto|brut|bruts|brute|brutos|bruto|before tax|before taxes|base"

#: Prior of each kind of atom for each field: how readily a string is read so where the field is expected (fixed values).
PRIOR = {
    "pay": {"scale": 2, "currency": 3, "time": 1, "adverb": 2, "per": 1, "noise": 0.2},
    "experience": {"time": 3},
    "distance": {"length": 3, "prefix": 1, "exponent": 1, "time": 0.5, "per": 0.1},
    "worktime": {"time": 3, "share": 3, "percent": 3, "full": 3, "adverb": 2, "per": 1},
}


def _trie(words: list[tuple[str, object]]) -> dict:
    root: dict = {}
    for word, value in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault(None, []).append(value)
    return root


def _atoms() -> list[tuple[str, tuple[str, object]]]:
    out = [(w, kind) for kind, words in ROOTS.items() for w in words.split("|")]
    out += [(w, ("scale", x)) for x, words in SCALES.items() for w in words.split("|")]
    out += [(w, ("adverb", x)) for x, words in ADVERBS.items() for w in words.split("|")]
    out += [(w, ("exponent", x)) for x, words in EXPONENTS.items() for w in words.split("|")]
    out += [(w, ("leading", x)) for x, words in LEADING.items() for w in words.split("|")]
    return out + [(w, ("per", None)) for w in PER.split("|")] + [(w, ("noise", None)) for w in NOISE.split("|")]


#: Whole atoms; and metric prefixes, after which a root must follow at once.
UNITS, METRIC = _trie(_atoms()), _trie([(w, ("prefix", x)) for x, words in PREFIXES.items() for w in words.split("|")])
BLANK = " \u00a0\u202f\u2009"
#: Roots that decimal prefixes stand before; and kinds that can't end a unit string.
PREFIXED, OPEN = ("length",), ("per", "noise", "prefix", "leading")


def _walk(trie: dict, s: str, j: int):
    """(end, atoms) of all words of the trie at s[j:]; one blank of a word stands for one or several of any kind."""
    node, k = trie, j
    while k < len(s):
        c = s[k]
        if c in BLANK:
            node = node.get(" ")
            if node is None:
                return
            while k < len(s) and s[k] in BLANK:
                k += 1
        else:
            node = node.get(c)
            if node is None:
                return
            k += 1
        if None in node:
            yield k, node[None]


def segment(s: str, field: str, start: int = 0) -> tuple[int, list[tuple[str, object]]]:
    """The best decomposition of a prefix of s[start:] (lower case) into prefixes, roots, exponents and words between: where
    it ends, and its atoms.

    Dynamic programming over (position, whether a root must follow, periods so far). Blanks between atoms are free. A decomposition
    scores by the characters that it explains and by the field's prior for each atom's kind; between equal ones longer
    atoms win. It ends with a word, and is as long as atoms follow one another.
    """
    prior, most = PRIOR[field], 2 if field == "worktime" else 1
    first = (start, False, 0)
    best: dict[tuple[int, bool, int], tuple] = {first: (0.0, None, None)}
    todo, final, final_score = [first], first, 0.0
    while todo:
        state = min(todo)
        todo.remove(state)
        i, bound, periods = state
        score, _, last = best[state]
        before = last and last[0]
        j = i
        if not bound:
            while j < len(s) and s[j] in BLANK and j - i < 2:
                j += 1
            if s[j : j + 1] == "." and (j > i or before in ("scale", "time", "currency")):
                j += 1  # "tsd. €", "std./woche"
                while j < len(s) and s[j] in BLANK:
                    j += 1
        tight = j == i > start and s[i : i + 1].isalpha() and s[i - 1].isalpha()
        steps = [(k, a) for k, atoms in _walk(UNITS, s, j) for a in atoms if not bound or a[0] in PREFIXED]
        if not bound and field == "distance":
            steps += [(k, a) for k, atoms in _walk(METRIC, s, j) for a in atoms]
        for k, atom in steps:
            kind, glued = atom[0], s[k - 1].isalpha() and k < len(s) and s[k].isalpha()
            if kind == "prefix":
                if not glued:
                    continue
            elif glued and not (kind == "scale" and _currency_at(s, k) or s[k : k + 2] == "pa" and not s[k + 2 : k + 3].isalpha()):
                continue
            if tight and not bound and before != "scale" and s[j:k] != "pa" or kind == "exponent" and before not in ("length", "time"):
                continue
            if atom == ("time", "year") and field != "experience" and s[j:k] == "an":
                continue  # "an hour"
            if kind in ("time", "adverb") and (periods == most or before in ("time", "share", "percent", "full") and kind == "time"):
                continue  # "0.9 FTE Day to day ...": a further period needs a sign of "per"
            new = score + prior.get(kind, 0) + 0.5 * (k - j) + 0.01 * (k - j) ** 2
            state_k = (k, kind == "prefix", periods + (kind in ("time", "adverb")))
            if state_k not in best or new > best[state_k][0]:
                if state_k not in best:
                    todo.append(state_k)
                best[state_k] = (new, state, atom)
                if kind not in OPEN and new > final_score:
                    final, final_score = state_k, new
    atoms, state = [], final
    while state != first:
        _, previous, atom = best[state]
        atoms.append(atom)
        state = previous
    return final[0], atoms[::-1]


def _currency_at(s: str, k: int) -> bool:
    return any(a[0] == "currency" and not s[end : end + 1].isalpha() for end, atoms in _walk(UNITS, s, k) for a in atoms)


def dimension(atoms: list[tuple[str, object]]) -> tuple[int, int, int]:
    """The exponents of money, time and length of a decomposition; a time or length after "per" divides."""
    money = time = length = 0
    per, lead, roots = False, 1, 0
    last = None
    for kind, value in atoms:
        if kind == "per":
            per = True
        elif kind == "leading":
            lead = value
        elif kind == "adverb":
            time, roots = time - 1, roots + 1
        elif kind == "exponent":
            if last == "length":
                length += (value - 1) if not per or roots == 1 else 0
            elif last == "time":
                time += value - 1
        elif kind in ("currency", "time", "length"):
            sign = -1 if per and kind != "currency" else 1
            money, time, length = money + (kind == "currency"), time + sign * (kind == "time") * lead, length + sign * (kind == "length") * lead
            per, lead, last, roots = False, 1, kind, roots + 1
        elif kind in ("share", "percent", "full"):
            per, roots = False, roots + 1
    return money, time, length


# -- numbers -----------------------------------------------------------------------------------------------------------
#: Number words of en, de, fr and es (fixed values).
NUMBER_WORDS = {
    1: "one ein eins eine einem einer un une uno una", 2: "two zwei deux dos", 3: "three drei trois tres", 4: "four vier quatre cuatro",
    5: "five fünf cinq cinco", 6: "six sechs seis", 7: "seven sieben sept siete", 8: "eight acht huit ocho", 9: "nine neun neuf nueve",
    10: "ten zehn dix diez", 11: "eleven elf onze once", 12: "twelve zwölf douze doce", 13: "thirteen dreizehn treize trece",
    14: "fourteen vierzehn quatorze catorce", 15: "fifteen fünfzehn quinze quince", 16: "sixteen sechzehn seize dieciséis",
    17: "seventeen siebzehn diecisiete", 18: "eighteen achtzehn dieciocho", 19: "nineteen neunzehn diecinueve", 20: "twenty zwanzig vingt vingts veinte",
    21: "veintiuno veintiún", 22: "veintidós", 23: "veintitrés", 24: "veinticuatro", 25: "veinticinco", 26: "veintiséis", 27: "veintisiete", 28: "veintiocho",
    29: "veintinueve", 30: "thirty dreißig trente treinta", 40: "forty fourty vierzig quarante cuarenta", 50: "fifty fünfzig cinquante cincuenta",
    60: "sixty sechzig soixante sesenta", 70: "seventy siebzig setenta", 80: "eighty achtzig quatrevingt quatrevingts ochenta", 90: "ninety neunzig noventa",
    100: "hundred hundert cent cents cien ciento", 200: "doscientos", 300: "trescientos", 400: "cuatrocientos", 500: "quinientos", 1000: "thousand tausend mille mil",
}
NUMBERS = _trie([(w, n) for n, words in NUMBER_WORDS.items() for w in words.split()])
JOINERS = ("und", "and", "et", "y", "-")
#: Articles and fractions before a unit; words that may stand between; what adds a half after the unit (fixed values).
PARTS = {
    0.5: r"half an?|an? half|ein(?:e[nrm]?)? halbe[sn]?|halbe[sn]?|(?:une? )?demie?[- ]?|media|medio|medi[ao] (?=d|a)",
    1.5: r"one and a half|anderthalb|eineinhalb|un[ae]? et demie?",
    12: r"an? dozen|ein dutzend|une douzaine d['’e]|una docena de",
    1: r"an?|ein(?:e[nrms]?)?|une?|una?",
}
PART = [(x, re.compile(rf"(?:{p})(?:\s+|(?<=[-'’]))(?:(?:full|whole|good|solid|ganze[sn]?|volle[sn]?|gute[sn]?|bonne|bon|pleine?|buena|buen|entera?)\s+)?(?=\w)")) for x, p in PARTS.items()]
AND_HALF = re.compile(r"\s+(?:and a half|et demie?|y medi[ao])\b")
FIGURE = re.compile(r"\d{1,3}(?:(?P<sep>[.,'’ \u00a0\u202f\u2009])\d{2,3}(?=(?P=sep)\d{3}))*(?P<last>[.,'’ \u00a0\u202f\u2009])\d{3}(?!\d)(?:[.,]\d{1,2}(?!\d))?|\d+(?:[.,]\d+)?")


def figure(s: str, i: int) -> tuple[float, int] | None:
    """The number in figures at s[i:], with any usual grouping, and where it ends."""
    m = FIGURE.match(s, i)
    if not m:
        return None
    t = m[0]
    if m["last"]:
        if t[0] == "0" and m["last"] in ".,":  # "0.875"
            return float(t.replace(",", ".")), m.end()
        tail = re.search(r"[.,]\d{1,2}$", t)
        whole = t[: tail.start()] if tail else t
        return float(re.sub(r"\D", "", whole) + (f".{tail[0][1:]}" if tail else "")), m.end()
    return float(t.replace(",", ".")), m.end()


def worded(s: str, i: int) -> tuple[float, int] | None:
    """The number in words at s[i:] (lower case), and where it ends: the longest that ends with a word."""
    total = current = 0
    j, found = i, None
    while j < len(s):
        node, k, hit = NUMBERS, j, None
        while k < len(s) and (node := node.get(s[k])) is not None:
            k += 1
            if None in node:
                hit = (node[None][0], k)
            if s[k : k + 1] == "-" and s[j:k] == "quatre" and s[k + 1 : k + 6] == "vingt":
                k += 1
        if hit is None:
            break
        n, j = hit
        if n == 1000:
            total, current = total + max(current, 1) * 1000, 0
        elif n == 100:
            current = max(current, 1) * 100 if current < 100 else current + 100
        else:
            current += n
        if not s[j : j + 1].isalpha():
            found = float(total + current), j
        while s[j : j + 1] in ("-", " ", "\u00a0"):
            j += 1
        for w in ("und", "and ", "et ", "y "):
            if s.startswith(w, j) and _number_at(s, j + len(w)):
                j += len(w)
                break
    return found


def parted(s: str, i: int) -> tuple[float, int] | None:
    """An article or a fraction ("half a", "anderthalb") before a word, and where it ends."""
    for x, p in PART:
        if m := p.match(s, i):
            return x, m.end()
    return None


def _number_at(s: str, i: int) -> bool:
    node = NUMBERS
    while i < len(s) and (node := node.get(s[i])) is not None:
        i += 1
        if None in node:
            return True
    return False


def number(s: str, i: int) -> tuple[float, int] | None:
    return figure(s, i) if i < len(s) and s[i].isdigit() else worded(s, i)
