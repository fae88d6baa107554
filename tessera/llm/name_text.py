"""Names as typed: what remains of a spelling once decoration is gone, and how far it is from an entity's profile."""

from __future__ import annotations

import functools
import re
import unicodedata

#: Legal forms of firms (fixed values).
LEGAL = set(
    "inc incorporated llc llp lp ltd limited corp corporation company plc gmbh ag sa bv co kg kgaa ohg ug sl se sarl sas sasu nv oy oyj ab as aps spa srl pty pte lda sro kft zrt doo".split()
)
#: Connecting words; and those that are initials elsewhere, which count between words only (fixed values).
LINKS, SHORT_LINKS = {"and", "und", "et", "amp", "the", "of", "for"}, {"y", "e", "i", "o"}
#: Legal forms long enough to be mistyped (fixed values).
LONG_LEGAL = tuple(w for w in LEGAL if len(w) > 6)
#: Words for who publishes postings rather than for a name (fixed values).
ROLES = set(
    "careers career jobs job talent acquisition hiring team recruiting recruiter recruitment hr human resources people staffing staff group holding holdings partner partners manager department office official page account".split()
)
HEAD = re.compile(r"^(?:(?:recruiter|contact|author|publisher|company|employer|firm|hr)\b\s*:?\s+|(?:posted|published|written|sent|offered|shared)?\s*\b(?:by|from|via|von|par|por)\b\s*:?\s+)")
VIA = re.compile(r"\s+via\s+[\w.]+$")
TITLES = re.compile(r"\b(?:dr|prof|mr|mrs|ms|herr|frau|mme|sr|sra|ing|dipl|mag)\.\s*|,?\s*\b(?:m\.?\s?sc|b\.?\s?sc|ph\.?\s?d|mba|m\.?a|b\.?a|m\.?eng|ll\.?m)\.?\s*$")
MAIL = re.compile(r"(?:\"?([^\"<@]*?)\"?\s*<)?([\w.+-]+)@([\w.-]+)>?\s*(?:\((.*)\))?$")
DOMAIN = re.compile(r"(?:https?://)?(?:www\.)?([\w-]{4,})(?:\.[a-z]{2,})+/?$")
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"})
#: Familiar forms of given names in English, German and Spanish that no rule of familiar_form gives: a default, which
#: callers may replace (fixed values).
NICKNAMES = {
    "albert": "bert", "alexander": "sasha sascha alec sandy xander", "alexandra": "sandra sasha lexi", "alfred": "fred", "andrea": "andi", "andrew": "drew", "angelica": "angie", "ann": "nancy nan", "anthony": "toni", "antonio": "toño",
    "arnold": "arnie", "barbara": "babs barb", "benedict": "ben", "bernard": "bernie", "bridget": "biddy", "caroline": "carrie lina", "catherine": "kate kathy kit cathy", "charles": "chuck chas charlie", "charlotte": "lottie lotte", "christine": "kirsten tina",
    "christopher": "kit topher", "concepcion": "concha", "cornelius": "neil", "daniel": "danny", "david": "dave", "dolores": "lola", "dorothy": "dot dottie dolly", "edmund": "ned ted", "edward": "ned ted teddy", "eleanor": "nell nora", "elizabeth": "liz lizzie betty eliza lisa elsie",
    "enrique": "quique", "eugene": "gene", "ferdinand": "nando", "florence": "flo", "frances": "fanny", "francis": "frank", "francisco": "paco pancho curro kiko", "frederick": "fritz fred", "friederike": "fritzi riki", "gabriele": "gaby", "george": "jorge", "gerald": "jerry", "gertrude": "trudy",
    "guillermo": "memo guille", "harold": "hal harry", "heinrich": "heinz heiner", "helen": "nell lena", "henry": "hank harry hal", "ignacio": "nacho", "isabella": "bella", "jacob": "jake", "james": "jim jimmy jamie", "jeffrey": "geoff", "jesus": "chuy", "johannes": "hans", "john": "jack johnny",
    "jonathan": "jon", "josefina": "pepa", "joseph": "joe", "jose": "pepe", "katherine": "kit kate katie kitty", "lawrence": "larry", "leonard": "lenny", "leticia": "letty", "louise": "lulu", "manuel": "manolo", "margaret": "peg peggy maggie meg daisy greta", "maria": "mia mitzi", "martha": "patty", "mary": "molly polly",
    "matilda": "tilly", "matthew": "matt", "maximilian": "milan", "michael": "mike mick mickey", "nathaniel": "nat", "nicholas": "klaus nico", "ottilie": "tilly", "patricia": "patsy trish tricia", "patrick": "paddy", "penelope": "nell", "peter": "pete", "philip": "pip", "rafael": "rafa", "raymond": "ray", "rebecca": "becky",
    "richard": "dick rick", "robert": "bob bobby rob", "roberto": "beto", "ronald": "ronnie", "rosalind": "roz", "rosario": "charo", "rudolf": "rolf", "samantha": "mandy", "santiago": "chago", "sarah": "sally", "sebastian": "bastian", "stephen": "steve", "susan": "sukey suzie suzy susie", "sylvester": "sly", "theodore": "ted teddy", "theresa": "tess tracy",
    "thomas": "tom tommy", "timothy": "tim", "ursula": "uschi ulla", "veronica": "ronnie", "victoria": "vicky vikki tori", "virginia": "ginny", "wilhelm": "willi", "william": "bill billy", "winifred": "freddie", "yolanda": "yoli", "zachary": "zack zak",
}


def nickname_table(names: dict[str, str]) -> dict[str, frozenset[str]]:
    return {k: frozenset(v.split()) for k, v in names.items()}


@functools.lru_cache(100_000)
def fold(s: str) -> str:
    """Lower case without marks on letters."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower().translate(PLAIN)) if not unicodedata.combining(c))


@functools.lru_cache(500_000)
def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b; most + 1 if more than most.

    Bit-parallel: a column of the table of distances is held as the signs of its differences in two whole numbers."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or not a or not b:
        return min(most + 1, max(len(a), len(b)))
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, zero, older, d = full, 0, 0, 0, len(a)
    for c in b:
        here = at.get(c, 0)
        swapped = ((~zero & here) << 1) & older
        zero = ((((here & up) + up) ^ up) | here | down | swapped) & full
        right, left = (down | ~(zero | up)) & full, zero & up
        d += bool(right & top) - bool(left & top)
        right, left = ((right << 1) | 1) & full, (left << 1) & full
        up, down, older = (left | ~(zero | right)) & full, right & zero, here
    return min(d, most + 1)


def near(a: str, b: str, most: int) -> int:
    """distance, but "rn" for "m" is one edit, as when a name was read off an image."""
    d = distance(a, b, most)
    if d > 1 and ("rn" in a or "rn" in b):
        d = min(d, 1 + distance(a.replace("rn", "m"), b.replace("rn", "m"), most))
    return d


def allowed(word: str) -> int:
    """Edits that a word of this length may have."""
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2


@functools.lru_cache(200_000)
def short_form(typed: str, word: str) -> bool:
    """Whether typed is a short form of a word: letters of it in order from its first on, at least one left out; beyond the
    word's beginning and a plural's "s" at most two vowels."""
    t = typed.replace("'", "")
    if not 2 <= len(t) < len(word) or t[0] != word[0]:
        return False
    if word.startswith(t) or t[-1] == "s" and len(t) > 2 and word.startswith(t[:-1]):
        return True
    rest = iter(word)
    return all(c in rest for c in t) and sum(c in "aeiou" for c in t[1:]) <= 2


@functools.lru_cache(200_000)
def familiar_form(typed: str, given: str) -> bool:
    """Whether typed is a familiar form of a given name by rule: its beginning or end of three letters or more, with or
    without an ending such as -y or -ie; vowels of the name may be written i or y."""
    t = re.sub(r"(?:ie|ey|[yieao])$", "", typed)
    if len(typed) == 2:
        return len(given) > 4 and given.startswith(typed)
    if len(typed) < 3 or typed == given:
        return False
    if len(given) - len(typed) > 0 and len(typed) >= 3 and (given.startswith(typed) or len(typed) > 3 and given.endswith(typed)):
        return True
    return len(t) >= 2 and len(typed) >= 3 and len(given) > len(t) + 1 and (given.startswith(t) or len(t) > 2 and t[-1] == t[-2] and given.startswith(t[:-1]))


def word_cost(typed: str, word: str, variants: tuple[str, ...] = ()) -> float | None:
    """How far a typed word is from a word of a name, a short form of it, or a variant that was merged with it; None if too
    far. Through a variant, a word may be one edit further off than alone."""
    most = allowed(word)
    d = near(typed, word, most)
    best = float(d) if d <= most else None
    if (best is None or best > 0.2) and short_form(typed, word):
        best = 0.2 if word.startswith(typed) else 0.3
    if best is None and len(typed) > 2:
        for v in variants:
            if len(v) > 2 and distance(typed, v, 1) <= 1 and (len(v) < len(word) - 2 or near(typed, word, most + 1) <= most + 1):
                return 1.3
    return best


def humped(token: str) -> str:
    """A blank before each capital letter that follows a small one."""
    return "".join(" " + c if c.isupper() and i and token[i - 1].islower() else c for i, c in enumerate(token))


class Spelling:
    """A value as typed, undecorated: its words, whether they are joined into one, and whether it may be an acronym."""

    __slots__ = ("words", "joined", "acronym", "empty")

    def __init__(self, raw: str):
        raw = re.sub("[™®©]", " ", raw.replace("&amp;", "&")).strip(" .,")
        s = fold(raw)
        if m := MAIL.match(s):
            parts = [p for p in re.split(r"[._+-]+", m[2]) if p.isalpha()]
            s = m[4] or m[1] or (" ".join(parts) if len(parts) > 1 else "")
        elif m := DOMAIN.match(s):
            s = m[1]
        while True:
            t = TITLES.sub("", HEAD.sub("", VIA.sub("", s.strip(" .,:-–—|·/")))).strip()
            t = re.sub(r"\s*\([^()]*\)", " ", t).strip() or t
            cut = re.split(r"\s*[-–—|·/,](?:\s+|$)", t)
            if len(cut) > 1 and cut[-1] and set(re.findall(r"\w+", cut[-1])) <= ROLES:
                t = t[: t.rindex(cut[-1])]
            if t == s:
                break
            s = t
        s = re.sub(r"(?<=\b[a-z])\.(?=[a-z]\b)", "", s)  # b.v. -> bv
        s = re.sub(r"[^\w\s']|_", " ", s)
        words = [w for w in s.split() if w not in LINKS]
        if len(words) > 2:
            words = [w for i, w in enumerate(words) if w not in SHORT_LINKS or i in (0, len(words) - 1)]
        if len(words) > 1 and len(words[-1]) > 4 and any(distance(words[-1], x, 2) <= 2 for x in LONG_LEGAL):
            words[-1] = "ltd"
        # "instruments, sakund energy ag": legal forms stand at the end, or before a comma
        self.words = [w for w in words if w not in LEGAL and w not in ROLES] or [w for w in words if w not in LEGAL]
        self.joined = "".join(self.words)
        if len(self.words) == 1 or " " not in raw:  # "SakundLabs"
            humps = {fold(t): fold(humped(t)).split() for t in re.findall(r"\w+", raw)}
            self.words = [x for w in self.words for x in humps.get(w, [w])]
        upper = len(self.words) == 1 and 3 <= len(self.joined) <= 5 and raw.strip(" .,").isupper()
        self.acronym = self.joined if upper else None
        self.empty = not self.joined

    def form(self) -> str:
        """What the score depends on: spellings with one form are one record."""
        return " ".join(self.words) + ("!" if self.acronym else "")

    @classmethod
    def of_form(cls, form: str) -> Spelling:
        s = cls.__new__(cls)
        s.words = form.removesuffix("!").split()
        s.joined = "".join(s.words)
        s.acronym = s.joined if form.endswith("!") else None
        s.empty = not s.words
        return s


class Profile:
    """A known entity: its name taken apart, and what merged spellings have added to it: variants of each of its words, the
    initials of its given name's variants, and joined spellings."""

    __slots__ = ("id", "person", "given", "middle", "surname", "heads", "rest", "core", "joined", "acronym", "alone", "variants", "initials", "joins")

    def __init__(self, entity_id: int, kind: str, name: str, alone: bool = False, gains: tuple[str, ...] | list[str] = ()):
        self.id, self.person, self.alone = entity_id, kind == "person", alone
        s = fold(name)
        self.given = self.middle = self.surname = self.acronym = None
        if self.person:
            words = re.sub(r"[^\w\s]", " ", s).split()
            self.core, self.rest = words, []
            self.heads = words[-1:]
            if words:
                self.given, self.surname = words[0], words[-1]
                self.middle = words[1] if len(words) > 2 else None
        else:
            self.core = Spelling(name).words
            n = 2 if "&" in s else 1
            self.heads, self.rest = self.core[:n], self.core[n:]
            self.acronym = "".join(w[0] for w in self.core) if len(self.core) > 2 else None
        self.joined = "".join(self.core)
        variants: dict[str, list[str]] = {}
        for g in gains:
            word, _, v = g.partition("=")
            variants.setdefault(word, []).append(v)
        self.joins = tuple(variants.pop("", ()))
        self.variants = {w: tuple(sorted(v)) for w, v in variants.items()}
        self.initials = frozenset(v[0] for v in self.variants.get(self.given, ())) if self.person and self.given else frozenset()

    @property
    def head_key(self) -> str | None:
        return " ".join(self.heads) if not self.person and self.heads else None

    def keys(self) -> set[str]:
        """Block keys of the name and of all merged spellings."""
        words = list(self.heads)
        for w in self.heads:
            words += self.variants.get(w, ())
        out = block_keys(words, self.joined, self.acronym)
        for j in self.joins:
            out |= block_keys([], j, None)
        return out


def deletes(word: str) -> set[str]:
    """The word and what is left of it without any one letter: words one edit apart share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def block_keys(words, joined: str, acronym: str | None) -> set[str]:
    keys = {f"a:{acronym}"} if acronym else set()
    for w in words:
        if len(w) >= 4:
            keys |= {f"w:{k}" for k in deletes(w)}
            if "rn" in w or "m" in w:
                keys.add(f"o:{w.replace('rn', 'm')}")
    if len(joined) >= 8:
        keys |= {f"p:{k}" for k in deletes(joined[:8])} | {f"s:{k}" for k in deletes(joined[-8:])}
    return keys


#: A match: its cost, and what the spelling adds to the profile ("word=variant", "=joined spelling").
Match = tuple[float, tuple[str, ...]]


class Scorer:
    """How far spellings are from profiles."""

    def __init__(self, nicknames: dict[str, frozenset[str]]):
        self.nicknames = nicknames

    def match(self, s: Spelling, k: Profile) -> Match | None:
        return self._person(s, k) if k.person else self._firm(s, k)

    def _firm(self, s: Spelling, k: Profile) -> Match | None:
        if s.acronym and k.acronym == s.acronym:
            return 0.5, ()
        options: list[Match] = []
        if len(s.words) == len(k.core) and (found := self._assign(s.words, k.core, k)):
            options.append(found)
        if len(s.words) == len(k.heads) and k.rest and k.alone and (found := self._assign(s.words, k.heads, k)):
            options.append((found[0] + 0.4, found[1]))
        n = len(k.joined)
        if len(s.words) != len(k.core) and n >= 6:
            most = 1 if n < 12 else 2 if n < 24 else 3
            d = distance(s.joined, k.joined, most)
            if d <= most:
                options.append((d + 0.1, ("=" + s.joined,) if d else ()))
            elif found := self._joined(s, k):
                options.append(found)
        if len(s.words) > 1 == len(k.heads) and (k.alone or not k.rest) and (found := self._assign([s.joined], k.heads, k)):
            options.append((found[0] + 0.5, found[1]))  # one word typed as two
        return min(options) if options else None

    def _joined(self, s: Spelling, k: Profile) -> Match | None:
        """Words joined into one, one or more of them in short form, as in "SakundLabs"; and spellings one edit from a
        joined spelling that was merged."""
        head = "".join(k.heads)
        if k.rest and s.joined.startswith(head) and self._split(s.joined[len(head) :], k.rest):
            return 0.3, ("=" + s.joined,)
        if any(distance(s.joined, j, 1) <= 1 for j in k.joins):
            return 1.3, ()
        return None

    def _split(self, t: str, words: list[str]) -> bool:
        if not words:
            return not t
        return any(self._split(t[i:], words[1:]) for i in range(2, len(t) + 1) if t[:i] == words[0] or short_form(t[:i], words[0]))

    def _assign(self, typed: list[str], words: list[str], k: Profile) -> Match | None:
        """The costs of typed words given to words one to one, in any order, the nearest first for each word."""
        total, gains = 0.0, []
        free = list(typed)
        for w in words:
            best = None
            for i, t in enumerate(free):
                c = word_cost(t, w, k.variants.get(w, ()))
                if c is not None and (best is None or c < best[0]):
                    best = (c, i)
            if best is None:
                return None
            total += best[0]
            t = free.pop(best[1])
            if t != w and best[0] < 1.3:
                gains.append(f"{w}={t}")
        return (total, tuple(gains)) if total <= 1 + len(words) else None

    def _person(self, s: Spelling, k: Profile) -> Match | None:
        words = s.words
        if not 2 <= len(words) <= 3 or not k.given or len(k.core) < 2:
            return None
        best = None
        for i, w in enumerate(words):
            if len(w) < 3:
                continue
            d = near(w, k.surname, allowed(k.surname))
            if d > allowed(k.surname):
                if not any(len(v) > 3 and distance(w, v, 1) <= 1 for v in k.variants.get(k.surname, ())) or near(w, k.surname, allowed(k.surname) + 1) > allowed(k.surname) + 1:
                    continue
                d = 1.3
            others = words[:i] + words[i + 1 :]
            for j, g in enumerate(others):
                c = self._given(g, k)
                if c is None:
                    continue
                rest = others[:j] + others[j + 1 :]
                if rest:
                    if len(rest[0]) > 1 and not (k.middle and rest[0] == k.middle):
                        continue
                    if not k.middle or rest[0][0] != k.middle[0]:
                        continue
                if len(g) == 1 and d > 1:
                    continue
                gains = [f"{k.surname}={w}"] * (w != k.surname and d < 1.3) + [f"{k.given}={g}"] * (len(g) > 1 and g != k.given and c < 1.3)
                if best is None or d + c < best[0]:
                    best = (d + c, tuple(gains))
        return best

    def _given(self, typed: str, k: Profile) -> float | None:
        given = k.given
        if len(typed) == 1:
            return 0.4 if typed == given[0] else 0.6 if typed in k.initials else None
        if typed in self.nicknames.get(given, ()):
            return 0.2
        most = allowed(given)
        d = distance(typed, given, most)
        if familiar_form(typed, given):
            return min(0.3, d)
        if d <= most:
            return float(d)
        if len(typed) > 3 and any(len(v) > 3 and distance(typed, v, 1) <= 1 for v in (*k.variants.get(given, ()), *self.nicknames.get(given, ()))):
            return 1.3
        return None


def choose(found: list[tuple[float, int]], margin: float = 0.35) -> int | None:
    """The entity that a spelling means, of (cost, entity); None if none is near or two are about equally near."""
    found = sorted(found)
    if not found or len(found) > 1 and found[1][0] - found[0][0] < margin:
        return None
    return found[0][1]
