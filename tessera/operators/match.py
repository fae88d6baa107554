"""Texts against dictionaries of terms, by one automaton pass per text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse

INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def stands_alone(s: str, start: int, end: int, term: str) -> bool:
    """Whether s[start:end] has no letter or digit beside it, nor a sign such as the term itself begins or ends with."""
    before, after = s[start - 1 : start], s[end : end + 1]
    signs = "+.-"
    if before and (before in INNER or before in signs and term[0] in signs):
        return False
    return not (after and (after in INNER or after in signs and term[-1] in signs))


def _matched(automaton, text: str) -> list[str]:
    s, found = text.lower(), {}
    for last, w in automaton.iter(s):
        if w not in found and stands_alone(s, last + 1 - len(w), last + 1, w):
            found[w] = last
    return sorted(found, key=lambda w: (found[w], -len(w)))


def match_terms(text: Column, terms: list[str]) -> Column:
    """The distinct terms in a text as an array, by where they first end, longer ones first; terms of one character
    never match. Null texts give an empty array. For dictionaries of any size: a text is read once."""
    import ahocorasick

    words = sorted({t.lower().strip() for t in terms if len(t.strip()) > 1})

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()  # one for all batches of a task
        for w in words:
            automaton.add_word(w, w)
        if words:
            automaton.make_automaton()
        for texts in batches:
            yield pd.Series([_matched(automaton, x) if words and isinstance(x, str) else [] for x in texts], dtype=object)

    return run(text)


def keyword_matches(text: Column, keyword: str, synonyms: tuple[str, ...] = (), least: float = 0.85, single_words: bool = True) -> Column:
    """Whether a text has a keyword or a synonym as a whole, or something like the keyword: one token (if `single_words`), or
    as many tokens in a row as the keyword has words, whose bigrams agree with it by Dice's coefficient of `least` at
    least. With single_words=False only keywords of several words are looked for so."""
    keyword = keyword.lower()
    exact = tuple(dict.fromkeys([keyword, *(s.lower().strip() for s in synonyms if s.strip())]))
    parts = keyword.split()
    target = _grams(keyword)

    @F.pandas_udf(T.BooleanType())
    def run(texts: pd.Series) -> pd.Series:
        import re

        whole = re.compile("|".join(rf"(?<![A-Za-z0-9_]){re.escape(w)}(?![A-Za-z0-9_])" for w in exact), re.I)
        return pd.Series([isinstance(x, str) and (bool(whole.search(x)) or _like([w for w in x.split(" ") if w], parts, keyword, target, least, single_words)) for x in texts])

    return run(collapse(F.lower(text)))


def _grams(s: str) -> dict[str, int]:
    s = s.replace(" ", "")
    out: dict[str, int] = {}
    for i in range(len(s) - 1):
        out[s[i : i + 2]] = out.get(s[i : i + 2], 0) + 1
    return out


def _dice(s: str, keyword: str, target: dict[str, int]) -> float:
    s = s.replace(" ", "")
    if s == keyword.replace(" ", ""):
        return 1.0
    own = _grams(s)
    n = sum(own.values()) + sum(target.values())
    return 2 * sum(min(n, target.get(g, 0)) for g, n in own.items()) / n if own and target else 0.0


def _like(tokens: list[str], parts: list[str], keyword: str, target: dict[str, int], least: float, single_words: bool) -> bool:
    size = sum(map(len, parts))

    def near(words: list[str]) -> bool:  # sizes too far apart can't reach the coefficient
        n = sum(map(len, words))
        return 2 * (min(n, size) - 1) >= least * (n + size - 2) and _dice(" ".join(words), keyword, target) >= least

    if single_words and any(near([t]) for t in tokens):
        return True
    k = len(parts)
    return k > 1 and any(near(tokens[i : i + k]) for i in range(len(tokens) - k + 1))
