"""Texts as flat arrays of code points: classes, word starts and word hashes without a Python loop over words."""

from __future__ import annotations

import functools

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Unicode White_Space (fixed values).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        block = "".join(map(chr, range(lo, hi)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, block):
                out[lo + m.start() : lo + m.end()] = kind
    out[WHITE] = SPACE
    return out


@functools.cache
def lowered() -> np.ndarray:
    """The lower-case code point of each code point whose lower case is a single one."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and len(x := chr(c).lower()) == 1:
            out[c] = ord(x)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix), element by element."""
    x = x.astype(np.uint64) + STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def salts() -> np.ndarray:
    return mix(np.arange(0x110000))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and its inverse, modulo 2 ** 64, for i below n at least."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((STEP, BACK)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


def join(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text starts (one more entry than texts)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=ends[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def slices(lengths: list[int], most: int):
    """Ranges of rows with at most so many characters together (or a single row)."""
    lo = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def span_hashes(cps: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each cps[lo:hi]; equal spans have equal hashes wherever they stand."""
    up, down = powers(len(cps) + 1)
    run = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(salts()[cps] * up[: len(cps)], out=run[1:])
    h = (run[hi] - run[lo]) * down[lo]
    return mix(h ^ (hi - lo).astype(np.uint64) * STEP)


def run_starts(kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of positions at which the class changes or a text starts."""
    first = np.ones(len(kind), bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first[ends[:-1][ends[:-1] < len(kind)]] = True
    return first
