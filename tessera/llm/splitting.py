"""Problem 8: texts over a token limit into overlapping pieces that end at natural boundaries."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import spread, table
from .bpe import SLICE_CHARS, Encoder
from .chargrid import SPACE, classes, join, slices
from .tokens import texts_of, vocabulary

#: Signs that end a sentence, those that do so without a blank, and those that end a clause (fixed values).
SENTENCE, WIDE, CLAUSE = ".!?…:।", "。！？", ",;、，；)"
#: A cut is looked for this far from the midpoint, as a share of the segment; and farther, if nothing nearer is better
#: than a gap between words.
NEAR, FARTHER = 0.2, (0.35, 0.45)
#: A character has up to so many tokens of bytes: no limit may be lower.
LEAST_LIMIT = 4

RESULT = T.StructType([
    T.StructField("budget_name", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("piece_no", T.IntegerType()),
    T.StructField("char_start", T.IntegerType()), T.StructField("core_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()),
    T.StructField("overlap_tokens", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("piece", T.StringType()),
])


def strengths(cps: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How natural a cut before each position is: 5 after an empty line, 4 after a line, 3 after a sentence, 2 after a
    clause, 1 between words, 0 elsewhere between words of the tokenizer."""
    white = classes()[cps] == SPACE
    index = np.arange(len(cps))
    last = np.maximum.accumulate(np.where(white, -1, index))  # the last sign up to here that isn't white
    lines = np.append(0, np.cumsum((cps == 10) | ((cps == 13) & (np.append(cps[1:], 0) != 10)) | (cps == 0x2029)))
    first = np.where((cps[at] == 32) & (at + 1 < len(cps)), np.minimum(at + 1, len(cps) - 1), at)  # past the word's own blank
    before = np.where(at > 0, last[np.maximum(at - 1, 0)], -1)
    text = ends[np.searchsorted(ends, at, "right") - 1]
    gap = (before + 1 < first) & (before >= text)
    sign = np.where(before >= text, cps[np.maximum(before, 0)], 0)
    broken = lines[first] - lines[np.maximum(before, 0)]
    wide = np.isin(sign, [ord(c) for c in WIDE])
    out = np.where(gap, 1, 0)
    out[gap & np.isin(sign, [ord(c) for c in CLAUSE])] = 2
    out[(gap & np.isin(sign, [ord(c) for c in SENTENCE])) | wide] = 3
    out[gap & (broken == 1)] = 4
    out[gap & (broken > 1)] = 5
    out[white[first]] = 0  # within white space
    return out


class Slice:
    """Tokens, words and cut places of a few texts."""

    def __init__(self, encoder: Encoder, texts: list[str], long_word: int):
        self.encoder, self.texts = encoder, texts
        self.lo, self.entry, self.first_word = encoder.words_of(texts)
        self.cps, self.ends = join(texts)
        self.start = self.ends.tolist()
        self.hi = np.append(self.lo[1:], len(self.cps))
        self.flat, self.run = encoder.gather(self.entry)
        self.first_token = self.run[self.first_word].tolist()
        places, tokens = [self.lo], [self.run[:-1]]
        strength = [strengths(self.cps, self.ends, self.lo)]
        for k in np.flatnonzero(np.diff(self.run) > long_word).tolist():
            char, token = self.inside(k)
            places.append(char), tokens.append(token), strength.append(np.full(len(char), -1))
        place, token = np.concatenate(places), np.concatenate(tokens)
        order = np.argsort(token, kind="stable")
        self.place, self.token = [*place[order].tolist(), len(self.cps)], [*token[order].tolist(), len(self.flat)]
        self.strength = (np.concatenate(strength)[order] + 1).astype(np.uint8).tobytes()
        wide = np.append(0, np.cumsum(self.cps >= 0x80))
        self.ascii = wide[self.hi] == wide[self.lo]
        self.los, self.runs, self.white = self.lo.tolist(), self.run.tolist(), classes()[self.cps[self.lo]] == SPACE

    def inside(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Character and token positions within word k at which a token and a character start together."""
        width = self.encoder.width[self.flat[self.run[k] : self.run[k + 1]]]
        byte = np.cumsum(width)[:-1]
        c = self.cps[self.lo[k] : self.hi[k]]
        start = np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000).astype(np.int64))
        char = np.searchsorted(start, byte) + 1
        ok = start[np.minimum(char - 1, len(start) - 1)] == byte
        return self.lo[k] + char[ok], self.run[k] + 1 + np.flatnonzero(ok)

    def cut(self, a: int, b: int) -> int:
        """The number of the place, strictly between tokens a and b, that is strongest near the midpoint; -1 if none."""
        middle, reach = (a + b) / 2, (b - a) * NEAR
        i, j = bisect_left(self.token, middle - reach), bisect_left(self.token, middle + reach)
        most = max(self.strength[i:j], default=0)
        if most <= 2:  # nothing better than a gap between words near the midpoint: look farther
            for share in FARTHER:
                x, y = bisect_left(self.token, middle - share * (b - a)), bisect_left(self.token, middle + share * (b - a))
                found = max(self.strength[x:y], default=0)
                if found > 2 or found > most <= 1:
                    i, j, most = x, y, found
                if most > 2:
                    break
        if most <= 1:
            i, j = bisect_left(self.token, a + 1), bisect_left(self.token, b)
            if i >= j:
                return -1
            most = max(self.strength[i:j])
        c = min(max(bisect_left(self.token, middle), i), j)
        left, right = self.strength.rfind(most, i, c), self.strength.find(most, c, j)
        if left < 0 or right >= 0 and self.token[right] - middle < middle - self.token[left]:
            return right
        return left

    def cores(self, d: int, most: int) -> list[int]:
        """Places at which the cores of text d start, and one past its last."""
        a, b = bisect_left(self.token, self.first_token[d]), bisect_left(self.token, self.first_token[d + 1])
        out, todo = [a], [(a, b)]
        while todo:  # left halves first
            i, j = todo.pop()
            if self.token[j] - self.token[i] > most and (k := self.cut(self.token[i], self.token[j])) > 0:
                todo += [(k, j), (i, k)]
            else:
                out.append(j)
        return out

    def overlap_start(self, token: int) -> tuple[int, int]:
        """The first character and token from this token on that start together."""
        k = bisect_right(self.runs, token) - 1
        if self.runs[k] == token:
            return self.los[k], token
        if self.ascii[k]:  # a token for every so many characters
            return self.los[k] + int(self.encoder.width[self.flat[self.runs[k] : token]].sum()), token
        char, at = self.inside(k)
        i = np.searchsorted(at, token)
        return (int(char[i]), int(at[i])) if i < len(at) else (int(self.hi[k]), int(self.run[k + 1]))

    def size(self, x: int, y: int, end: int) -> list[tuple[int, int]] | int:
        """Tokens of characters x to y by themselves, so far as words stay whole; and the ranges to be encoded anew: of
        words that are cut, and of white space that follows its text in one run now."""
        los, runs = self.los, self.runs
        k, m = bisect_right(los, x) - 1, bisect_left(los, y) - 1
        m_end = los[m + 1] if m + 1 < len(los) else len(self.cps)
        if k == m and (x > los[k] or y < m_end):
            return 0, [(x, y)]
        anew: list[tuple[int, int]] = []
        if x > los[k]:
            k += 1
            anew.append((x, los[k]))
        if y < m_end:
            anew.append((los[m], y))
            m -= 1
        elif y < end and m > k and m_end - los[m] == 1 and self.white[m] and self.white[m - 1]:
            anew.append((los[m - 1], y))
            m -= 2
        return runs[m + 1] - runs[k], anew


def pieces_of(encoder: Encoder, texts: list[str], budgets: list[tuple[str, int, int]]):
    """Yields (budget, text number, piece_no, char_start, core_start, char_end, overlap_tokens, n_tokens) of texts over
    the limit; positions count characters of the text."""
    s = Slice(encoder, texts, min((limit - overlap) // 2 for _, limit, overlap in budgets))  # longer words may be cut inside
    for name, limit, overlap in budgets:
        found = []  # [text, start, core start, end, overlap, own tokens, ranges to encode, place, next place]
        for d in np.flatnonzero(np.diff(s.run[s.first_word]) > limit).tolist():
            todo = list(zip((c := s.cores(d, limit - overlap)), c[1:]))
            found += [_piece(s, d, i, j, overlap) for i, j in todo]
        while True:
            spans = [texts[p[0]][x - s.start[p[0]] : y - s.start[p[0]]] for p in found for x, y in p[6]]
            n = encoder.counts(spans).tolist() if spans else []
            at, over = 0, []
            for q, p in enumerate(found):
                p[5] = p[5] + sum(n[at : at + len(p[6])])
                at += len(p[6])
                p[6] = []
                if p[5] > limit:
                    over.append(q)
            again = False
            for q in reversed(over):  # encoded by itself, a cut word can take more tokens: less overlap, then smaller cores
                p = found[q]
                if p[4]:
                    again = True
                    found[q] = _piece(s, p[0], p[7], p[8], max(0, p[4] - max(1, p[5] - limit)))
                elif (k := s.cut(s.token[p[7]], s.token[p[8]])) > 0:
                    again = True
                    found[q : q + 1] = [_piece(s, p[0], p[7], k, overlap), _piece(s, p[0], k, p[8], overlap)]
            if not again:  # a piece that nothing can be taken from is left as it is
                break
        number, previous = 0, -1
        for d, x, core, y, own, tokens, *_ in found:
            number = number + 1 if d == previous else 0
            previous, base = d, s.start[d]
            yield name, d, number, x - base, core - base, y - base, own, tokens


def _piece(s: Slice, d: int, i: int, j: int, overlap: int) -> list:
    start, end, first = s.start[d], s.start[d + 1], s.first_token[d]
    core, token, y = s.place[i], s.token[i], min(s.place[j], end)
    x, at = s.overlap_start(max(first, token - overlap)) if token > first and overlap else (core, token)
    own, anew = s.size(max(x, start), y, end)
    return [d, max(x, start), core, y, token - at, own, anew, i, j]


def split_texts(df: DataFrame, budgets: list[tuple[str, int, int]], id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Pieces of all texts over a limit, for each (name, limit, overlap) of budgets, by recursive bisection.

    A segment of more than limit - overlap tokens is cut at the strongest boundary near its midpoint, and both halves
    likewise; then each piece but the first is begun with the last `overlap` tokens before it. `piece` is
    text[char_start:char_end], its own part begins at core_start; own parts joined give the text back. n_tokens, never
    above the limit, is the size of `piece` encoded by itself. overlap_tokens counts tokens of the text's encoding; it
    is less than asked for only at a text's start, where a token doesn't begin with a whole character, or where
    more would break the limit. Texts within the limit, null and empty ones give no rows; repeated rows give repeated
    pieces; an empty table gives no rows. A limit below the tokens of one character is an error. A text without any boundary is cut between tokens. There is no shuffle.
    """
    for name, limit, overlap in budgets:
        if not 0 <= overlap < limit:
            raise ValueError(f"{name}: the overlap must be below the limit")
        if limit < LEAST_LIMIT:
            raise ValueError(f"{name}: a character can have {LEAST_LIMIT} tokens, so no lower limit can be kept")
    vocab = vocabulary(df.sparkSession, tokenizer, folder)

    def run(batches):
        encoder = Encoder(vocab.value)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            lengths = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            for a, b in slices(lengths, SLICE_CHARS // 2):
                texts, keys = texts_of(column.slice(a, b - a)), ids.slice(a, b - a).to_pylist()
                rows = [(r[0], keys[r[1]], *r[2:], texts[r[1]][r[3] : r[5]]) for r in pieces_of(encoder, texts, budgets)]
                columns = list(zip(*rows)) if rows else [[]] * len(RESULT)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW)], names=RESULT.names)

    return spread(df.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")).mapInArrow(run, RESULT)


ARROW = [pa.string(), pa.int64(), *[pa.int32()] * 6, pa.string()]


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents over split_small and split_large as pieces."""
    budgets = table(spark, sf_dir, "token_budgets").where("budget_name like 'split%'")  # a fixed table of four rows
    rows = [(r["budget_name"], r["max_tokens"], r["overlap_tokens"]) for r in budgets.orderBy("budget_name").collect()]
    return split_texts(table(spark, sf_dir, "documents"), rows)


QUERIES = {"p8_pieces": p8_pieces}
SQL: dict[str, str] = {}
