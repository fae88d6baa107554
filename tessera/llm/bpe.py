"""Byte-level BPE over whole columns.

Texts become flat code point arrays; the words of the public pattern are found by class changes, hashed, and looked up
in a table of words already encoded. Words not met before are laid out by length in padded matrices of byte tokens, and
in each round every row merges its leftmost pair of least rank (looked up in a hashed pair table) and is compacted.
"""

from __future__ import annotations

import json

import numpy as np

from .chargrid import LETTER, NUMBER, OTHER, SPACE, classes, join, run_starts, slices, span_hashes

#: Characters worked on at once by a task; bounds its memory, not the result.
SLICE_CHARS = 1 << 20
#: Encoded words kept by a task before it starts anew; bounds its memory, not the result.
KEPT_WORDS = 300_000
NONE = np.int32(2**31 - 1)


class HashTable:
    """Open addressing over 64-bit keys with vectorised look-up; values are int32, -1 for absent keys."""

    def __init__(self, bits: int):
        self.clear(bits)

    def clear(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot, mask = self._slot(keys), len(self.keys) - 1
        found, there = self.values[slot], self.keys[slot]
        todo = np.flatnonzero((there != keys) & (found >= 0))
        found[there != keys] = -1
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & mask
            value, there = self.values[slot], self.keys[slot]
            hit = (value >= 0) & (there == keys[todo])
            found[todo[hit]] = value[hit]
            more = (value >= 0) & ~hit
            todo, slot = todo[more], slot[more]
        return found

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are distinct and not there yet."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.values >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.clear(max(self.bits + 1, int(4 * len(keys)).bit_length()))
        self.used += len(keys)
        slot, mask, values = self._slot(keys), len(self.keys) - 1, values.astype(np.int32)
        while len(keys):
            free = self.values[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            placed = self.keys[slot] == keys
            placed &= self.values[slot] == values
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & mask


def load_vocabulary(path: str) -> dict[str, np.ndarray]:
    """The byte tokens and the merges of a byte-level BPE file, as small arrays (some 600 KB)."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab = model["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right, made = (np.array([vocab[x] for x in c], np.int32) for c in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
    return {
        "bytes": np.array([vocab[signs[b]] for b in range(256)], np.int32),
        "left": left,
        "right": right,
        "made": made,
        "ordered": np.array(ordered(left, right, made)),
        "width": np.array([len(t) for t, _ in sorted(vocab.items(), key=lambda x: x[1])], np.int32),
    }


def ordered(left: np.ndarray, right: np.ndarray, made: np.ndarray) -> bool:
    """Whether no token is made twice, and no merge has a part that a later merge makes: then a merge never makes a pair
    of lower rank, and all places of the least rank may be merged at once."""
    rank = {int(t): r for r, t in enumerate(made)}
    return len(rank) == len(made) and all(rank.get(int(x), -1) < r for part in (left, right) for r, x in enumerate(part))


class Encoder:
    """Encodes texts; the result for a text doesn't depend on what else is encoded."""

    def __init__(self, vocabulary: dict[str, np.ndarray]):
        self.byte_ids, self.made, self.width = vocabulary["bytes"], vocabulary["made"], vocabulary["width"]
        #: Words of more bytes are merged by _long, if the merges allow it.
        self.longest = 64 if bool(vocabulary["ordered"]) else None
        self.pairs = HashTable(18)
        self.pairs.put(self._pair(vocabulary["left"], vocabulary["right"]), np.arange(len(self.made)))
        self.words = HashTable(18)
        self._forget()

    def _forget(self) -> None:
        self.words.clear(18)
        self.pool, self.pool_used = np.zeros(1 << 20, np.int32), 0
        self.offset, self.count, self.n_words = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32), 0

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)

    # -- words of the pattern -------------------------------------------------------------------------------------
    @staticmethod
    def word_starts(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Start of each word of the public pattern: contractions, letters, digits and signs each with one blank
        before them, white space."""
        if not len(cps):
            return np.zeros(0, np.int64)
        kind = classes()[cps]
        start = run_starts(kind, ends)
        text_start = np.zeros(len(cps) + 4, bool)
        text_start[ends] = True
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_start[1 : len(cps)])
        start[last] = True
        start[last[cps[last] == 32] + 1] = False
        k = np.append(kind, np.full(4, OTHER, np.uint8))
        c = np.append(cps, np.zeros(4, np.uint32))
        at = np.flatnonzero((cps == 39) & start)
        at = at[(k[at + 1] == LETTER) & ~text_start[at + 1]]
        one = np.isin(c[at + 1], [ord(x) for x in "stmd"])
        two = ~text_start[at + 2] & np.logical_or.reduce([(c[at + 1] == ord(x)) & (c[at + 2] == ord(y)) for x, y in ("re", "ve", "ll")])
        for hit, n in ((at[one], 2), (at[two & ~one], 3)):
            start[hit + 1] = False
            after = hit + n
            after = after[(k[after] == LETTER) & ~text_start[after]]
            start[after] = True
        return np.flatnonzero(start)

    # -- encoding of words not met before --------------------------------------------------------------------------
    def _encode_words(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        width, low = 2, 0
        while low < (self.longest or n.max(initial=0)):
            rows = np.flatnonzero((n > low) & (n <= width))
            for part in range(0, len(rows), step := max(1, (1 << 20) // width)):
                self._matrix(raw, rows[part : part + step], width, out)
            low, width = width, width * 2
        self._long(raw, np.flatnonzero(n > low), out)
        return out

    def _matrix(self, raw: list[bytes], rows: np.ndarray, width: int, out: list[np.ndarray]) -> None:
        """Rows of up to width byte tokens; each round, every row merges its leftmost pair of least rank."""
        ids = np.full((len(rows), width), -1, np.int32)
        size = np.fromiter((len(raw[i]) for i in rows), np.int64, len(rows))
        inside = np.arange(width) < size[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(raw[i] for i in rows), np.uint8)]
        live, column = np.arange(len(rows)), np.arange(width)
        rank = self._ranks(ids, size)
        while len(live):
            best = rank.argmin(axis=1)
            least = rank[np.arange(len(live)), best]
            go = least < NONE
            for r in np.flatnonzero(~go):
                out[rows[live[r]]] = ids[r, : size[r]].copy()
            if not go.any():
                break
            live, ids, size, best, least, rank = live[go], ids[go], size[go], best[go], least[go], rank[go]
            at = np.arange(len(live))
            ids[at, best] = self.made[least]
            if width > 1:  # close the gap to the right of the merged pair
                source = column[None, :-1] + (column[None, :-1] > best[:, None])
                ids[:, :-1] = np.take_along_axis(ids, source, axis=1)
                ids[:, -1] = -1
                if rank.shape[1] > 1:
                    rank[:, :-1] = np.take_along_axis(rank, np.minimum(source[:, : rank.shape[1] - 1], rank.shape[1] - 1), axis=1)
                rank[:, -1] = NONE
            size -= 1
            for side in (best - 1, best):  # only the two pairs beside the merged token are new
                ok = (side >= 0) & (side + 1 < size)
                r, s = at[ok], side[ok]
                found = self.pairs.get(self._pair(ids[r, s], ids[r, s + 1]))
                rank[r, s] = np.where(found < 0, NONE, found)
                bad = (side >= 0) & ~ok & (side < rank.shape[1])
                rank[at[bad], side[bad]] = NONE

    def _ranks(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        rank = np.full((ids.shape[0], max(1, ids.shape[1] - 1)), NONE, np.int32)
        if ids.shape[1] > 1:
            there = np.arange(ids.shape[1] - 1) < (size - 1)[:, None]
            found = self.pairs.get(self._pair(ids[:, :-1][there], ids[:, 1:][there]))
            rank[:, : ids.shape[1] - 1][there] = np.where(found < 0, NONE, found)
        return rank

    def _long(self, raw: list[bytes], rows: np.ndarray, out: list[np.ndarray]) -> None:
        """Long words, one behind the other in one array: each round, every word merges all places of its least rank from
        the left, which equals merging them one by one, as a merge never makes a pair of lower rank."""
        if not len(rows):
            return
        ids = self.byte_ids[np.frombuffer(b"".join(raw[i] for i in rows), np.uint8)]
        size = np.fromiter((len(raw[i]) for i in rows), np.int64, len(rows))
        rank = np.full(len(ids), NONE, np.int32)
        self._rank_at(np.arange(len(ids)), ids, rank, size)
        while len(rows):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            if (least == NONE).any():
                for k in np.flatnonzero(least == NONE).tolist():
                    out[rows[k]] = ids[start[k] : start[k] + size[k]].copy()
                live = least < NONE
                kept = np.repeat(live, size)
                rows, size, ids, rank = rows[live], size[live], ids[kept], rank[kept]
                continue
            at = np.flatnonzero(rank == np.repeat(least, size))
            if (np.diff(at) == 1).any():  # overlapping places, as in "aaa": every other one of a run
                first = np.append(True, np.diff(at) > 1)
                at = at[(at - at[first][np.cumsum(first) - 1]) % 2 == 0]
            ids[at] = self.made[rank[at]]
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            size = size - np.bincount(np.searchsorted(start, at, "right") - 1, minlength=len(size))
            ids, rank = ids[kept], rank[kept]
            at = at - np.arange(len(at))
            self._rank_at(np.union1d(at, np.maximum(at - 1, 0)), ids, rank, size)

    def _rank_at(self, at: np.ndarray, ids: np.ndarray, rank: np.ndarray, size: np.ndarray) -> None:
        """Ranks of the pairs that begin at these places; none at the last place of a word."""
        rank[at] = NONE
        at = at[~np.isin(at, np.cumsum(size) - 1, assume_unique=True)]
        found = self.pairs.get(self._pair(ids[at], ids[at + 1]))
        rank[at] = np.where(found < 0, NONE, found)


    # -- columns ----------------------------------------------------------------------------------------------------
    def _learn(self, hashes: np.ndarray, cps: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        words = [cps[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(lo.tolist(), hi.tolist())]
        ids = self._encode_words(words)
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        while self.pool_used + len(flat) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.int32))
        while self.n_words + len(ids) > len(self.count):
            self.offset, self.count = np.append(self.offset, self.offset * 0), np.append(self.count, self.count * 0)
        self.pool[self.pool_used : self.pool_used + len(flat)] = flat
        new = slice(self.n_words, self.n_words + len(ids))
        self.offset[new] = self.pool_used + np.cumsum(count) - count
        self.count[new] = count
        self.words.put(hashes, np.arange(self.n_words, self.n_words + len(ids)))
        self.pool_used += len(flat)
        self.n_words += len(ids)

    def words_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a slice of texts: starts of words in the joined code points, entries of the word table, and the number
        of the first word of each text (one more entry than texts)."""
        if self.n_words > KEPT_WORDS:
            self._forget()
        cps, ends = join(texts)
        lo = self.word_starts(cps, ends)
        hi = np.append(lo[1:], len(cps))
        h = span_hashes(cps, lo, hi)
        entry = self.words.get(h)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            self._learn(new, cps, lo[miss[first]], hi[miss[first]])
            entry[miss] = self.words.get(h[miss])
        return lo, entry, np.searchsorted(lo, ends)

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        out = [np.zeros(0, np.int64)]
        for a, b in slices([len(t) for t in texts], SLICE_CHARS):
            _, entry, first = self.words_of(texts[a:b])
            run = np.append(0, np.cumsum(self.count[entry], dtype=np.int64))
            out.append(run[first[1:]] - run[first[:-1]])
        return np.concatenate(out)

    def ids(self, texts: list[str]):
        """Yields (row range, token ids of these rows in a row, number of tokens of each row)."""
        for a, b in slices([len(t) for t in texts], SLICE_CHARS):
            _, entry, first = self.words_of(texts[a:b])
            flat, run = self.gather(entry)
            yield (a, b), flat, np.diff(run[first])

    def gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words in a row, and the number of tokens before each word."""
        n = self.count[entry].astype(np.int64)
        run = np.append(0, np.cumsum(n))
        return self.pool[np.repeat(self.offset[entry] - run[:-1], n) + np.arange(run[-1])], run
