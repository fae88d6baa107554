"""Problem 7: texts into sequences of fixed capacity with little space left over."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .tokens import encode

#: Items packed together by one task; every item is packed, larger inputs have more groups.
GROUP_ITEMS = 25_000
RESULT = "budget_name string, doc_id long, part_no int, n_tokens long, sequence_id string, position int"


class Bins:
    """Bins of one capacity; those with free space are found by it, and by the sizes and sums of two sizes they hold."""

    def __init__(self, capacity: int, sizes: list[int]):
        self.capacity, self.sizes = capacity, sizes
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.single: list[int] = []  # bit t: an item of size t
        self.double: list[int | None] = []  # bit t: two items of sizes that sum to t
        self.by_free: dict[int, set[int]] = {}
        self.union: dict[int, tuple[int, int]] = {}  # by free space: all bins' bits, while they hold

    def add(self, items: list[int], free: int) -> int:
        self.items.append(items)
        self.free.append(free)
        self.single.append(0)
        self.double.append(None)
        return len(self.free) - 1

    def enter(self, b: int) -> None:
        """Makes a bin with free space a partner."""
        if self.items[b] and (f := self.free[b]):
            bits = 0
            for i in self.items[b]:
                bits |= 1 << self.sizes[i]
            self.single[b], self.double[b] = bits, None
            self.by_free.setdefault(f, set()).add(b)
            self.union.pop(f, None)

    def leave(self, b: int) -> None:
        f = self.free[b]
        if (own := self.by_free.get(f)) and b in own:
            own.discard(b)
            self.union.pop(f, None)
            if not own:
                del self.by_free[f]

    def sums(self, b: int) -> int:
        if self.double[b] is None:
            seen = bits = 0
            for i in self.items[b]:
                bits |= seen << self.sizes[i]
                seen |= 1 << self.sizes[i]
            self.double[b] = bits
        return self.double[b]

    def bits(self, f: int) -> tuple[int, int]:
        if f not in self.union:
            one = two = 0
            for b in self.by_free[f]:
                one |= self.single[b]
                two |= self.sums(b)
            self.union[f] = one, two
        return self.union[f]

    def partner(self, size: int, fill: int, pair: bool) -> tuple[int, int] | None:
        """(bin, t): a bin that takes `size` and gives back t, of one item or of two, so that it gains most; the squared
        fill of it and of a giver of this fill must grow together."""
        best = None
        for f in self.by_free:
            if best and f <= best[0]:
                continue
            low = max(1, size - f)
            here = self.bits(f)[pair] >> low
            if not here:
                continue
            t = low + (here & -here).bit_length() - 1
            d = size - t
            if 0 < d <= f and self.capacity - f + d > fill and (best is None or d > best[0]):
                best = d, f, t
        if best is None:
            return None
        _, f, t = best
        for b in self.by_free[f]:
            if (self.sums(b) if pair else self.single[b]) >> t & 1:
                return b, t
        return None

    def pick(self, b: int, t: int, pair: bool) -> list[int]:
        """One or two items of a bin that sum to t."""
        if not pair:
            return [next(i for i in self.items[b] if self.sizes[i] == t)]
        seen: dict[int, int] = {}
        for i in self.items[b]:
            if t - self.sizes[i] in seen:
                return [seen[t - self.sizes[i]], i]
            seen[self.sizes[i]] = i
        return []

    def exchange(self, a: int, give: list[int], b: int, back: list[int]) -> None:
        """Items `give` of bin a, which is no partner now, for items `back` of bin b."""
        self.leave(b)
        for x, y, moved in ((a, b, give), (b, a, back)):
            for i in moved:
                self.items[x].remove(i)
                self.items[y].append(i)
                self.free[x] += self.sizes[i]
                self.free[y] -= self.sizes[i]
        self.enter(b)


def fill_up(sizes: np.ndarray, capacity: int) -> Bins:
    """The start: bin by bin, the largest item left, then, as long as any fits, the one or two items left that leave least
    space."""
    bins = Bins(capacity, sizes.tolist())
    left: dict[int, list[int]] = defaultdict(list)
    there = 0  # bit t is set if an item of size t is left
    for i, s in enumerate(bins.sizes):
        left[s].append(i)
        there |= 1 << s

    def take(s: int) -> int:
        nonlocal there
        i = left[s].pop()
        if not left[s]:
            there &= ~(1 << s)
        return i

    while there:
        s = there.bit_length() - 1
        items, gap = [take(s)], capacity - s
        while fits := there & ((2 << gap) - 1):
            best = [fits.bit_length() - 1]
            rest = gap - best[0]
            while rest and fits:
                x = fits.bit_length() - 1
                if 2 * x <= gap - rest:
                    break
                fits &= ~(1 << x)
                y = there & ((2 << min(gap - x, x)) - 1)
                if y >> x == 1 and len(left[x]) < 2:
                    y &= ~(1 << x)
                if y and gap - x - (z := y.bit_length() - 1) < rest:
                    best, rest = [x, z], gap - x - z
            items += [take(x) for x in best]
            gap = rest
        bins.add(items, gap)
    return bins


def best_fit(sizes: np.ndarray, capacity: int) -> int:
    """The number of bins of best fit in falling order, to compare with."""
    free: list[int] = [0] * (capacity + 1)
    occupied = n = 0  # bit f is set if some bin has f free
    for s in np.sort(sizes)[::-1].tolist():
        fit = occupied >> s
        f = s + ((fit & -fit).bit_length() - 1) if fit else capacity
        if fit:
            free[f] -= 1
            occupied &= ~(0 if free[f] else 1 << f)
        else:
            n += 1
        free[f - s] += 1
        occupied |= 1 << (f - s) if f > s else 0
    return n


def search(bins: Bins) -> int:
    """Local search; gives the number of emptied bins.

    From the emptiest underfull bin on, items move to other underfull bins, are exchanged for one smaller item there, or
    for two, or two of them for one, always so that the sum of squared fills grows, until the bin is empty or no exchange
    is left. Partners are all underfull bins, whatever the difference in size. It ends when a pass over all underfull bins
    finds no exchange, or when the free space of all bins together is less than one bin, so that none can become empty.
    """
    cap, emptied = bins.capacity, 0
    for b in range(len(bins.items)):
        bins.enter(b)
    room = sum(f for b, f in enumerate(bins.free) if bins.items[b])
    better = True
    while better and room >= cap:
        better = False
        sources = sorted((b for own in bins.by_free.values() for b in own), key=lambda b: (-bins.free[b], b))
        for b in sources:
            if room < cap:
                break
            if not bins.free[b] or not bins.items[b]:
                continue
            bins.leave(b)
            while bins.items[b] and _step(bins, b):
                better = True
            if bins.items[b]:
                bins.enter(b)
            else:
                room -= cap
                emptied += 1
    return emptied


def _step(bins: Bins, b: int) -> bool:
    """One move or exchange out of bin b, which is no partner now; False if there is none."""
    cap, sizes = bins.capacity, bins.sizes
    fill = cap - bins.free[b]
    own = sorted(bins.items[b], key=lambda i: -sizes[i])
    tried = set()
    for i in own:
        s = sizes[i]
        if s not in tried:
            tried.add(s)
            fits = [f for f in bins.by_free if f >= s]
            if fits and cap - (f := min(fits)) + s > fill:
                bins.exchange(b, [i], min(bins.by_free[f]), [])
                return True
    for pair in (False, True):
        tried.clear()
        for i in own:
            s = sizes[i]
            if s not in tried:
                tried.add(s)
                if found := bins.partner(s, fill, pair):
                    bins.exchange(b, [i], found[0], bins.pick(found[0], found[1], pair))
                    return True
    tried.clear()
    for n, i in enumerate(own):
        for j in own[n + 1 :]:
            s = sizes[i] + sizes[j]
            if s not in tried and s <= cap:
                tried.add(s)
                if found := bins.partner(s, fill, False):
                    bins.exchange(b, [i, j], found[0], bins.pick(*found, False))
                    return True
    return False


def pack(sizes: np.ndarray, capacity: int, improve: bool = True) -> np.ndarray:
    """The bin of each item (sizes from 1 to capacity): bins filled up one by one, then the local search."""
    bins = fill_up(sizes, capacity)
    if improve:
        search(bins)
    where = np.zeros(len(sizes), np.int64)
    k = 0
    for items in bins.items:
        if items:
            where[items] = k
            k += 1
    return where


def fill_sequences(sized: DataFrame, capacities: dict[str, int], id_col: str = "doc_id", groups: int = 1) -> DataFrame:
    """The sequence of each text under each capacity; sized has id_col and n_tokens.

    A text larger than the capacity is cut into parts of full capacity, each a sequence of its own, and a rest that is
    packed like a text (part_no counts from 0). Empty texts take no room: they have one row with part 0, 0 tokens and
    null sequence and position. A null size counts as 0. Repeated rows are packed as so many texts. An empty table
    gives no rows. Items meet in `groups` groups by a hash of id and size; each group leaves at most one sequence poorly
    filled, so the loss shrinks with the group size, and no group depends on a key that could be hot.
    """
    budgets = sorted(capacities.items())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["_g"].iloc[0]) if len(pdf) else 0
        pdf = pdf.sort_values([id_col, "n_tokens"], kind="stable")
        ids, n = pdf[id_col].to_numpy(), pdf["n_tokens"].to_numpy(np.int64)
        out = []
        for name, cap in budgets:
            full, rest = n // cap, n % cap
            has = np.flatnonzero(rest > 0)
            bins = pack(rest[has], cap) if len(has) else np.zeros(0, np.int64)
            k = int(bins.max()) + 1 if len(has) else 0
            own = np.repeat(np.arange(len(n)), full)
            part = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full)
            empty = np.flatnonzero(n == 0)
            order = np.argsort(bins, kind="stable")
            position = np.empty(len(has), np.int64)
            first = np.searchsorted(bins[order], bins[order])
            position[order] = np.arange(len(has)) - first
            row = np.concatenate([own, has, empty])
            number = np.concatenate([k + np.arange(len(own)), bins, np.full(len(empty), -1)])
            out.append(pd.DataFrame({
                "budget_name": name,
                "doc_id": ids[row],
                "part_no": np.concatenate([part, full[has], empty * 0]),
                "n_tokens": np.concatenate([np.full(len(own), cap), rest[has], empty * 0]),
                "sequence_id": [None if x < 0 else f"{name}-{g}-{x}" for x in number.tolist()],
                "position": pd.array(np.concatenate([own * 0, position, np.full(len(empty), -1)]), dtype="Int32"),
            }))
            out[-1].loc[number < 0, "position"] = pd.NA
        return pd.concat(out)

    rows = sized.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
    keyed = rows.withColumn("_g", F.pmod(F.xxhash64(id_col, "n_tokens"), F.lit(max(1, groups))).cast("int"))
    return keyed.groupBy("_g").applyInPandas(run, RESULT)


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents in sequences of pack_small and pack_large."""
    docs = table(spark, sf_dir, "documents")
    budgets = table(spark, sf_dir, "token_budgets").where("budget_name like 'pack%'")  # a fixed table of four rows
    capacities = {r["budget_name"]: r["max_tokens"] for r in budgets.collect()}
    groups = -(-docs.count() // GROUP_ITEMS)
    return fill_sequences(encode(docs, counts_only=True), capacities, groups=groups)


QUERIES = {"p7_sequences": p7_sequences}
SQL: dict[str, str] = {}
