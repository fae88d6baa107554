"""Problem 5: records that share most of their word triples, by groups of similar records and their token unions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table, written
from .chargrid import LETTER, NUMBER, classes, join, mix, run_starts, slices, span_hashes

#: Minima that name a set's group: sets of similarity 0.9 have them in common in 59 of 100 cases, of 0.3 in 2 of 1,000.
MINIMA = 5
#: Members of a group that are opened at once; larger groups are opened in several blocks, each for every query.
BLOCK = 1024
#: Rows of a class of copies that are paired at once; larger classes are paired in several blocks.
COPIES = 512
#: Bits of the parities of a set of up to NARROW triples; sets of up to twice as many have twice the bits, and so on for
#: LEVELS. Parities much fewer than the triples of two sets differ in no more than half their slots, whatever the sets are.
PARITIES, NARROW, LEVELS = 512, 280, 5
#: SLOTS of the triples' sample counts, and the classes sampled for these; 64-bit COLUMNS of the token-group matrix.
SLOTS, SAMPLE, COLUMNS = 1 << 22, 40_000, 32
#: Bits, as a power of 2, of the sketches that tell which sets are needed: 4 MB. Many more classes than this has bits are
#: needed nearly all.
SKETCH = 25
#: Bytes of a part of the triples, about, entries of it that are sorted at once, and sets whose triples go to the parts
#: together.
PART, SORTED, PACK = 90_000_000, 1 << 20, 2048
#: Classes that a task remembers to leave out copies.
SEEN = 1_000_000
#: Pairs of rows that are looked at together in one task, those of them whose parities are, and entries of sets under triples.
AT_ONCE, NEAR_CACHE, ENTRIES = 1 << 19, 1 << 13, 1 << 18
SETS = "row_id long, print long, grp long, triples binary"


def triple_sets(texts: list[str], least: int):
    """Yields (text number, its distinct word triples as 32-bit hashes) of texts with at least so many triples."""
    for a, b in slices([len(t) for t in texts], 1 << 19):
        lower = [t.lower() for t in texts[a:b]]
        cps, ends = join(lower)
        if not len(cps):
            continue
        kind = classes()[cps]
        word = (kind == LETTER) | (kind == NUMBER)
        first = run_starts(word.view(np.uint8), ends)
        lo = np.flatnonzero(first & word)
        stop = np.append(np.flatnonzero(first), len(cps))
        hi = stop[np.searchsorted(stop, lo, "right")]
        h = span_hashes(cps, lo, hi)
        text = np.searchsorted(ends, lo, "right") - 1
        if len(lo) < 3:
            continue
        same = text[2:] == text[:-2]
        triple = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])[same] >> np.uint64(32)
        keyed = np.unique((text[:-2][same].astype(np.uint64) << np.uint64(32)) | triple)
        own = (keyed >> np.uint64(32)).astype(np.int64)
        at = np.searchsorted(own, np.arange(b - a + 1))
        values = keyed.astype(np.uint32)
        for i in np.flatnonzero(np.diff(at) >= least).tolist():
            yield a + i, values[at[i] : at[i + 1]]


def group_of(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of MINIMA minima of each set under as many permutations: the name of its group."""
    multiply = (mix(np.arange(MINIMA)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    flip = (mix(np.arange(MINIMA) + 7919) >> np.uint64(32)).astype(np.uint32)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros(len(sets), np.uint64)
    for k in range(MINIMA):
        out = mix(out ^ np.minimum.reduceat((flat ^ flip[k]) * multiply[k], starts).astype(np.uint64))
    return out.view(np.int64)


def _sets(least: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in slices(lengths, 1 << 21):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                found = list(triple_sets(texts, least))
                if found:
                    sets = [x for _, x in found]
                    prints = [int(np.add.reduce(mix(x)).view(np.int64)) for x in sets]
                    own = ids.slice(a, b - a).take(pa.array([i for i, _ in found]))
                    columns = [own, pa.array(prints, pa.int64()), pa.array(group_of(sets)), pa.array([x.tobytes() for x in sets], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["row_id", "print", "grp", "triples"])

    return run


def _once(batches):
    """The first row of each class within a task: copies are left out before anything is shuffled. What has been seen is
    forgotten at SEEN classes; later stages leave out copies anyway."""
    seen: set[int] = set()
    for batch in batches:
        if len(seen) > SEEN:
            seen.clear()
        keep = []
        for i, x in enumerate(batch.column(0).to_pylist()):
            if x not in seen:
                seen.add(x)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep))


def _counts(batches):
    """(slot, n): how many sets of a task hold triples of each of SLOTS ranges."""
    total = np.zeros(SLOTS, np.int64)
    for batch in _once(batches):
        for raw in batch.column(1).to_pylist():
            total[np.frombuffer(raw, np.uint32) // np.uint32((1 << 32) // SLOTS)] += 1
    at = np.flatnonzero(total)
    for lo in range(0, len(at), 1 << 16):
        part = at[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "n"])


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from each first on, one after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _level(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(NARROW << np.arange(LEVELS - 1), size)


def _parities(own: np.ndarray, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words of the sets' parities, one set after the other; how many each set has). Slots are numbered so that
    the exclusive or of both halves of a set's parities is its parities of half the width."""
    bits = np.int64(PARITIES) << _level(size)
    slot = ((flat * np.uint32(0x9E3779B1)) >> np.uint32(8)).astype(np.int64) & (bits - 1)[own]
    odd = np.bincount((np.cumsum(bits) - bits)[own] + slot, minlength=bits.sum()) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64), bits >> 6


def _prefixes(least: float, common: np.ndarray, parts: int):
    """-> rows of PARTS: for each part of the triples, of PACK sets at once, those that have a rare triple of the part, with
    their sizes and parities, and these triples with their places in the set's order.

    The order is by `common`, then by hash, the same for all sets: any order is exact, a good one makes it fast. At a
    similarity of `least` sets share `least` x the size of either, so the first triple that they share leaves that many
    from its place on."""

    def pack(reps: list[int], sets: list[np.ndarray]):
        size = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        own = np.repeat(np.arange(len(sets)), size)
        parity, words = _parities(own, flat, size)
        first = np.cumsum(words) - words
        order = np.lexsort((flat, common[flat // np.uint32((1 << 32) // SLOTS)], own))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        rare = place < np.repeat(size - np.ceil(least * size - 1e-9).astype(np.int64) + 1, size)
        flat, own, place = flat[order][rare], own[rare], np.minimum(place[rare], 255).astype(np.uint8)  # a lower place only loosens the bound
        part = (mix(flat) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((own, part))
        flat, own, place, part = flat[order], own[order], place[order], part[order]
        reps_, size = np.array(reps), size.astype(np.int32)
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            who, n = np.unique(own[a:b], return_counts=True)
            rows.append((int(part[a]), reps_[who].tobytes(), size[who].tobytes(), n.astype(np.int32).tobytes(), parity[_ranges(first[who], words[who])].tobytes(), flat[a:b].tobytes(), place[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 6))], names=PART_NAMES)

    def run(batches):
        reps, sets = [], []
        for batch in _once(batches):
            for rep, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reps.append(rep)
                sets.append(np.frombuffer(raw, np.uint32))
                if len(reps) == PACK:
                    yield pack(reps, sets)
                    reps, sets = [], []
        if reps:
            yield pack(reps, sets)

    return run


PART_NAMES = ["part", "reps", "sizes", "counts", "parities", "triples", "places"]
PARTS = "part int, " + ", ".join(f"{x} binary" for x in PART_NAMES[1:])


def _meet(least: float):
    """Rows of one part -> (a, b): all pairs of sets that share a rare triple and may be similar by two bounds, neither of
    which can lose a pair: what is left of each set from the shared triple on, and the parities, which differ in no more
    slots than the sets do in triples."""

    def run(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                parts.setdefault(batch.column(0)[row].as_py(), []).append([batch.column(k)[row].as_py() for k in range(1, 7)])
        while parts:
            yield from _meet_part(parts.popitem()[1], least)

    return run


def _meet_part(rows: list, least: float):
    columns = [list(c) for c in zip(*rows)]
    rows.clear()

    def joined(k: int, kind) -> np.ndarray:
        raw, columns[k] = b"".join(columns[k]), []
        return np.frombuffer(raw, kind)

    rep, size, count = joined(0, np.int64), joined(1, np.int32).astype(np.int64), joined(2, np.int32)
    once = np.zeros(len(rep), bool)
    once[np.unique(rep, return_index=True)[1]] = True
    sketches = _sketches(joined(3, np.uint64), size, once)
    triples, places = joined(4, np.uint32), joined(5, np.uint8)
    if not once.all():  # copies from other tasks
        kept = np.repeat(once, count)
        rep, size, triples, places, count = rep[once], size[once], triples[kept], places[kept], count[once]
    own = np.repeat(np.arange(len(rep), dtype=np.int32), count)
    found, many = [], 0
    cuts = np.linspace(0, 1 << 32, max(1, -(-len(triples) // SORTED)) + 1).astype(np.int64)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        mine = slice(None) if len(cuts) == 2 else np.flatnonzero((triples >= lo) & (triples < hi))
        for pairs in _candidates(own[mine], triples[mine], places[mine], size, sketches, least):
            found.append(pairs)
            many += len(pairs)
            if many > 4 * AT_ONCE:
                found = [np.unique(np.concatenate(found))]
                many = len(found[0])
                if many > 2 * AT_ONCE:
                    yield _met(rep, found[0])
                    found, many = [], 0
    if many:
        yield _met(rep, np.unique(np.concatenate(found)))


def _sketches(words: np.ndarray, size: np.ndarray, once: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each width of parities, the narrowest first: the row of each class that has so many or more, else -1, and the
    rows. Classes are numbered by `once`."""
    level = _level(size)
    n = (PARITIES >> 6) << level
    number = np.cumsum(once) - 1
    out, who, table = [], np.zeros(0, np.int64), np.zeros((0, PARITIES >> 6 << LEVELS), np.uint64)
    for k in reversed(range(LEVELS)):
        wide = table.shape[1] // 2
        more = (level == k) & once
        table = np.concatenate([table[:, :wide] ^ table[:, wide:], words[np.repeat(more, n)].reshape(-1, wide)])
        who = np.concatenate([who, number[more]])
        if len(who):
            row = np.full(int(once.sum()), -1, np.int32)
            row[who] = np.arange(len(who), dtype=np.int32)
            out.append((row, table))
    return out[::-1]


def _candidates(who, triples, places, size, sketches, least: float):
    """Pairs of classes, as one number each, of entries (class, triple, its place in the class) with one triple."""
    rest = (size[who] - places).astype(np.int32)
    keyed = (triples.astype(np.int64) << 31) | size[who]
    order = np.argsort(keyed)
    keyed, who, rest = keyed[order], who[order], rest[order]
    del triples, places, order
    share = least / (1 + least)  # of both sizes
    for start in range(0, len(keyed), ENTRIES):
        mine = slice(start, start + ENTRIES)
        # The smaller set of a pair is asked for sets up to the size that what is left of it allows.
        own = size[who[mine]]
        most = np.minimum((rest[mine] / share + 1e-6).astype(np.int64) - own, (1 << 31) - 1)
        n = np.searchsorted(keyed, (keyed[mine] >> 31 << 31) | np.maximum(most, 0), "right") - np.arange(start, start + len(own)) - 1
        n = np.where(most >= own, np.maximum(n, 0), 0)
        ends, lo = np.cumsum(n), 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[lo] + AT_ONCE, "right")))
            yield _alike(np.arange(start + lo, start + hi), n[lo:hi], who, rest, size, sketches, share)
            lo = hi


def _alike(at: np.ndarray, n: np.ndarray, who, rest, size, sketches, share: float) -> np.ndarray:
    """Pairs, as one number each, of the entries at `at` with the n entries behind each that both bounds let pass."""
    i, j = np.repeat(at, n), _ranges(at + 1, n)
    both = size[who[i]] + size[who[j]]
    ok = np.flatnonzero(rest[j] >= share * both - 1e-6)
    a, b, most = who[i[ok]], who[j[ok]], (1 - 2 * share) * both[ok] + 1e-6
    for row, table in sketches:
        x, y = row[a], row[b]
        ok = np.ones(len(a), bool)
        with_both = np.flatnonzero((x >= 0) & (y >= 0))
        for k in range(0, len(with_both), NEAR_CACHE):
            part = with_both[k : k + NEAR_CACHE]
            ok[part] = _differ(table[x[part]] ^ table[y[part]]) <= most[part]
        a, b, most = a[ok], b[ok], most[ok]  # of the pairs left
    return np.unique((np.minimum(a, b).astype(np.int64) << 32) | np.maximum(a, b))


def _differ(words: np.ndarray) -> np.ndarray:
    """Bits set in each row of a multiple of eight words: bytes are added up within words, as two bytes can hold 512."""
    eight = np.bitwise_count(words).view(np.uint64)
    low = np.uint64(0x00FF00FF00FF00FF)
    eight = (((eight & low) + ((eight >> np.uint64(8)) & low)) * np.uint64(0x0001000100010001)) >> np.uint64(48)
    return eight[:, 0] if eight.shape[1] == 1 else eight.sum(axis=1)


def _met(rep: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rep[pairs >> 32]), pa.array(rep[pairs & 0xFFFFFFFF])], names=["a", "b"])


def sketch(reps: DataFrame) -> np.ndarray:
    """A bit for each of 2 ** SKETCH hashes of the classes named by rep: of fixed size, whatever their number."""
    at = F.pmod(F.xxhash64("rep"), F.lit(1 << SKETCH))
    bit = F.expr("shiftleft(1L, cast(_at % 64 as int))")
    words = reps.select(at.alias("_at")).select(F.floor(F.col("_at") / 64).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (SKETCH - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _needed(sets: DataFrame, known) -> DataFrame:
    """print, triples of the classes that the sketch (a broadcast) has, and of few others."""
    slot = F.pmod(F.xxhash64("print"), F.lit(1 << SKETCH)).alias("slot")

    def run(batches):
        bits = known.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = np.flatnonzero((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
            if len(keep):
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (0, 1)], names=["print", "triples"])

    return sets.select("print", "triples", slot).mapInArrow(run, "print long, triples binary")


def _matrix_rows(batches):
    """(rep, size, m0, ...): the columns of the token-group matrix that a set's triples fall in, one bit each."""
    for batch in _once(batches):
        raw = batch.column(1).to_pylist()
        for lo in range(0, len(raw), 1024):
            part = raw[lo : lo + 1024]
            flat = np.frombuffer(b"".join(part), np.uint32)
            size = np.array([len(x) // 4 for x in part])
            bits = np.zeros((len(part), COLUMNS * 64), np.uint8)
            bits[np.repeat(np.arange(len(part)), size), (flat * np.uint32(0x85EBCA6B)) >> np.uint32(32 - (COLUMNS * 64 - 1).bit_length())] = 1
            words = np.packbits(bits, axis=1).view(np.int64)
            columns = [batch.column(0).slice(lo, len(part)), pa.array(size, pa.int64()), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(COLUMNS))]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "size", *(f"m{k}" for k in range(COLUMNS))])


class Group:
    """Members of one block of a group: their token union and, for each of its tokens, the members that have it."""

    def __init__(self, ids: tuple[int, ...], sets: tuple[np.ndarray, ...]):
        self.ids, self.sizes = np.array(ids), np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.member = member[order]
        self.union, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))

    def similar(self, tokens: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Members whose similarity to the set is at least `least`, and the tokens shared with each.

        No member can share more tokens than the union does: if these are under least x size, the group stays shut."""
        at = np.searchsorted(self.union, tokens)
        at = at[(at < len(self.union)) & (self.union[np.minimum(at, len(self.union) - 1)] == tokens)]
        if len(at) < least * len(tokens):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = self.first[at + 1] - self.first[at]
        shared = np.bincount(self.member[_ranges(self.first[at], n)], minlength=len(self.ids))
        hit = np.flatnonzero(shared >= least * (len(tokens) + self.sizes - shared) - 1e-9)
        return hit, shared[hit]


def _open_groups(least: float):
    """Batches sorted by (grp, block, role, rep): members (role 0), then queries (role 1) -> pairs of classes.

    Members of a block are queries to it as well."""

    def run(batches):
        here, members, group, last = None, [], None, None
        for batch in batches:
            out = []
            for grp, block, role, rep, own, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, block) != here:
                    if members:
                        out += _among(Group(*zip(*members)), members, least)
                    here, members, group, last = (grp, block), [], None, None
                if (role, rep) == last:  # a copy from another task
                    continue
                last = role, rep
                tokens = np.frombuffer(raw, np.uint32)
                if role == 0:
                    members.append((rep, tokens))
                    continue
                if group is None:
                    if not members:
                        continue
                    group = Group(*zip(*members))
                    out += _among(group, members, least)
                    members = []
                hit, shared = group.similar(tokens, least)
                for m, n in zip(hit.tolist(), shared.tolist()):
                    other = int(group.ids[m])
                    if own != grp or rep < other:  # between blocks of a group each pair is seen from both sides
                        out.append((min(rep, other), max(rep, other), n))
            if out:
                yield _pairs(out)
        if members and (out := _among(Group(*zip(*members)), members, least)):
            yield _pairs(out)

    return run


def _pairs(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["rep_a", "rep_b", "shared"])


def _among(group: Group, members: list, least: float) -> list[tuple[int, int, int]]:
    out = []
    if len(members) > 1:
        for rep, tokens in members:
            hit, shared = group.similar(tokens, least)
            out += [(rep, int(group.ids[m]), n) for m, n in zip(hit.tolist(), shared.tolist()) if rep < group.ids[m]]
    return out


def part_count(n: int, triples: float, least: float) -> int:
    """How many parts the triples of n sets of so many triples go to, that a part has some PART bytes: what each set has
    for a header in each part where it has a rare triple is far more than the triples, so parts are as few as can be."""
    rare = (1 - least) * triples + 1
    head = 16 + ((PARITIES >> 3) << int(_level(np.array([triples]))[0]))
    parts = 1
    while n * (head * (1 - (1 - 1 / parts) ** rare) + 5 * rare / parts) > PART:
        parts += 1 + parts // 16
    return parts


def similar_classes(df: DataFrame, id_col: str, text: F.Column, least: float, least_triples: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership): pairs (rep_a < rep_b, shared) of classes of equal sets whose similarity is at least `least`,
    and the class (row_id, rep) of each row with at least `least_triples` triples. A class is named by a 64-bit print of
    its set."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), text.alias("text")).where("row_id is not null")
    sets = written(spread(rows).mapInArrow(_sets(least_triples), SETS), "sets")
    membership = sets.select("row_id", F.col("print").alias("rep")).distinct()
    groups = sets.select(F.col("print").alias("rep"), "grp").distinct()

    # Which classes may be similar: those that share one of their rarest triples, within two bounds.
    n = sets.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = sets.where(F.pmod(F.xxhash64("print"), F.lit(1 << 20)) < round(share * (1 << 20)))
    triples = (sample.agg(F.avg(F.octet_length("triples"))).first()[0] or 0) / 4
    parts = max(min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), part_count(n, triples, least), 1)
    counts = sample.select("print", "triples").mapInArrow(_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    common = np.zeros(SLOTS, np.uint16)
    common[counts["slot"].to_numpy()] = np.minimum(counts["n"].to_numpy(), 65535)
    rare = sets.select("print", "triples").mapInArrow(_prefixes(least, common, parts), PARTS)
    near = written(rare.repartitionById(parts, "part").mapInArrow(_meet(least), "a long, b long"), "near")

    # A query asks the groups of these classes; a pair across groups is looked for from one side.
    a, b = (groups.select(F.col("rep").alias(x), F.col("grp").alias(f"grp_{x}")) for x in "ab")
    across = near.distinct().join(a, "a").join(b, "b").where("grp_a <> grp_b")
    first = F.col("grp_a") < F.col("grp_b")
    abroad = across.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("rep"), F.least("grp_a", "grp_b").alias("own"), F.greatest("grp_a", "grp_b").alias("grp")).distinct()
    abroad = written(abroad, "abroad")

    size = groups.groupBy("grp").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = abroad.select("grp").distinct().withColumn("asked", F.lit(True))
    size = size.join(asked, "grp", "left").where("n > 1 or asked").select("grp", "blocks", "asked")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    home = written(groups.join(size, "grp").withColumn("block", block), "members")
    known = spark.sparkContext.broadcast(sketch(home.select("rep").unionByName(abroad.select("rep"))))

    # The token-group matrix: the union of each asked block's triples; a query whose overlap with it can't reach `least` of
    # its own size stays outside, before any set is moved.
    names = [f"m{k}" for k in range(COLUMNS)]
    matrix_rows = _needed(sets, known).mapInArrow(_matrix_rows, "rep long, size long, " + ", ".join(f"{x} long" for x in names))
    union = home.where("asked").join(matrix_rows, "rep").groupBy("grp", "block").agg(*[F.bit_or(x).alias(f"u{k}") for k, x in enumerate(names)])
    queries = abroad.join(home.select("grp", "blocks").distinct(), "grp").select("grp", all_blocks.alias("block"), "rep", "own")
    missing = sum((F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(f"u{k}")))) for k, x in enumerate(names)), F.lit(0))
    met = queries.join(union, ["grp", "block"]).join(matrix_rows, "rep").where(F.col("size") - missing >= F.ceil(F.col("size") * least - 1e-9))

    members = home.select("grp", "block", F.lit(0).alias("role"), "rep", F.col("grp").alias("own"))
    inside = home.where("blocks > 1").select("grp", all_blocks.alias("block"), F.lit(1).alias("role"), "rep", F.col("grp").alias("own"), F.col("block").alias("home")).where("block != home").drop("home")
    outside = met.select("grp", "block", F.lit(1).alias("role"), "rep", "own")
    tokens = _needed(sets, known).withColumnRenamed("print", "rep").mapInArrow(_once, "rep long, triples binary")
    work = members.unionByName(inside).unionByName(outside).join(tokens, "rep")
    work = work.select("grp", "block", "role", "rep", "own", "triples").repartition("grp", "block").sortWithinPartitions("grp", "block", "role", "rep")
    return work.mapInArrow(_open_groups(least), "rep_a long, rep_b long, shared long"), membership


def row_pairs(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """All pairs of rows (row_a < row_b) of similar classes, and of one class."""
    per_class = membership.groupBy("rep").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("blocks"))
    rows = membership.join(per_class, "rep")
    blocked = rows.select("rep", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int").alias("block"), F.col("row_id").alias("y"))
    spread = rows.select("rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("row_id").alias("x"))
    same = spread.join(blocked, ["rep", "block"]).where("x < y").select(F.col("x").alias("row_a"), F.col("y").alias("row_b"))
    a = membership.select(F.col("rep").alias("rep_a"), F.col("row_id").alias("x"))
    b = membership.select(F.col("rep").alias("rep_b"), F.col("row_id").alias("y"))
    across = pairs.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"))
    return same.unionByName(across)


def near_duplicates(df: DataFrame, id_col: str = "row_id", title_col: str = "title", text_col: str = "content", least: float = 0.6, least_triples: int = 40) -> DataFrame:
    """(row_a, row_b), row_a < row_b: rows whose shared word triples are at least `least` of those that either has.

    A record's text is its title, a blank and its content, nulls as empty, in lower case. Rows with fewer than
    `least_triples` distinct triples (null, empty and very short texts among them) and rows with a null id are in no
    pair; a row id given twice is one row as to itself, its texts are compared with others; an empty table gives no
    rows; other columns, whatever their names, are ignored. Whole texts count, and no group, bucket or class is capped:
    large ones are opened in blocks.
    """
    text = F.concat(F.coalesce(F.col(title_col), F.lit("")), F.lit(" "), F.coalesce(F.col(text_col), F.lit("")))
    return row_pairs(*similar_classes(df, id_col, text, least, least_triples))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "raw_jobs"))


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
