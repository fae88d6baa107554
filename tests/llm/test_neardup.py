import random
import re

import numpy as np
import pyarrow as pa

from tessera.llm import neardup

WORD = re.compile(r"[^\W_]+")


def triples(title, content):
    w = WORD.findall(f"{title or ''} {content or ''}".lower())
    return {x for x in zip(w, w[1:], w[2:])}


def brute(rows, least=0.6, few=40):
    sets = [(i, s) for i, *t in rows if len(s := triples(*t)) >= few]
    return sorted((min(a, b), max(a, b)) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if len(x & y) >= least * len(x | y))


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ünïcode", "it's", "a_b", "漢字", "İx", "½"]
    rows, k = [], 0
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 160))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            text = list(base)
            for _ in range(rng.randrange(0, 14)):
                p = rng.randrange(len(text))
                text[p : p + rng.randrange(2)] = [rng.choice(words)]
            rows.append((k, rng.choice([None, "Title"]), " ".join(text)))
            k += 1
    return rows


def test_equals_brute_force(spark):
    rows = corpus() + [(1000, None, None), (1001, "", ""), (1002, "a b c", "d")]
    want = brute(rows)
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "row_id long, title string, content string")).collect()))
    assert got == want


def test_large_groups_and_classes_open_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "COPIES", 3)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(30):  # one family, among it copies
        text = list(base)
        if k % 3:
            text[rng.randrange(120)] = f"x{k}"
        rows.append((k, None, " ".join(text)))
    df = spark.createDataFrame(rows, "row_id long, title string, content string")
    assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == brute(rows)


def test_edges(spark):
    schema = "row_id long, title string, content string, rep string"
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, None, text, "x"), (2, None, text.upper(), None), (None, None, text, None), (3, None, "short", None)], schema)
    assert [tuple(r) for r in neardup.near_duplicates(df).collect()] == [(1, 2)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_pairs_at_the_limit_are_all_found(spark):
    rng = random.Random(11)
    rows = []
    for k in range(120):  # each text and a copy whose end differs: from just under to just over the limit
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 400))]
        keep = round(0.75 * len(base)) + rng.randrange(-2, 4)
        rows += [(2 * k, None, " ".join(base)), (2 * k + 1, None, " ".join([*base[:keep], *(f"x{rng.randrange(10**6)}" for _ in base[keep:])]))]
        if k % 3 == 0:  # and one that is as long as the limit allows
            rows.append((1000 + k, None, " ".join([*base, *(f"y{rng.randrange(10**6)}" for _ in range(2 * (len(base) - 2) // 3))])))
    want = brute(rows)
    df = spark.createDataFrame(rows, "row_id long, title string, content string")
    assert len(want) > 80 and sorted(map(tuple, neardup.near_duplicates(df).collect())) == want


def test_very_long_texts_and_many_copies(spark):
    """A set with more rare triples in a part than 16 bits count, its near copy, and a third of all rows in one class."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**9)}" for _ in range(450_000)]
    rows = [(1, None, " ".join(words)), (2, None, " ".join([*words[:400_000], *(f"x{i}" for i in range(50_000))]))]
    small = " ".join(words[:80])
    rows += [(100 + k, None, small) for k in range(40)] + [(200 + k, None, " ".join(f"y{k}z{i}" for i in range(60))) for k in range(40)]
    df = spark.createDataFrame(rows, "row_id long, title string, content string")
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()))
    assert got == sorted([(1, 2), *((100 + a, 100 + b) for b in range(40) for a in range(b))])


def met(sets, parts=1):
    """Pairs of numbers of the sets that share a rare triple and pass the bounds."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([np.sort(x).tobytes() for x in sets], pa.binary())], names=["print", "triples"])
    packed = list(neardup._prefixes(0.6, np.zeros(neardup.SLOTS, np.uint16), parts)([batch]))
    return {tuple(sorted(p)) for b in neardup._meet(0.6)(packed) for p in zip(*(c.to_pylist() for c in b.columns))}


def test_unlike_long_sets_do_not_leave_their_part():
    """All share one rare triple; however long the sets, their parities tell that they share little else."""
    rng = np.random.default_rng(4)
    for n in (100, 300, 450, 900, 3000):
        sets = [np.append(rng.choice(1 << 31, n, replace=False) + 9, 1).astype(np.uint32) for _ in range(30)]
        like = sets[0].copy()
        like[: n // 5] = rng.choice(1 << 30, n // 5, replace=False) + (1 << 31) + 9
        assert met([*sets, like]) == {(0, 30)}, n


def test_parities_of_unequal_widths_lose_no_pair():
    """Sets just similar enough, of sizes around and across each width, in one part and in several."""
    rng = np.random.default_rng(6)
    for small in (100, 200, neardup.NARROW - 1, neardup.NARROW, 2 * neardup.NARROW, 4 * neardup.NARROW, 20 * neardup.NARROW):
        large = rng.choice(1 << 31, small * 10 // 6, replace=False).astype(np.uint32)
        assert (0, 1) in met([large, large[:small]]) and (0, 1) in met([large, large[:small]], 5)
        half = large[: small * 3 // 4]  # as large as the other, a quarter of each is its own
        other = np.append(half, rng.choice(1 << 31, small - len(half), replace=False).astype(np.uint32) + np.uint32(1 << 31))
        assert (0, 1) in met([large[:small], other])


def test_folded_parities_are_those_of_half_the_width(monkeypatch):
    flat = np.random.default_rng(8).choice(1 << 31, 500, replace=False).astype(np.uint32)
    own, size = np.zeros(500, np.int64), np.array([500])
    wide, n = neardup._parities(own, flat, size)
    monkeypatch.setattr(neardup, "NARROW", 500)
    narrow, _ = neardup._parities(own, flat, size)
    assert n[0] == 2 * len(narrow) and (wide[: len(narrow)] ^ wide[len(narrow) :] == narrow).all()
    assert neardup._differ(wide.reshape(1, -1))[0] == np.bitwise_count(wide).sum()


def test_parts_are_sorted_in_ranges_alike(monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.choice(1 << 31, 400, replace=False).astype(np.uint32)
    sets = [np.append(base[k : k + 200], rng.choice(1 << 31, 20, replace=False).astype(np.uint32)) for k in range(0, 200, 5)]
    want = met(sets)
    monkeypatch.setattr(neardup, "SORTED", 50)
    monkeypatch.setattr(neardup, "ENTRIES", 16)
    assert want and met(sets) == want == met(sets, 3)


def test_parts_grow_with_bytes_and_not_with_rows():
    """Headers are repeated in every part: 600,000 sets of 260 triples fit few parts, and no part is beyond its bytes."""
    assert neardup.part_count(600_000, 260, 0.6) < 12
    for n in (0, 10**5, 10**6, 3 * 10**7):
        parts = neardup.part_count(n, 260, 0.6)
        entries = n * 105 / parts
        assert min(n, entries) * 80 + entries * 5 < 1.1 * neardup.PART and parts < max(12, n // 5000)
