import random

from pyspark.sql import functions as F

from tessera.operators import merge, series
from tessera.operators.dedup import first_wins, insert_or_ignore, layered_dedup


def model_layers(rows):
    seen, out = (set(), set()), {}
    for p, *keys in sorted(rows):
        hit = next((n for n, k, s in zip("ab", keys, seen) if k is not None and k in s), None)
        out[p] = hit
        if hit is None:
            for k, s in zip(keys, seen):
                if k is not None:
                    s.add(k)
    return out


def test_layers_equal_a_fold_in_order(spark):
    rng = random.Random(1)
    pick = lambda n: rng.choice([None, *map(str, range(n))])
    rows = [(i, pick(30), pick(25)) for i in range(200)]
    got = layered_dedup(spark.createDataFrame(rows, "p long, a string, b string"), ["a", "b"], "p")
    want = model_layers(rows)
    have = {r["p"]: r["dropped_by"] for r in got.collect()}
    assert {p for p, x in have.items() if x is None} == {p for p, x in want.items() if x is None}
    assert have == want
    assert layered_dedup(spark.createDataFrame([], "p long, a string"), ["a"], "p").count() == 0


def test_insert_or_ignore(spark):
    target = spark.createDataFrame([(0, "u0", "h0")], "p long, url string, h string")
    rows = [(1, "u1", "h1"), (2, "u1", "h2"), (3, "u0", "h3"), (4, "u4", "h1"), (5, None, "h5"), (6, None, None), (7, "u7", "h0")]
    got = insert_or_ignore(spark.createDataFrame(rows, "p long, url string, h string"), target, ["url", "h"], "p")
    assert sorted(r["p"] for r in got.collect()) == [1, 5, 6]


def test_merges(spark):
    target = spark.createDataFrame([("a", 1, 5), ("b", None, 2)], "k string, n long, m long")
    changes = spark.createDataFrame([("a", 2, None), ("a", 3, None), ("c", 1, 1)], "k string, n long, m long")
    assert sorted(map(tuple, merge.add_counts(target, changes, "k", ["n", "m"]).collect())) == [("a", 6, 5), ("b", 0, 2), ("c", 1, 1)]
    new = spark.createDataFrame([("a", None, 9), ("c", 1, None)], "k string, n long, m long")
    assert sorted(map(tuple, merge.fill_changes(target, new, "k").collect())) == [("a", 1, 9), ("b", None, 2), ("c", 1, None)]
    kept = merge.evict(target, 1, "true", [F.col("m")])
    assert [r["k"] for r in kept.collect()] == ["a"]
    assert merge.evict(target, 5, "true", [F.col("m")]).count() == 2


def test_series(spark):
    rows = [("a", 1, 10.0, True), ("a", 2, 20.0, False), ("a", 3, 0.0, False), ("b", 1, 7.0, None)]
    df = spark.createDataFrame(rows, "k string, t long, v double, ok boolean")
    e = 0.0
    for v in (10, 20, 0):
        e = e * 0.7 + v * 0.3
    got = {r["k"]: r["ema"] for r in series.ema(df, ["k"], ["t"], "v", 0.7).collect()}
    assert abs(got["a"] - e) < 1e-9 and abs(got["b"] - 2.1) < 1e-9
    runs = series.failure_runs(df, ["k"], [F.col("t")], F.col("ok"))
    assert sorted((r["k"], r["t"], r["run"]) for r in runs.collect()) == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 1, 1)]
    assert first_wins(df, ["k"], [F.col("t").desc()]).count() == 2


def test_fan_out_equals_a_theta_join(spark):
    s = spark.createDataFrame([("x", 80), ("y", 54), ("z", 100), ("n", None)], "j string, score int")
    p = spark.createDataFrame([("p", 70), ("q", None), ("r", 20)], "profile string, t int")
    got = sorted((r["j"], r["profile"]) for r in series.fan_out(s.where("score is not null"), "score", p, "t", 55).collect())
    assert got == [("x", "p"), ("x", "q"), ("x", "r"), ("z", "p"), ("z", "q"), ("z", "r")]
