import random

from tessera.operators import search


def test_near_hashes_lose_no_pair(spark):
    rng = random.Random(4)
    rows = [(k, rng.getrandbits(32)) for k in range(60)]
    rows += [(100 + k, h ^ sum(1 << b for b in rng.sample(range(32), k % 7))) for k, h in rows]  # any bits, the first ones too
    got = search.near_hashes(spark.createDataFrame(rows, "i long, h long"), "i", "h").collect()
    want = {(a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 5}
    assert len(got) == len(want) and set(map(tuple, got)) == want and len(want) > 40


def cosines(rows):
    dot = lambda x, y: sum(i * j for i, j in zip(x, y))
    return {(a, b): round(dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5, 6) for a, x, _ in rows for b, y, _ in rows}


def test_vectors_are_compared_in_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = random.Random(6)
    rows = [(k, [float(rng.randrange(-3, 4)) for _ in range(3)] + [1.0], k % 3) for k in range(70)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    sims = cosines(rows)
    got = {(r["query"], r["vec_id"]): r["sim"] for r in search.compared(df, df, least=0.88).collect()}
    assert got == {(a, b): s for (a, b), s in sims.items() if a < b and s >= 0.88} and len(got) > 20


def test_each_query_has_its_own_nearest(spark, tmp_path):
    from tessera.plans import texts

    rng = random.Random(7)
    rows = [(k, [float(rng.randrange(-3, 4)) for _ in range(4)] + [1.0], k % 3) for k in range(70)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sims, label = cosines(rows), {k: g for k, _, g in rows}
    order = lambda q, ids: sorted(ids, key=lambda e: (-sims[q, e], e))
    want = {(q, e, n) for q in range(0, 70, 20) for n, e in enumerate(order(q, label)[:10], 1)}
    assert {(r["query"], r["vec_id"], r["n"]) for r in texts.QUERIES["vc03_top_per_query"](spark, str(tmp_path)).collect()} == want
    want = {(q, g, e, n) for q in range(0, 70, 20) for g in range(3) for n, e in enumerate(order(q, [e for e in label if label[e] == g])[:5], 1)}
    assert {(r["query"], r["label"], r["vec_id"], r["n"]) for r in texts.QUERIES["vc04_top_per_query_and_label"](spark, str(tmp_path)).collect()} == want
