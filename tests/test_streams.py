from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.streaming import counters

START = datetime(2024, 1, 1)


def stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def ran(spark, tmp_path, df, mode="append"):
    out = str(tmp_path / "out")
    counters.to_table(df, out, str(tmp_path / "state"), mode).awaitTermination()
    return spark.read.parquet(out)


def test_breaker_keeps_its_state_between_batches(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    batches = [[("a", at(2), False), ("a", at(1), True), ("b", at(1), None), (None, at(1), False)], [("a", at(3), False), ("a", at(4), False)], [("a", at(5), True), ("b", at(2), False)]]
    df = stream(spark, tmp_path, batches, "k string, ts timestamp, ok boolean")
    got = ran(spark, tmp_path, counters.breaker(df, "k", "ts", "ok", opens_at=3))
    rows = sorted((r["key"], r["at"].minute, r["run"], r["open"]) for r in got.collect())
    assert rows == [("a", 1, 0, False), ("a", 2, 1, False), ("a", 3, 2, False), ("a", 4, 3, True), ("a", 5, 0, False), ("b", 1, 1, False), ("b", 2, 2, False)]


def test_first_seen_and_counts(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    batches = [[("a", at(0)), ("a", at(1))], [("a", at(2)), ("b", at(30))]]
    df = stream(spark, tmp_path, batches, "k string, ts timestamp")
    assert sorted(r["k"] for r in ran(spark, tmp_path, counters.first_seen(df, "ts", ["k"])).collect()) == ["a", "b"]
    days = ran(spark, tmp_path / "days", counters.daily_counts(df, "ts", ["k"]), "complete")
    assert sorted((r["k"], r["n"]) for r in days.collect()) == [("a", 3), ("b", 1)]


def test_breaker_closes_by_itself_and_state_goes(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    batches = [[("a", at(k), False) for k in range(3)], [("a", at(3), False), ("a", at(40), False)], [("b", at(60 * 24 * 20), True)], [("b", at(60 * 24 * 20 + 1), False)], [("a", at(60 * 24 * 20 + 2), False)]]
    df = stream(spark, tmp_path, batches, "k string, ts timestamp, ok boolean")
    got = ran(spark, tmp_path, counters.breaker(df, "k", "ts", "ok", opens_at=3, closes_after="30 minutes", forget_after="7 days"))
    rows = [(r["key"], r["run"], r["open"]) for r in sorted(got.collect(), key=lambda r: (r["key"], r["at"]))]
    assert rows == [("a", 1, False), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("a", 1, False), ("a", 1, False), ("b", 0, False), ("b", 1, False)]


def test_keys_are_forgotten_and_late_rows_left_out(spark, tmp_path):
    at = lambda d: START + timedelta(days=d)
    batches = [[("a", at(0))], [("a", at(1)), ("b", at(10))], [("c", at(20))], [("d", at(20))], [("a", at(21))], [("a", at(2))]]
    df = stream(spark, tmp_path, batches, "k string, ts timestamp")
    got = ran(spark, tmp_path, counters.first_seen(df, "ts", ["k"]))
    assert sorted((r["k"], r["ts"].day) for r in got.collect()) == [("a", 1), ("a", 22), ("b", 11), ("c", 21), ("d", 21)]
    days = ran(spark, tmp_path / "days", counters.daily_counts(df, "ts", ["k"]), "append")
    assert ("a", 3) not in {(r["k"], r["day"].day) for r in days.collect()}


def test_threshold_moves_by_steps_within_bounds(spark):
    batch = spark.createDataFrame([(x,) for x in range(100)], "s int")
    assert counters.steered_threshold(batch, 50, "s") == 52
    assert counters.steered_threshold(batch, 70, "s") == 70
    assert counters.steered_threshold(batch.where(F.col("s") < 40), 50, "s") == 48
    assert counters.steered_threshold(batch.where("s between 50 and 53"), 50, "s") == 50
    assert counters.steered_threshold(batch.limit(0), 30, "s") == 30
