"""Streams run to their end over the tables, and the SQL of what they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_at_exit, scratch_path, table
from ..streaming import counters

QUERIES, SQL = {}, {}


def source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table, a folder or a single file, as a stream."""
    static = table(spark, d, name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d.rstrip('/')}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(static.schema)
    return reader.parquet(f"{d.rstrip('/')}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def run(df: DataFrame, name: str, mode: str) -> DataFrame:
    spark = df.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    counters.to_table(df, out, state, mode).awaitTermination()
    drop_at_exit(spark, out)
    drop_at_exit(spark, state)
    return spark.read.parquet(out)


def events(spark: SparkSession, d: str) -> DataFrame:
    return source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def sm07_daily_counts(spark, d):
    out = run(counters.daily_counts(events(spark, d), "ts", ["event_type"]), "daily", "complete")
    return out.select(F.floor(F.unix_micros("day") / 86_400_000_000).alias("day"), "event_type", "n")


def sm08_trailing_counts(spark, d):
    out = run(counters.trailing_counts(events(spark, d), "ts", ["event_type"]), "trailing", "complete")
    return out.select(F.floor(F.unix_micros("until") / 86_400_000_000).alias("until"), "event_type", "n")


def sm04_first_seen(spark, d):
    return run(counters.first_seen(events(spark, d), "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "seen", "append")


def sm05_breaker(spark, d):
    stats = source(spark, d, "feed_stats").where("url is not null")
    out = run(counters.breaker(stats, "url", "ran_at", "success"), "breaker", "append")
    return out.groupBy("key").agg(F.max("run").alias("longest"), F.count_if("open").alias("open_events"))


def sm05_timed_breaker(spark, d):
    """Circuits that close by themselves an hour after they opened."""
    stats = source(spark, d, "feed_stats").where("url is not null and ran_at is not null")
    out = run(counters.breaker(stats, "url", "ran_at", "success", closes_after="1 hour"), "timed-breaker", "append")
    return out.groupBy("key").agg(F.max("run").alias("longest"), F.count_if("open").alias("open_events"))


def sm03_on_time(spark, d):
    """Crawls of a day that arrived within a day of it."""
    stats = source(spark, d, "feed_stats").where("arrived_at - ran_at <= interval 24 hours")
    out = run(counters.daily_counts(stats, "ran_at", ["sourcetype"]), "on-time", "complete")
    return out.select(F.floor(F.unix_micros("day") / 86_400_000_000).alias("day"), "sourcetype", "n")


def sm09_sessions(spark, d):
    out = run(counters.sessions(events(spark, d), "ts", ["user_id"]), "sessions", "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES |= {"sm07_daily_counts": sm07_daily_counts, "sm08_trailing_counts": sm08_trailing_counts, "sm04_first_seen": sm04_first_seen, "sm05_breaker": sm05_breaker, "sm09_sessions": sm09_sessions, "sm05_timed_breaker": sm05_timed_breaker, "sm03_on_time": sm03_on_time}
SQL |= {
    "sm07_daily_counts": "select epoch_us(ts) // 86400000000 as day, event_type, count(*) n from events group by all",
    "sm08_trailing_counts": "select until, event_type, count(*) n from (select event_type, unnest(range(epoch_us(ts) // 86400000000 + 1, epoch_us(ts) // 86400000000 + 8)) until from events) group by all",
    "sm04_first_seen": "select distinct user_id, event_type from events",
    "sm05_breaker": "with x as (select url, stat_id, ran_at, coalesce(success, false) ok from feed_stats where url is not null), i as (select *, sum(ok::int) over (partition by url order by ran_at, stat_id rows unbounded preceding) g from x), r as (select url, sum(1 - ok::int) over (partition by url, g order by ran_at, stat_id rows unbounded preceding)::bigint run from i) select url as key, max(run) longest, cast(count(*) filter (run >= 5) as bigint) open_events from r group by url",
    "sm03_on_time": "select epoch_us(ran_at) // 86400000000 as day, sourcetype, count(*) n from feed_stats where arrived_at - ran_at <= interval 24 hour group by all",
    "sm05_timed_breaker": """with x as (select url as key, list({'us': epoch_us(ran_at), 'ok': coalesce(success, false), 'run': 0::bigint, 'opened': null::bigint, 'longest': 0::bigint, 'opens': 0::bigint} order by ran_at, stat_id) xs from feed_stats where url is not null and ran_at is not null group by url),
f as (select key, list_reduce(list_prepend({'us': 0::bigint, 'ok': true, 'run': 0::bigint, 'opened': null::bigint, 'longest': 0::bigint, 'opens': 0::bigint}, xs), lambda a, b: {'us': b.us, 'ok': b.ok, 'run': case when b.ok then 0 when a.opened is not null and b.us - a.opened > 3600000000 then 1 else a.run + 1 end,
 'opened': case when b.ok then null when (case when a.opened is not null and b.us - a.opened > 3600000000 then 1 else a.run + 1 end) = 5 then b.us when a.opened is not null and b.us - a.opened > 3600000000 then null else a.opened end,
 'longest': greatest(a.longest, case when b.ok then 0 when a.opened is not null and b.us - a.opened > 3600000000 then 1 else a.run + 1 end), 'opens': a.opens + case when not b.ok and (case when a.opened is not null and b.us - a.opened > 3600000000 then 1 else a.run + 1 end) >= 5 then 1 else 0 end}) r from x)
select key, r.longest longest, r.opens open_events from f""",
    "sm09_sessions": "with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end s from events), g as (select user_id, sum(s) over (partition by user_id order by ts rows unbounded preceding) g from x), c as (select user_id, g, count(*) n from g group by all) select user_id, count(*) sessions, max(n) longest from c group by user_id",
}
