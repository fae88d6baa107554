"""Cursors, telemetry, shapes, maps, dates, addresses and steered thresholds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import maps, text
from ..operators.instants import normalise_instants
from ..operators.search import compared
from ..operators.series import steered
from ..session import drop_at_exit, scratch_path
from ..sources.discovery import chosen_portfolios
from ..sources.mock import ROLES, mock_postings
from .registry import Registry
from .texts import _asked, _fold, _units

R = Registry()
QUERIES, SQL = R.queries, R.sql
day = lambda c: F.floor(F.unix_micros(F.col(c)) / 86_400_000_000)


@R.add("src05_advancing_cursor", "with first as (select sourceurl, max(fetched_at) as cursor from raw_jobs where sourceurl is not null and row_id % 2 = 0 group by sourceurl), later as (select r.row_id, r.sourceurl, r.fetched_at from raw_jobs r left join first f on r.sourceurl = f.sourceurl where r.sourceurl is not null and r.row_id % 2 = 1 and (f.cursor is null or r.fetched_at > f.cursor)), a as (select sourceurl, max(fetched_at) m, count(*) n from later group by sourceurl) select coalesce(f.sourceurl, a.sourceurl) sourceurl, epoch_us(greatest(f.cursor, a.m)) as cursor_us, coalesce(n, 0) as taken from first f full join a on f.sourceurl = a.sourceurl")
def _(t):
    """Two runs over two deliveries: what a source sent after its cursor is taken, and the cursor moves to the latest of it."""
    jobs = t("raw_jobs").where("sourceurl is not null").select("row_id", "sourceurl", "fetched_at")
    first = jobs.where("row_id % 2 = 0").groupBy("sourceurl").agg(F.max("fetched_at").alias("cursor"))
    taken = jobs.where("row_id % 2 = 1").join(first, "sourceurl", "left").where("cursor is null or fetched_at > cursor")
    latest = taken.groupBy("sourceurl").agg(F.max("fetched_at").alias("m"), F.count("*").alias("n"))
    return first.join(latest, "sourceurl", "full").select("sourceurl", F.unix_micros(F.greatest("cursor", "m")).alias("cursor_us"), F.coalesce("n", F.lit(0)).alias("taken"))


@R.add("src39_feed_shape", "select url as \"sourceUrl\", sourcetype as \"sourceType\", name as \"sourceName\" from source_registry")
def _(t):
    return t("source_registry").select(F.col("url").alias("sourceUrl"), F.col("sourcetype").alias("sourceType"), F.col("name").alias("sourceName"))


def src41_mock_postings(spark, d):
    return mock_postings(spark, 5000)


QUERIES["src41_mock_postings"] = src41_mock_postings
SQL["src41_mock_postings"] = f"select 'mock-' || i as id, {list(ROLES)}[1 + i % 4] || ' ' || i as title, 'Firm ' || (i % 50) as company, 'https://jobs.example/' || i as link, 'hash-' || case when i % 10 = 9 then i - 9 else i end as content_hash from range(5000) r(i)"


@R.add("snk13_run_metrics", "select epoch_us(ran_at) // 86400000000 as day, count(*) runs, coalesce(sum(job_count), 0)::bigint found, count(*) filter (error <> '')::bigint failed from feed_stats where ran_at is not null group by 1")
def _(t):
    """Two appends to a table of runs, read back."""
    stats = t("feed_stats").where("ran_at is not null")
    path = scratch_path(stats.sparkSession, "runs")
    rows = stats.groupBy(day("ran_at").alias("day")).agg(F.count("*").alias("runs"), F.coalesce(F.sum("job_count"), F.lit(0)).alias("found"), F.count_if(F.col("error") != "").alias("failed"))
    for part in (0, 1):
        rows.where(F.pmod("day", F.lit(2)) == part).write.mode("append").parquet(path)
    drop_at_exit(stats.sparkSession, path)
    return stats.sparkSession.read.schema(rows.schema).parquet(path)


@R.add("prj03_alert_payload", "select row_id, coalesce(title, '') title, coalesce(company, '') company, substr(coalesce(content, ''), 1, 300) snippet, coalesce(nullif(link, ''), url) link from raw_jobs")
def _(t):
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return t("raw_jobs").select("row_id", blank("title"), blank("company"), F.substring(F.coalesce("content", F.lit("")), 1, 300).alias("snippet"), F.coalesce(F.nullif("link", F.lit("")), "url").alias("link"))


@R.add("prj05_records", "select url as \"sourceUrl\", coalesce(success_count, 0) as \"successCount\", coalesce(failure_count, 0) as \"failureCount\", coalesce(state, 'active') as state, coalesce(priority_score, 50.0)::double as \"priorityScore\" from source_registry")
def _(t):
    get = lambda c, default, name: F.coalesce(c, F.lit(default)).alias(name)
    return t("source_registry").select(F.col("url").alias("sourceUrl"), get("success_count", 0, "successCount"), get("failure_count", 0, "failureCount"), get("state", "active", "state"), get("priority_score", 50.0, "priorityScore"))


@R.add("flt01_new_postings")
def _(t):
    """Records whose date, pubdate before isodate, names an instant at most a day before the delivery; later ones pass, those
    without an instant don't."""
    jobs = t("raw_jobs")
    found = normalise_instants(jobs, t("feed_locales"), ["pubdate", "isodate"])
    best = found.groupBy("row_id").agg(F.max_by("utc_us", "field").alias("utc_us"))  # "pubdate" is the greater name
    return best.join(jobs.select("row_id", F.unix_micros("fetched_at").alias("now")), "row_id").where("now - utc_us <= 86400000000").select("row_id", "utc_us")


@R.add("st04_cumulative", "select domain, origin from (select domain, origin, row_number() over (partition by domain order by origin) n from (select domain, '1 registry' origin from source_registry union all select regexp_replace(lower(regexp_extract(sourceurl, '^https?://([^/:?#]+)', 1)), '^www\\.', ''), '2 records' from raw_jobs where sourceurl is not null union all select regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', ''), '3 crawls' from feed_stats where url is not null) where domain <> '') where n = 1")
def _(t):
    """Vectors in order; a domain belongs to the first that finds it, which a minimum tells before rows meet."""
    parts = [t("source_registry").select("domain", F.lit("1 registry").alias("origin")), t("raw_jobs").select(text.domain(F.col("sourceurl")).alias("domain"), F.lit("2 records").alias("origin")), t("feed_stats").select(text.domain(F.col("url")).alias("domain"), F.lit("3 crawls").alias("origin"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("domain <> ''").groupBy("domain").agg(F.min("origin").alias("origin"))


@R.add("ma04_mean_of_top", f"with {_asked}, r as (select *, row_number() over (partition by query order by sim desc, vec_id) n from s) select query, round(avg(sim), 5) mean from r where n <= 5 group by query")
def _(t):
    e = t("embeddings")
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "vec_id")
    best = compared(e.withColumn("label", F.lit(0)), e.where("vec_id % 20 = 0"), k=5).withColumn("n", F.row_number().over(w)).where("n <= 5")
    return best.groupBy("query").agg(F.round(F.avg("sim"), 5).alias("mean"))


@R.add("sx29_short_keys", f"select url, ltrim({_fold.format(_units.format('url'))}, '0') as key from source_registry")
def _(t):
    return t("source_registry").select("url", F.regexp_replace(text.lossy_fnv(F.col("url")), "^0+", "").alias("key"))


@R.add("dt03_previous_day", "with d as (select epoch_us(fetched_at) // 86400000000 as day, count(*) n from raw_jobs where fetched_at is not null group by 1) select a.day, a.n, coalesce(b.n, 0) as previous from d a left join d b on b.day = a.day - 1")
def _(t):
    d = t("raw_jobs").where("fetched_at is not null").groupBy(day("fetched_at").alias("day")).agg(F.count("*").alias("n"))
    before = d.select((F.col("day") + 1).alias("day"), F.col("n").alias("previous"))
    return d.join(before, "day", "left").select("day", "n", F.coalesce("previous", F.lit(0)).alias("previous"))


@R.add("dt07_dates", "select row_id, strftime(make_timestamp(epoch_us(fetched_at)), '%b %d, %Y') as date from raw_jobs where fetched_at is not null")
def _(t):
    return t("raw_jobs").where("fetched_at is not null").select("row_id", F.date_format("fetched_at", "MMM dd, yyyy").alias("date"))


@R.add("js02_texts", "select profile_id, to_json({'id': profile_id, 'name': coalesce(name, ''), 'threshold': coalesce(notification_threshold, 0)})::varchar as json from profiles")
def _(t):
    record = F.struct(F.col("profile_id").alias("id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("notification_threshold", F.lit(0)).alias("threshold"))
    return t("profiles").select("profile_id", F.to_json(record).alias("json"))


@R.add("mp01_merged_counts", "select sourcetype, (row_number() over (partition by sourcetype order by n desc, category))::int as place, category, n from (select sourcetype, category, count(*) n from (select sourcetype, unnest(categories) category from raw_jobs where sourcetype is not null) where category is not null group by all)")
def _(t):
    """Maps of two halves of the records, merged: the categories of a type of source are few."""
    jobs = t("raw_jobs").where("sourcetype is not null").select("sourcetype", (F.col("row_id") % 2).alias("half"), F.explode("categories").alias("category")).where("category is not null")
    counts = jobs.groupBy("sourcetype", "half", "category").agg(F.count("*").alias("n"))
    half = lambda k: counts.where(F.col("half") == k).groupBy("sourcetype").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias(f"m{k}"))
    both = half(0).join(half(1), "sourcetype", "full").select("sourcetype", F.posexplode(maps.by_count(maps.merged(F.col("m0"), F.col("m1")))).alias("place", "e"))
    return both.select("sourcetype", (F.col("place") + 1).alias("place"), F.col("e.key").alias("category"), F.col("e.value").alias("n"))


@R.add("ur01_parts", "select row_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path, url || '?q=a b' as decoded from raw_jobs where regexp_matches(url, '^https?://[^/\\s]+')")
def _(t):
    u = F.col("url")
    encoded = F.concat(u, F.lit("?q=a%20b"))
    return t("raw_jobs").where(u.rlike(r"^https?://[^/\s]+")).select("row_id", F.lower(F.try_parse_url(u, F.lit("HOST"))).alias("host"), F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")).alias("path"), F.try_url_decode(encoded).alias("decoded"))


@R.add("rm16_candidates", "with f as (select url from source_registry where url not in (select url from feed_stats where success and url is not null)) select url from f union all select url from source_registry where not exists (select 1 from f)")
def _(t):
    recent = t("feed_stats").where("success and url is not null").select("url")
    return chosen_portfolios(t("source_registry").select("url"), recent, "url", 2**31 - 1)


@R.add("sm06_steered_threshold", "with recursive d as (select row_number() over (order by day) i, day, xs from (select epoch_us(ran_at) // 86400000000 as day, list(job_count) xs from feed_stats where ran_at is not null and job_count is not null group by 1)), r as (select 0::bigint i, null::bigint as day, 50 as threshold union all select d.i, d.day, case when len(list_filter(xs, lambda x: x >= threshold)) > 8 then least(70, threshold + 2) when len(list_filter(xs, lambda x: x >= threshold)) < 1 then greatest(30, threshold - 2) else threshold end from r join d on d.i = r.i + 1) select day, threshold from r where i > 0")
def _(t):
    rows = t("feed_stats").where("ran_at is not null and job_count is not null").select(day("ran_at").alias("day"), F.col("job_count").alias("x"))
    return steered(rows, "day", "x", start=50)
