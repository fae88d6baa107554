"""Joins, sets, aggregates, ranks and series over the tables of postings and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import clamp, domain, round_half_up
from ..operators import merge, series
from ..operators.dedup import first_wins, insert_or_ignore, layered_dedup
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql
us = lambda c: F.unix_micros(F.col(c))
day = lambda c: F.floor(F.unix_micros(F.col(c)) / 86_400_000_000)

# -- joins and sets ------------------------------------------------------------------------------------------------------


@R.add("jn01_profiles_users", "select profile_id, p.user_id, name, plan_name, email from profiles p join users u on p.user_id = u.user_id")
def _(t):
    return t("profiles").join(t("users").select("user_id", "plan_name", "email"), "user_id").select("profile_id", "user_id", "name", "plan_name", "email")


@R.add("jn02_hosts_without_source", "select host, count(*) n from (select regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') host from raw_jobs where url is not null) where host <> '' and host not in (select domain from source_registry where domain is not null) group by host")
def _(t):
    known = t("source_registry").where("domain is not null").select(F.col("domain").alias("host")).distinct()
    seen = t("raw_jobs").select(domain(F.col("url")).alias("host")).where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    return seen.join(known, "host", "left_anti")


@R.add("jn03_alerts_with_job_and_profile", "select job_id, profile_id, count(*) n from sent_alerts s where exists (select 1 from raw_jobs r where r.id = s.job_id) and exists (select 1 from profiles p where p.profile_id = s.profile_id) group by all")
def _(t):
    jobs = t("raw_jobs").select(F.col("id").alias("job_id")).distinct()
    return t("sent_alerts").join(jobs, "job_id", "left_semi").join(t("profiles"), "profile_id", "left_semi").groupBy("job_id", "profile_id").agg(F.count("*").alias("n"))


@R.add("jn04_alerts_of_jobs", "select j.id, count(s.profile_id) n_alerts, count(distinct s.profile_id) n_profiles from (select distinct id from raw_jobs where sourcetype = 'email' and id is not null) j left join sent_alerts s on s.job_id = j.id group by j.id")
def _(t):
    jobs = t("raw_jobs").where("sourcetype = 'email' and id is not null").select("id").distinct()
    return jobs.join(t("sent_alerts").withColumnRenamed("job_id", "id"), "id", "left").groupBy("id").agg(F.count("profile_id").alias("n_alerts"), F.countDistinct("profile_id").alias("n_profiles"))


@R.add("jn06_not_yet_alerted", "select distinct s.job_id, q.profile_id from sent_alerts s join profiles p on s.profile_id = p.profile_id join profiles q on p.user_id = q.user_id where not exists (select 1 from sent_alerts x where x.job_id = s.job_id and x.profile_id = q.profile_id)")
def _(t):
    p = t("profiles")
    same_user = p.select("profile_id", "user_id").join(p.select(F.col("profile_id").alias("other"), "user_id"), "user_id").select("profile_id", "other")
    sent = t("sent_alerts").select("job_id", "profile_id").distinct()
    wanted = sent.join(same_user, "profile_id").select("job_id", F.col("other").alias("profile_id")).distinct()
    return wanted.join(sent, ["job_id", "profile_id"], "left_anti")


@R.add("jn07_health_with_defaults", "select r.url, coalesce(f.attempts, 0) attempts, coalesce(f.failures, 0) failures, coalesce(f.failures, 0) >= 5 suspect from source_registry r left join (select url, count(*) attempts, cast(count(*) filter (not success) as bigint) failures from feed_stats group by url) f on f.url = r.url")
def _(t):
    f = t("feed_stats").groupBy("url").agg(F.count("*").alias("attempts"), F.count_if(~F.col("success")).alias("failures"))
    return t("source_registry").select("url").join(f, "url", "left").na.fill(0, ["attempts", "failures"]).withColumn("suspect", F.col("failures") >= 5)


@R.add("jn08_sources_without_jobs", "select url, name from source_registry where url not in (select sourceurl from raw_jobs where sourceurl is not null)")
def _(t):
    return t("source_registry").select("url", "name").join(t("raw_jobs").select(F.col("sourceurl").alias("url")).where("url is not null").distinct(), "url", "left_anti")


@R.add("jn09_priority_merge", "select coalesce(r.url, f.url) url, round(case when r.url is null then 60 when f.url is null then r.priority_score else least(100, r.priority_score + 10) end, 6) priority from (select url, priority_score from source_registry where enabled) r full join (select distinct url from feed_stats where url is not null and success) f on r.url = f.url")
def _(t):
    f = t("feed_stats").where("url is not null and success").select("url", F.lit(True).alias("seen")).distinct()
    r = t("source_registry").where("enabled").select("url", "priority_score", F.lit(True).alias("known"))
    p = F.when(F.col("known").isNull(), 60.0).when(F.col("seen").isNull(), F.col("priority_score")).otherwise(F.least(F.lit(100.0), F.col("priority_score") + 10))
    return r.join(f, "url", "full").select("url", F.round(p, 6).alias("priority"))


@R.add("st02_union_first_wins", "select url, origin from (select url, origin, row_number() over (partition by url order by o) n from (select url, 'registry' origin, 1 o from source_registry where enabled union all select url, 'stats', 2 from (select distinct url from feed_stats where url is not null) union all select sourceurl, 'jobs', 3 from (select distinct sourceurl from raw_jobs where sourceurl is not null))) where n = 1")
def _(t):
    parts = [t("source_registry").where("enabled").select("url", F.lit("registry").alias("origin"), F.lit(1).alias("o")), t("feed_stats").where("url is not null").select("url").distinct().select("url", F.lit("stats").alias("origin"), F.lit(2).alias("o")), t("raw_jobs").where("sourceurl is not null").select(F.col("sourceurl").alias("url")).distinct().select("url", F.lit("jobs").alias("origin"), F.lit(3).alias("o"))]
    return first_wins(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["url"], [F.col("o")]).drop("o")


# -- duplicates --------------------------------------------------------------------------------------------------------


@R.add("dd02_batch_first", "select row_id from (select row_id, row_number() over (partition by coalesce(nullif(content_hash, ''), concat(coalesce(title, ''), '::', coalesce(company, ''))) order by row_id) n from raw_jobs) where n = 1")
def _(t):
    key = F.coalesce(F.when(F.col("content_hash") != "", F.col("content_hash")), F.concat(F.coalesce("title", F.lit("")), F.lit("::"), F.coalesce("company", F.lit(""))))
    return first_wins(t("raw_jobs").select("row_id", key.alias("key")), ["key"], [F.col("row_id")]).select("row_id")


@R.add("dd01_layered", """with recursive x as (select row_number() over (order by row_id) n, row_id, coalesce(nullif(id, ''), '') a, coalesce(nullif(content_hash, ''), '') c from raw_jobs),
f as (select 0::bigint n, []::varchar[] ids, []::varchar[] hashes, null::bigint row_id, null::varchar dropped_by
  union all select x.n, case when why is null and a <> '' then list_append(ids, a) else ids end, case when why is null and c <> '' then list_append(hashes, c) else hashes end, x.row_id, why
  from (select x.*, f.ids, f.hashes, case when a <> '' and list_contains(f.ids, a) then 'identity' when c <> '' and list_contains(f.hashes, c) then 'content' end why from f join x on x.n = f.n + 1) x)
select row_id, dropped_by from f where n > 0""")
def _(t):
    out = layered_dedup(t("raw_jobs").select("row_id", F.when(F.col("id") != "", F.col("id")).alias("identity"), F.when(F.col("content_hash") != "", F.col("content_hash")).alias("content")), ["identity", "content"], "row_id")
    return out.select("row_id", "dropped_by")


@R.add("dd11_seen_before", "select row_id, case when url_seen then 'url' when content_seen then 'content' end reason from (select row_id, url is not null and exists (select 1 from raw_jobs x where x.url = r.url and x.row_id < r.row_id) url_seen, content_hash is not null and exists (select 1 from raw_jobs x where x.content_hash = r.content_hash and x.row_id < r.row_id) content_seen from raw_jobs r) where url_seen or content_seen")
def _(t):
    jobs = t("raw_jobs").select("row_id", "url", "content_hash")
    # The first row of each key is found by partial aggregation and joined back, which adaptive execution can split; only
    # keys of several rows are joined.
    first = lambda k: jobs.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("row_id").alias(f"first_{k}"), F.count("*").alias("n")).where("n > 1").drop("n")
    x = jobs.join(first("url"), "url", "left").join(first("content_hash"), "content_hash", "left").where("first_url < row_id or first_content_hash < row_id")
    return x.select("row_id", F.when(F.col("first_url") < F.col("row_id"), "url").otherwise("content").alias("reason"))


# -- aggregates --------------------------------------------------------------------------------------------------------


@R.add("ag01_metrics_by_type", "select sourcetype, count(*) n, cast(sum(success_count) as bigint) successes, cast(sum(failure_count) as bigint) failures, cast(sum(last_job_count) as bigint) jobs, cast(sum(case when enabled then 1 else 0 end) as bigint) enabled from source_registry group by sourcetype")
def _(t):
    return t("source_registry").groupBy("sourcetype").agg(F.count("*").alias("n"), F.sum("success_count").alias("successes"), F.sum("failure_count").alias("failures"), F.sum("last_job_count").alias("jobs"), F.count_if("enabled").alias("enabled"))


@R.add("ag02_tiers", "select crawl_tier, count(*) n, round(avg(priority_score), 6) avg_priority from source_registry where enabled group by crawl_tier")
def _(t):
    return t("source_registry").where("enabled").groupBy("crawl_tier").agg(F.count("*").alias("n"), F.round(F.avg("priority_score"), 6).alias("avg_priority"))


@R.add("ag03_totals", "select count(*) total, cast(count(*) filter (enabled and state = 'active') as bigint) active, cast(count(*) filter (not enabled) as bigint) disabled from source_registry")
def _(t):
    return t("source_registry").agg(F.count("*").alias("total"), F.count_if(F.expr("enabled and state = 'active'")).alias("active"), F.count_if(~F.col("enabled")).alias("disabled"))


@R.add("ag04_jobs_a_day", "with d as (select epoch_us(fetched_at) // 86400000000 as day, count(*) n, count(distinct nullif(company, '')) companies from raw_jobs where fetched_at is not null group by 1) select a.day, a.n, a.companies, coalesce(b.n, 0) n_before from d a left join d b on b.day = a.day - 1")
def _(t):
    d = t("raw_jobs").where("fetched_at is not null").groupBy(day("fetched_at").alias("day")).agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("company") != "", F.col("company"))).alias("companies"))
    b = d.select((F.col("day") + 1).alias("day"), F.col("n").alias("n_before"))
    return d.join(b, "day", "left").select("day", "n", "companies", F.coalesce("n_before", F.lit(0)).alias("n_before"))


@R.add("ag06_hiring_surge", "select company, count(*) n, epoch_us(max(fetched_at)) last_us from raw_jobs where company <> '' and fetched_at >= (select max(fetched_at) from raw_jobs) - interval 90 day group by company having count(*) >= 5 order by n desc, company limit 50")
def _(t):
    jobs = t("raw_jobs").select("company", "fetched_at").where("company <> ''")
    since = t("raw_jobs").agg((F.max("fetched_at") - F.expr("interval 90 days")).alias("since"))
    return jobs.join(F.broadcast(since), F.col("fetched_at") >= F.col("since")).groupBy("company").agg(F.count("*").alias("n"), F.unix_micros(F.max("fetched_at")).alias("last_us")).where("n >= 5").orderBy(F.desc("n"), "company").limit(50)


@R.add("ag07_category_spikes", "with x as (select c, epoch_us(fetched_at) // 86400000000 as d from (select unnest(categories) c, fetched_at from raw_jobs)), m as (select max(d) m from x), s as (select c, cast(count(*) filter (m - d <= 180) as bigint) now_n, cast(count(*) filter (m - d > 180 and m - d <= 360) as bigint) before_n from x, m group by c) select c category, now_n, before_n, round(case when before_n = 0 then 100 else (now_n - before_n) * 100.0 / before_n end, 6) growth from s where now_n > 0 and ((before_n > 0 and (now_n - before_n) * 100.0 / before_n >= 20) or (before_n = 0 and now_n >= 5))")
def _(t):
    x = t("raw_jobs").select(F.explode("categories").alias("category"), day("fetched_at").alias("d"))
    last = t("raw_jobs").where(F.size("categories") > 0).agg(F.max(day("fetched_at")).alias("m"))
    age = F.col("m") - F.col("d")
    s = x.join(F.broadcast(last)).groupBy("category").agg(F.count_if(age <= 180).alias("now_n"), F.count_if((age > 180) & (age <= 360)).alias("before_n"))
    growth = F.when(F.col("before_n") == 0, 100.0).otherwise((F.col("now_n") - F.col("before_n")) * 100.0 / F.nullif("before_n", F.lit(0)))
    return s.withColumn("growth", F.round(growth, 6)).where("now_n > 0 and ((before_n > 0 and growth >= 20) or (before_n = 0 and now_n >= 5))")


@R.add("ag08_signals", "select sourcetype, count(*) n, cast(count(*) filter (list_contains(categories, 'Remote')) as bigint) remote, cast(count(*) filter (list_contains(categories, 'Hybrid')) as bigint) hybrid, cast(count(*) filter (list_contains(categories, 'Onsite')) as bigint) onsite, cast(coalesce(sum(length(content)), 0) as bigint) characters from raw_jobs group by sourcetype")
def _(t):
    has = lambda c: F.count_if(F.array_contains("categories", c))
    return t("raw_jobs").groupBy("sourcetype").agg(F.count("*").alias("n"), has("Remote").alias("remote"), has("Hybrid").alias("hybrid"), has("Onsite").alias("onsite"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("characters"))


@R.add("ag09_daily_maps", "select day, category, sum(n)::bigint n from (select epoch_us(fetched_at) // 86400000000 as day, unnest(categories) category, 1 n from raw_jobs where fetched_at is not null) group by all")
def _(t):
    counts = t("raw_jobs").where("fetched_at is not null").select(day("fetched_at").alias("day"), F.explode("categories").alias("category")).groupBy("day", "category").agg(F.count("*").alias("n"))
    maps = counts.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("by_category"))  # a map of the few categories
    return maps.select("day", F.explode("by_category").alias("category", "n"))


@R.add("ag12_histogram", "select cast(floor(least(99, greatest(0, priority_score)) / 10) * 10 as bigint) bucket, count(*) n from source_registry where priority_score is not null group by 1")
def _(t):
    bucket = (F.floor(clamp(F.col("priority_score"), 0.0, 99.0) / 10) * 10).alias("bucket")
    return t("source_registry").where("priority_score is not null").groupBy(bucket).agg(F.count("*").alias("n"))


@R.add("ag13_window_statistics", "with r as (select sourcetype, durationms, row_number() over (partition by sourcetype order by ran_at desc, stat_id desc) k from feed_stats where durationms is not null), s as (select sourcetype, durationms, row_number() over (partition by sourcetype order by durationms, k) - 1 i, count(*) over (partition by sourcetype) n from r where k <= 200) select sourcetype, count(*) n, cast(floor(avg(durationms) + 0.5) as bigint) mean, max(durationms) filter (i = floor(n * 0.75)) p75, max(durationms) filter (i = floor(n * 0.9)) p90 from s group by sourcetype")
def _(t):
    return series.ranked_statistics(t("feed_stats").where("durationms is not null"), ["sourcetype"], "durationms", 200, [F.desc("ran_at"), F.desc("stat_id")])


@R.add("ag14_document_frequency", "select term, count(*) df from (select distinct row_id, unnest(list_distinct(list_transform(categories, lambda x: lower(x)))) term from raw_jobs) where term is not null group by term")
def _(t):
    return t("raw_jobs").select(F.explode(F.array_distinct(F.transform("categories", F.lower))).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


@R.add("ag16_repeat_share", "select sourceurl, count(*) total, count(distinct id) fresh, round(least(1, greatest(0, 1 - count(distinct id) / count(*))), 6) repeats from raw_jobs where sourceurl is not null group by sourceurl")
def _(t):
    # Distinct ids are counted in two steps, so that a hot source is spread over its ids.
    per_id = t("raw_jobs").where("sourceurl is not null").groupBy("sourceurl", "id").agg(F.count("*").alias("n"))
    g = per_id.groupBy("sourceurl").agg(F.sum("n").alias("total"), F.count("id").alias("fresh"))
    return g.withColumn("repeats", F.round(clamp(1 - F.col("fresh") / F.col("total"), 0.0, 1.0), 6))


@R.add("ag18_feed_health", "select url, count(*) attempts, cast(count(*) filter (success) as bigint) successes, cast(floor(count(*) filter (success) * 100.0 / count(*) + 0.5) as bigint) success_pct, cast(floor(avg(durationms) + 0.5) as bigint) latency from feed_stats where url is not null group by url")
def _(t):
    g = t("feed_stats").where("url is not null").groupBy("url").agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"), F.avg("durationms").alias("l"))
    return g.select("url", "attempts", "successes", round_half_up(F.col("successes") * 100.0 / F.col("attempts")).alias("success_pct"), round_half_up(F.col("l")).alias("latency"))


@R.add("ag19_calibration", "with x as (select value from events where event_type = 'purchase' and ts >= (select max(ts) from events) - interval 7 day) select case when count(*) >= 5 then round(greatest(0.4, avg(value) / 100 - 0.15), 6) else 0.55 end threshold, count(*) n from x")
def _(t):
    e = t("events")
    since = e.agg((F.max("ts") - F.expr("interval 7 days")).alias("since"))
    x = e.where("event_type = 'purchase'").join(F.broadcast(since), F.col("ts") >= F.col("since")).agg(F.avg("value").alias("a"), F.count("*").alias("n"))
    return x.select(F.when(F.col("n") >= 5, F.round(F.greatest(F.lit(0.4), F.col("a") / 100 - 0.15), 6)).otherwise(0.55).alias("threshold"), "n")


@R.add("ag20_preference_weights", "select token, sum(case event_type when 'error' then -1 when 'view' then 0 else 1 end)::bigint weight from (select event_type, unnest(['type:' || event_type, 'user:' || user_id]) token from events) group by token")
def _(t):
    w = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "view", 0).otherwise(1)
    tokens = F.explode(F.array(F.concat(F.lit("type:"), "event_type"), F.concat(F.lit("user:"), F.col("user_id").cast("string"))))
    return t("events").select(w.alias("w"), tokens.alias("token")).groupBy("token").agg(F.sum("w").alias("weight"))


@R.add("ag21_weighted_average", "select round(sum(n * a) / sum(n), 6) avg_priority, sum(n)::bigint n from (select crawl_tier, count(*) n, avg(priority_score) a from source_registry where enabled group by crawl_tier)")
def _(t):
    g = t("source_registry").where("enabled").groupBy("crawl_tier").agg(F.count("*").alias("n"), F.avg("priority_score").alias("a"))
    return g.agg(F.round(F.sum(F.col("n") * F.col("a")) / F.sum("n"), 6).alias("avg_priority"), F.sum("n").alias("n"))


# -- ranks and series --------------------------------------------------------------------------------------------------


@R.add("wn02_latest_interactions", "select user_id, event_id, event_type from (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n <= 20")
def _(t):
    return series.top_per_key(t("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], 20, [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@R.add("wn03_failure_runs", "with x as (select url, stat_id, ran_at, coalesce(success, false) ok from feed_stats where url is not null), i as (select *, sum(ok::int) over (partition by url order by ran_at, stat_id rows unbounded preceding) g from x) select stat_id, sum(1 - ok::int) over (partition by url, g order by ran_at, stat_id rows unbounded preceding)::bigint run from i")
def _(t):
    return series.failure_runs(t("feed_stats").where("url is not null"), ["url"], [F.col("ran_at"), F.col("stat_id")], F.col("success")).select("stat_id", "run")


@R.add("wn04_ema", "with x as (select url, job_count v, row_number() over (partition by url order by ran_at desc, stat_id desc) - 1 k from feed_stats where url is not null and job_count is not null) select url, round(sum(0.3 * pow(0.7, k) * v), 6) ema, count(*) n from x group by url")
def _(t):
    return series.ema(t("feed_stats").where("url is not null"), ["url"], ["ran_at", "stat_id"], "job_count", 0.7).select("url", F.round("ema", 6).alias("ema"), "n")


@R.add("wn05_day_over_day", "with d as (select epoch_us(ran_at) // 86400000000 as day, sum(job_count)::bigint jobs from feed_stats where ran_at is not null group by 1) select day, jobs, case when lag(jobs) over (order by day) > 0 then round((jobs - lag(jobs) over (order by day)) * 100.0 / lag(jobs) over (order by day), 4) end pct from d")
def _(t):
    d = t("feed_stats").where("ran_at is not null").groupBy(day("ran_at").alias("day")).agg(F.sum("job_count").alias("jobs"))
    before = F.lag("jobs").over(Window.orderBy("day"))  # one row a day
    return d.select("day", "jobs", F.when(before > 0, F.round((F.col("jobs") - before) * 100.0 / before, 4)).alias("pct"))


@R.add("so01_top_k", "select url, priority_score from source_registry where priority_score is not null order by priority_score desc, url limit 5")
def _(t):
    return t("source_registry").where("priority_score is not null").select("url", "priority_score").orderBy(F.desc("priority_score"), "url").limit(5)


@R.add("so02_top_per_type", "select sourcetype, url, rank from (select sourcetype, url, row_number() over (partition by sourcetype order by priority_score desc nulls last, url) as rank from source_registry) where rank <= 5")
def _(t):
    return series.top_per_key(t("source_registry").select("sourcetype", "url", "priority_score"), ["sourcetype"], 5, [F.col("priority_score").desc_nulls_last(), F.col("url")]).drop("priority_score").withColumn("rank", F.col("rank").cast("long"))


@R.add("so04_batches", "select url, cast(floor((n - 1) / ceil(least(40, c) / 3.0)) as bigint) batch from (select url, row_number() over (order by priority_score desc nulls last, url) n, count(*) over () c from source_registry where enabled) where n <= 40")
def _(t):
    top = t("source_registry").where("enabled").select("url", "priority_score").orderBy(F.col("priority_score").desc_nulls_last(), "url").limit(40)
    w = Window.orderBy(F.col("priority_score").desc_nulls_last(), "url")  # of 40 rows
    n, c = F.row_number().over(w), F.count("*").over(Window.partitionBy())
    return top.select("url", F.floor((n - 1) / F.ceil(c / 3.0)).alias("batch"))


@R.add("so05_top_failing", "select url, consecutive_failures, failure_count from source_registry order by consecutive_failures desc nulls last, failure_count desc nulls last, url limit 5")
def _(t):
    return t("source_registry").select("url", "consecutive_failures", "failure_count").orderBy(F.col("consecutive_failures").desc_nulls_last(), F.col("failure_count").desc_nulls_last(), "url").limit(5)


@R.add("so06_pending_first", "select url from source_registry where enabled order by case sourcetype when 'rss' then 0 when 'api' then 1 else 2 end, last_fetched_at asc nulls first, url limit 50")
def _(t):
    kind = F.when(F.col("sourcetype") == "rss", 0).when(F.col("sourcetype") == "api", 1).otherwise(2)
    return t("source_registry").where("enabled").orderBy(kind, F.col("last_fetched_at").asc_nulls_first(), "url").limit(50).select("url")


@R.add("so07_newest", "select url, epoch_us(created_at) created_us from source_registry where created_at >= (select max(created_at) from source_registry) - interval 72 hour order by created_at desc, url limit 5")
def _(t):
    s = t("source_registry")
    since = s.agg((F.max("created_at") - F.expr("interval 72 hours")).alias("since"))
    return s.join(F.broadcast(since), F.col("created_at") >= F.col("since")).orderBy(F.desc("created_at"), "url").limit(5).select("url", us("created_at").alias("created_us"))


@R.add("so09_random_subset", "select url from source_registry order by md5('7' || url), url limit 25")
def _(t):
    return t("source_registry").select("url").orderBy(F.md5(F.concat(F.lit("7"), "url")), "url").limit(25)


@R.add("so10_round_robin", "select name from (select name, row_number() over (order by name) - 1 i, count(*) over () c from source_registry) where ((i - 893) % c + c) % c < 40")
def _(t):
    w = Window.orderBy("name")  # a table of fixed size
    x = t("source_registry").select("name", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("c"))
    return x.where(F.pmod(F.col("i") - 893, F.col("c")) < 40).select("name")


# -- filters and projections -------------------------------------------------------------------------------------------


@R.add("flt05_eligible", "select url from source_registry where enabled and (state is null or state in ('active', 'cooldown')) and (crawl_tier is null or crawl_tier = 'high' or (crawl_tier = 'medium' and 24 % 3 = 0) or (crawl_tier = 'low' and 24 % 8 = 0) or (crawl_tier = 'dormant' and 24 % 16 = 0))")
def _(t):
    cycle, every = 24, {"high": 1, "medium": 3, "low": 8, "dormant": 16}
    due = [k for k, n in every.items() if cycle % n == 0]
    return t("source_registry").where(F.col("enabled") & (F.col("state").isNull() | F.col("state").isin("active", "cooldown")) & (F.col("crawl_tier").isNull() | F.col("crawl_tier").isin(due))).select("url")


@R.add("flt06_source_cap", "select row_id from (select row_id, row_number() over (partition by sourceurl order by row_id) n from raw_jobs) where n <= 50")
def _(t):
    return series.top_per_key(t("raw_jobs").select("row_id", "sourceurl"), ["sourceurl"], 50, [F.col("row_id")]).select("row_id")


@R.add("flt01_recent", "select row_id from raw_jobs where fetched_at >= (select max(fetched_at) from raw_jobs) - interval 24 hour")
def _(t):
    jobs = t("raw_jobs").select("row_id", "fetched_at")
    since = jobs.agg((F.max("fetched_at") - F.expr("interval 24 hours")).alias("since"))
    return jobs.join(F.broadcast(since), F.col("fetched_at") >= F.col("since")).select("row_id")


@R.add("flt08_signals", "select row_id, case when contains(lower(content), 'raised') then 'funding' when contains(lower(content), 'acqui') then 'merger' else 'hiring' end signal from raw_jobs where contains(lower(content), 'raised') or contains(lower(content), 'acqui') or contains(lower(content), 'growing team')")
def _(t):
    c = F.lower("content")
    kind = F.when(c.contains("raised"), "funding").when(c.contains("acqui"), "merger").when(c.contains("growing team"), "hiring")
    return t("raw_jobs").select("row_id", kind.alias("signal")).where("signal is not null")


@R.add("prj02_slim", "select row_id, id, url, title, company, substr(contentsnippet, 1, 300) snippet, sourcename, sourcetype from raw_jobs")
def _(t):
    return t("raw_jobs").select("row_id", "id", "url", "title", "company", F.substring("contentsnippet", 1, 300).alias("snippet"), "sourcename", "sourcetype")


# -- sinks -------------------------------------------------------------------------------------------------------------


@R.add("snk01_insert_or_ignore", "with h as (select max(row_id) // 2 m from raw_jobs), old as (select * from raw_jobs, h where row_id <= m), new as (select row_id, url, content_hash from raw_jobs, h where row_id > m), a as (select * from (select *, row_number() over (partition by url order by row_id) n from new) where url is null or (n = 1 and url not in (select url from old where url is not null))), b as (select * from (select row_id, content_hash, row_number() over (partition by content_hash order by row_id) n from a) where content_hash is null or (n = 1 and content_hash not in (select content_hash from old where content_hash is not null))) select row_id from b")
def _(t):
    jobs = t("raw_jobs").select("row_id", "url", "content_hash")
    half = F.broadcast(jobs.agg(F.floor(F.max("row_id") / 2).alias("m")))
    old, new = jobs.join(half, F.col("row_id") <= F.col("m")).drop("m"), jobs.join(half, F.col("row_id") > F.col("m")).drop("m")
    return insert_or_ignore(new, old, ["url", "content_hash"], "row_id").select("row_id")


@R.add("snk02_add_counts", "select coalesce(r.url, f.url) url, coalesce(r.success_count, 0) + coalesce(f.s, 0) success_count, coalesce(r.failure_count, 0) + coalesce(f.x, 0) failure_count from source_registry r full join (select url, count(*) filter (success)::bigint s, count(*) filter (not success)::bigint x from feed_stats where url is not null group by url) f on r.url = f.url")
def _(t):
    changes = t("feed_stats").where("url is not null").select("url", F.col("success").cast("long").alias("success_count"), (~F.col("success")).cast("long").alias("failure_count"))
    return merge.add_counts(t("source_registry"), changes, "url", ["success_count", "failure_count"])


@R.add("snk04_guarded_insert", "select distinct o_custkey, l_suppkey from orders join lineitem on o_orderkey = l_orderkey where exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 9000) and exists (select 1 from supplier where s_suppkey = l_suppkey and s_acctbal > 5000) and not exists (select 1 from nation where n_nationkey = o_custkey and n_nationkey = l_suppkey)")
def _(t):
    rows = t("orders").select("o_orderkey", "o_custkey").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey").select("o_custkey", "l_suppkey")
    done = t("nation").select(F.col("n_nationkey").cast("long").alias("o_custkey"), F.col("n_nationkey").cast("long").alias("l_suppkey"))
    return merge.guarded_insert(rows, done, ["o_custkey", "l_suppkey"], [(t("customer").where("c_acctbal > 9000"), {"o_custkey": "c_custkey"}), (t("supplier").where("s_acctbal > 5000"), {"l_suppkey": "s_suppkey"})])


@R.add("snk05_last_write", "select url, n from (select url, last_job_count n from source_registry where url not in (select url from feed_stats where url is not null) union all select url, job_count from (select url, job_count, row_number() over (partition by url order by ran_at desc nulls last, stat_id desc) k from feed_stats where url is not null) where k = 1)")
def _(t):
    changes = t("feed_stats").where("url is not null").select("url", F.col("job_count").alias("n"), F.struct("ran_at", "stat_id").alias("o"))
    return merge.last_write(t("source_registry").select("url", F.col("last_job_count").alias("n")), changes, "url", "o").select("url", "n")


@R.add("snk07_versions", "select stat_id, row_number() over w as version, lead(ran_at) over w is null as active from feed_stats where url is not null window w as (partition by url order by ran_at, stat_id)")
def _(t):
    x = t("feed_stats").where("url is not null").select("url", "stat_id", F.struct("ran_at", "stat_id").alias("o"))
    return merge.versions(x, "url", "o").select("stat_id", F.col("version").cast("long").alias("version"), "active")


@R.add("snk08_retention", "select row_id from raw_jobs where fetched_at >= (select max(fetched_at) from raw_jobs) - interval 30 day")
def _(t):
    jobs = t("raw_jobs").select("row_id", "fetched_at")
    since = jobs.agg((F.max("fetched_at") - F.expr("interval 30 days")).alias("since"))
    return jobs.join(F.broadcast(since), F.col("fetched_at") >= F.col("since")).select("row_id")


@R.add("snk09_evict", "select url from source_registry where url not in (select url from (select url, row_number() over (order by priority_score, last_fetched_at nulls first, url) n from source_registry where not enabled or priority_score < 20) where n <= greatest(0, (select count(*) from source_registry) - 700))")
def _(t):
    return merge.evict(t("source_registry"), 700, "not enabled or priority_score < 20", [F.col("priority_score"), F.col("last_fetched_at").asc_nulls_first(), F.col("url")]).select("url")


# -- facts of the other tables -----------------------------------------------------------------------------------------


@R.add("q01_pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def _(t):
    return t("lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n"))


@R.add("q05_volume_by_nation", "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey join nation on s_nationkey = n_nationkey group by n_name")
def _(t):
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
