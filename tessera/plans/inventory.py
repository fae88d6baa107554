"""The rest of the inventory: sinks, filters, unions, rollups and small text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import merge, series
from ..operators.dedup import first_wins
from ..sources import feeds
from .registry import Registry
from .texts import _units

R = Registry()
QUERIES, SQL = R.queries, R.sql
day = lambda c: F.floor(F.unix_micros(F.col(c)) / 86_400_000_000)


@R.add("snk03_fill_changes", "with c as (select url, count(*) n, max(job_count) jobs from feed_stats where url is not null and success group by url) select coalesce(r.url, c.url) url, coalesce(c.jobs, r.last_job_count) last_job_count, coalesce(c.n, r.success_count) success_count from source_registry r full join c on r.url = c.url")
def _(t):
    c = t("feed_stats").where("url is not null and success").groupBy("url").agg(F.max("job_count").alias("last_job_count"), F.count("*").alias("success_count"))
    return merge.fill_changes(t("source_registry").select("url", "last_job_count", "success_count"), c, "url")


@R.add("snk06_conditional_overwrite", "select r.url, case when f.url is not null and r.state is distinct from 'active' then 'active' else r.state end state from source_registry r left join (select distinct url from feed_stats where success) f on f.url = r.url")
def _(t):
    good = t("feed_stats").where("success").select("url", F.lit(True).alias("good")).distinct()
    state = F.when(F.col("good") & ~F.col("state").eqNullSafe("active"), "active").otherwise(F.col("state"))
    return t("source_registry").select("url", "state").join(good, "url", "left").select("url", state.alias("state"))


@R.add("snk12_shortened_reports", "select doc_id, case when length(text) > 290 then substr(text, 1, 270) || '…' else text end report from documents")
def _(t):
    return t("documents").select("doc_id", F.when(F.length("text") > 290, F.concat(F.substring("text", 1, 270), F.lit("…"))).otherwise(F.col("text")).alias("report"))


@R.add("flt07_skipped_hosts", "select url from source_registry where domain is null or (length(split_part(domain, '.', 1)) >= 4 and split_part(domain, '.', 1) not in ('jobs', 'mail', 'blog', 'www'))")
def _(t):
    label = F.split_part("domain", F.lit("."), F.lit(1))
    return t("source_registry").where(F.col("domain").isNull() | (F.length(label) >= 4) & ~label.isin("jobs", "mail", "blog", "www")).select("url")


@R.add("flt10_payload_kinds", "select case when regexp_matches(text, '(?i)<(rss|feed)[\\s>]') then 'feed' when regexp_matches(text, '^\\s*[\\[{]\\s*[\\[{\"]') then 'json' else 'other' end kind, count(*) n from documents where text is not null group by 1")
def _(t):
    kind = F.when(F.col("text").rlike(r"(?i)<(rss|feed)[\s>]"), "feed").when(F.col("text").rlike(r'^\s*[\[{]\s*[\[{"]'), "json").otherwise("other")
    return t("documents").where("text is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@R.add("jn10_beyond_cursor", "with r as (select sourceurl, id, row_id, row_number() over (partition by sourceurl order by row_id desc) n from raw_jobs where id is not null and sourceurl is not null), seen as (select distinct sourceurl, id from r where n > 20) select row_id from r where n <= 20 and not exists (select 1 from seen s where s.sourceurl = r.sourceurl and s.id = r.id)")
def _(t):
    r = t("raw_jobs").where("id is not null and sourceurl is not null").select("sourceurl", "id", "row_id")
    # The rank is limited in every task before rows of a source meet; what is older than the last of them is joined by keys.
    new = series.top_per_key(r, ["sourceurl"], 20, [F.desc("row_id")])
    cursor = new.groupBy("sourceurl").agg(F.min("row_id").alias("cursor"))
    ids = new.select("sourceurl", "id").distinct()
    seen = r.join(ids, ["sourceurl", "id"], "left_semi").join(cursor, "sourceurl").where("row_id < cursor").select("sourceurl", "id").distinct()
    return new.join(seen, ["sourceurl", "id"], "left_anti").select("row_id")


@R.add("jn12_unknown_sources", "select distinct sourceurl url from raw_jobs where sourceurl is not null and sourceurl not in (select url from source_registry where enabled)")
def _(t):
    known = t("source_registry").where("enabled").select("url")
    return t("raw_jobs").where("sourceurl is not null").select(F.col("sourceurl").alias("url")).distinct().join(known, "url", "left_anti")


@R.add("st01_union_all", "select kind, count(*) n from (select 'job' kind, sourceurl url from raw_jobs union all select 'stat', url from feed_stats union all select 'source', url from source_registry) group by kind")
def _(t):
    parts = [t("raw_jobs").select(F.lit("job").alias("kind"), F.col("sourceurl").alias("url")), t("feed_stats").select(F.lit("stat").alias("kind"), "url"), t("source_registry").select(F.lit("source").alias("kind"), "url")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"))


@R.add("st03_distinct_terms", "select distinct lower(c) term from (select unnest(categories) c from raw_jobs) where c is not null")
def _(t):
    return t("raw_jobs").select(F.explode(F.transform("categories", F.lower)).alias("term")).where("term is not null").distinct()


@R.add("dd12_seen_keys", "select substr(sha256(coalesce(title, '') || '|' || coalesce(company, '')), 1, 16) as key, min(row_id) row_id, count(*) n from raw_jobs group by 1")
def _(t):
    key = F.substring(F.sha2(F.concat(F.coalesce("title", F.lit("")), F.lit("|"), F.coalesce("company", F.lit(""))), 256), 1, 16)
    return t("raw_jobs").groupBy(key.alias("key")).agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))


@R.add("ag10_daily_rollup", "select epoch_us(ran_at) // 86400000000 as day, count(*) runs, coalesce(sum(job_count), 0)::bigint jobs, max(durationms) slowest, cast(count(*) filter (not success) as bigint) failures from feed_stats where ran_at is not null group by 1")
def _(t):
    return t("feed_stats").where("ran_at is not null").groupBy(day("ran_at").alias("day")).agg(F.count("*").alias("runs"), F.coalesce(F.sum("job_count"), F.lit(0)).alias("jobs"), F.max("durationms").alias("slowest"), F.count_if(~F.col("success")).alias("failures"))


@R.add("ag15_idf", "with n as (select count(*) n from raw_jobs), d as (select term, count(*) df from (select distinct row_id, unnest(categories) term from raw_jobs) where term is not null group by term) select term, round(ln((greatest(n, 1) + 1) / (df + 1)) + 1, 6) idf from d, n")
def _(t):
    n = t("raw_jobs").agg(F.count("*").alias("n"))
    d = t("raw_jobs").select(F.explode(F.array_distinct("categories")).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    return d.join(F.broadcast(n)).select("term", F.round(F.ln((F.greatest("n", F.lit(1)) + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


@R.add("ag22_overview", "select sourcetype, crawl_tier, grouping(sourcetype) + 2 * grouping(crawl_tier) as level, count(*) n, round(avg(priority_score), 6) priority from source_registry group by cube (sourcetype, crawl_tier)")
def _(t):
    level = (F.grouping("sourcetype").cast("long") + 2 * F.grouping("crawl_tier").cast("long")).alias("level")
    return t("source_registry").cube("sourcetype", "crawl_tier").agg(level, F.count("*").alias("n"), F.round(F.avg("priority_score"), 6).alias("priority"))


@R.add("wn01_last_200", "select sourcetype, round(avg(durationms), 6) mean, count(*) n from (select sourcetype, durationms, row_number() over (partition by sourcetype order by ran_at desc, stat_id desc) r from feed_stats) where r <= 200 group by sourcetype")
def _(t):
    top = series.top_per_key(t("feed_stats").select("sourcetype", "durationms", "ran_at", "stat_id"), ["sourcetype"], 200, [F.desc("ran_at"), F.desc("stat_id")])
    return top.groupBy("sourcetype").agg(F.round(F.avg("durationms"), 6).alias("mean"), F.count("*").alias("n"))


@R.add("so08_top_categories", "select category, n from (select c category, count(*) n from (select unnest(categories) c from raw_jobs) where c is not null group by c) order by n desc, category limit 8")
def _(t):
    return t("raw_jobs").select(F.explode("categories").alias("category")).where("category is not null").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(8)


@R.add("sx18_names_of_slugs", "select url, array_to_string(list_transform(list_filter(string_split(regexp_replace(split_part(domain, '.', 1), '[-_]+', ' ', 'g'), ' '), lambda p: p <> ''), lambda p: upper(p[1]) || p[2:]), ' ') as name from source_registry where domain is not null")
def _(t):
    return t("source_registry").where("domain is not null").select("url", text.name_of_slug(F.split_part("domain", F.lit("."), F.lit(1))).alias("name"))


@R.add("sx24_all_named_domains", "select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '(?:https?://(?:www\\.)?)?([a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.example)\\b', 1))) as domain from documents")
def _(t):
    return t("documents").select("doc_id", F.explode(text.named_domains(F.col("text"), 2**31 - 1)).alias("domain")).where("domain like '%.example'")


_hash31 = "list_reduce(list_prepend(0::bigint, list_transform({0}, lambda u: u::bigint)), lambda h, c: (h * 31 + c) & 4294967295)"


@R.add("sx30_hash31", f"select entity_id, lower(to_base(abs(case when h >= 2147483648 then h - 4294967296 else h end), 36)) hash from (select entity_id, {_hash31.format(_units.format('name'))} h from known_names)")
def _(t):
    return t("known_names").select("entity_id", text.times31(F.col("name")).alias("hash"))


@R.add("rm10_first_domains", "select domain, url from (select domain, url, row_number() over (partition by domain order by url) n from source_registry where domain is not null) where n = 1 order by url limit 50")
def _(t):
    one = first_wins(t("source_registry").where("domain is not null").select("domain", "url"), ["domain"], [F.col("url")])
    return one.orderBy("url").limit(50)


@R.add("rm21_valid_addresses", "select row_id, coalesce(regexp_matches(url, '^https?://[^/\\s]+'), false) valid from raw_jobs")
def _(t):
    return t("raw_jobs").select("row_id", F.coalesce(F.col("url").rlike(r"^https?://[^/\s]+"), F.lit(False)).alias("valid"))


@R.add("src35_feed_signals", "select doc_id, count(*) n from (select doc_id, unnest(regexp_extract_all(text, '(?s)<item[\\s>](.*?)</item>', 1)) b from documents where doc_kind = 'feed_xml') where contains(lower(b), 'senior') or contains(lower(b), 'lead') group by doc_id")
def _(t):
    items = feeds.feed_items(t("documents").where("doc_kind = 'feed_xml'"), "text", ["doc_id"])
    both = F.lower(F.concat_ws(" ", "title", "content", "link", "published"))
    return items.where(both.contains("senior") | both.contains("lead")).groupBy("doc_id").agg(F.count("*").alias("n"))


@R.add("q03_open_orders", "select o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by o_orderkey order by revenue desc, o_orderkey limit 10")
def _(t):
    c = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(c, "c_custkey", "left_semi")
    x = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")).join(o, "o_orderkey")
    return x.groupBy("o_orderkey").agg(F.round(F.sum("v"), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@R.add("q06_discount_sum", "select round(sum(l_extendedprice * l_discount), 2) revenue from lineitem where l_discount between 0.05 and 0.07 and l_quantity < 24")
def _(t):
    return t("lineitem").where("l_discount between 0.05D and 0.07D and l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))
