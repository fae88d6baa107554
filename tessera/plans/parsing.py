"""Landed feeds, payloads and pages as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import boards, feeds
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("src01_feed_items", "with b as (select doc_id, unnest(regexp_extract_all(text, '(?s)<item[\\s>](.*?)</item>', 1)) b from documents where doc_kind = 'feed_xml') select doc_id, count(*) n, count(nullif(trim(regexp_extract(b, '(?s)<title[^>]*>(.*?)</title>', 1)), ''))::bigint titled, count(nullif(trim(regexp_extract(b, '(?s)<link[^>]*>(.*?)</link>', 1)), ''))::bigint linked from b group by doc_id")
def _(t):
    items = feeds.feed_items(t("documents").where("doc_kind = 'feed_xml'"), "text", ["doc_id"])
    return items.groupBy("doc_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("title") != "", 1)).alias("titled"), F.count("link").alias("linked"))


@R.add("src01_feed_links", "select doc_id, trim(link) link from (select doc_id, unnest(regexp_extract_all(text, '<link>([^<]*)</link>', 1)) link from documents where doc_kind = 'feed_xml')")
def _(t):
    return feeds.feed_items(t("documents").where("doc_kind = 'feed_xml'"), "text", ["doc_id"]).select("doc_id", "link")


@R.add("src05_high_watermark", "with x as (select sourceurl, row_id, fetched_at, max(fetched_at) over (partition by sourceurl) last from raw_jobs where sourceurl is not null) select row_id from x where fetched_at > last - interval 7 day")
def _(t):
    jobs = t("raw_jobs").where("sourceurl is not null").select("sourceurl", "row_id", "fetched_at")
    cursor = jobs.groupBy("sourceurl").agg((F.max("fetched_at") - F.expr("interval 7 days")).alias("cursor"))
    return jobs.join(cursor, "sourceurl").where("fetched_at > cursor").select("row_id")


@R.add("src26_json_lines", "with l as (select doc_id, unnest(range(0, len(ls))) line_no, unnest(ls) line from (select doc_id, list_transform(string_split_regex(text, '\\r?\\n'), lambda x: '[' || regexp_replace(x, '^\\s*\\[|\\]\\}?\\s*$|,\\s*$', '', 'g') || ']') ls from documents where doc_kind = 'api_payload')), o as (select doc_id, line_no, unnest(json_extract(line, '$[*]')) o from l where json_valid(line)) select doc_id, line_no::int line_no, try_cast(json_extract_string(o, '$.id') as bigint) id, json_extract_string(o, '$.title') title, try_cast(json_extract_string(o, '$.score') as double) score from o where json_extract_string(o, '$.id') is not null")
def _(t):
    rows = feeds.json_lines(t("documents").where("doc_kind = 'api_payload'"), "text", ["doc_id"], "id bigint, title string, score double")
    return rows.where("id is not null").select("doc_id", "line_no", "id", "title", "score")


@R.add("src06_board_records", "with w as (select doc_id, '[' || text || ']' j from documents where doc_kind = 'api_payload'), v as (select doc_id, case when json_array_length(j) = 1 and json_type(j, '$[0]') = 'ARRAY' then json_extract(j, '$[0]') when json_array_length(j) = 1 and json_type(j, '$[0].jobs') = 'ARRAY' then json_extract(j, '$[0].jobs') else j::json end j from w where json_valid(j)), o as (select doc_id, unnest(json_extract(j, '$[*]')) o, unnest(range(0, json_array_length(j)::bigint)) position from v) select doc_id, position::int as position, json_extract_string(o, '$.id') id, json_extract_string(o, '$.title') title, json_extract_string(o, '$.snippet') as content, list_concat(list_transform(coalesce(json_extract(o, '$.skills[*]'), []), lambda x: x->>'$'), case when json_extract_string(o, '$.remote') = 'true' then ['Remote'] else [] end) categories from o where json_extract_string(o, '$.title') is not null")
def _(t):
    return boards.board_records(t("documents").where("doc_kind = 'api_payload'"), "text", "plain", ["doc_id"]).select("doc_id", "position", "id", "title", "content", "categories")


@R.add("src23_source_list", "select url, first_name as name, nullif(regexp_extract(url, '^https?://(?:www\\.)?([^./]+)', 1), '') label from (select url, first(name order by name) first_name from source_registry where enabled group by url)")
def _(t):
    from ..functions.text import host_label

    s = t("source_registry").where("enabled").groupBy("url").agg(F.min("name").alias("name"))
    return s.select("url", "name", host_label(F.col("url")).alias("label"))


@R.add("src24_by_type", "select sourcetype, count(*) n, count(distinct domain) domains from source_registry where url like 'http%' group by sourcetype")
def _(t):
    return t("source_registry").where("url like 'http%'").groupBy("sourcetype").agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains"))


@R.add("src30_log_lines", "select level, count(*) n from (select regexp_extract(line, '^\\S+ \\[([A-Za-z]+)\\]', 1) as level from (select unnest(string_split_regex(text, '\\r?\\n')) line from documents where doc_kind = 'run_log')) where level <> '' group by level")
def _(t):
    line = t("documents").where("doc_kind = 'run_log'").select(F.explode(F.split("text", r"\r?\n")).alias("line"))
    return line.select(F.regexp_extract("line", r"^\S+ \[([A-Za-z]+)\]", 1).alias("level")).where("level <> ''").groupBy("level").agg(F.count("*").alias("n"))


@R.add("rep01_reports", "select doc_id, regexp_extract(text, '=== Run report (\\d+)', 1)::bigint run, nullif(regexp_extract(text, 'raw jobs\\s+(\\d+)', 1), '')::bigint raw_jobs from documents where doc_kind = 'daily_report' and regexp_matches(text, '=== Run report \\d+')")
def _(t):
    n = lambda p: F.when(F.regexp_extract("text", p, 1) != "", F.regexp_extract("text", p, 1)).cast("bigint")
    return t("documents").where("doc_kind = 'daily_report'").where(F.col("text").rlike(r"=== Run report \d+")).select("doc_id", n(r"=== Run report (\d+)").alias("run"), n(r"raw jobs\s+(\d+)").alias("raw_jobs"))
