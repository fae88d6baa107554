"""Addresses and domains of firms in landed pages, lists and payloads, with native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, domain, host
from . import boards, feeds

#: Boards whose addresses pages name, with the firm (fixed values).
BOARD_LINKS = (
    r"boards\.greenhouse\.io/[a-z0-9_-]+", r"jobs\.lever\.co/[a-z0-9_-]+", r"jobs\.ashbyhq\.com/[a-z0-9_-]+", r"apply\.workable\.com/[a-z0-9_-]+",
    r"careers\.smartrecruiters\.com/[a-z0-9_-]+", r"[a-z0-9_-]+\.recruitee\.com", r"[a-z0-9_-]+\.teamtailor\.com", r"jobs\.breezy\.hr/[a-z0-9_-]+",
)
#: Links that count as postings, each kind by itself (fixed values).
JOB_HREFS = tuple(rf"(?i)href\s*=\s*[\"'][^\"']*{x}" for x in (r"/jobs?/", r"/careers?/", r"/positions?/", r"/openings?/", r"/apply/", r"job[_-]?id"))
LD_POSTING = r"(?i)[\"']@type[\"']\s*:\s*[\"']JobPosting[\"']"
#: Mail hosts that say nothing of a firm (fixed values).
FREE_MAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "protonmail.com", "users.noreply.github.com")


def board_links(html: Column) -> Column:
    """The distinct addresses of known boards that a page names, board by board."""
    found = [F.regexp_extract_all(html, F.lit(f"(?i)({p})"), F.lit(1)) for p in BOARD_LINKS]
    return F.array_distinct(F.transform(F.flatten(F.array(*found)), lambda x: F.concat(F.lit("https://"), x)))


def job_link_count(html: Column) -> Column:
    """Links to postings; one that is of several kinds counts for each."""
    return reduce(lambda a, b: a + b, [F.regexp_count(html, F.lit(p)) for p in JOB_HREFS])


def posting_count(html: Column) -> Column:
    """Postings in structured data, by their marks."""
    return F.regexp_count(html, F.lit(LD_POSTING))


def outside_links(df: DataFrame, html: str, keep: list[str], skip: list[str] | tuple[str, ...] = (), own: str | None = None) -> DataFrame:
    """keep, url, domain: the distinct absolute links of pages to other domains than those of `skip` and of the page's own
    host (column `own`, if any). Null pages and links without a host give no rows."""
    hrefs = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(r"(?i)href\s*=\s*[\"'](https?://[^\"'<>\s]+)[\"']"), F.lit(1)))
    x = df.select(*keep, *([F.col(own).alias("_own")] if own else []), F.explode(hrefs).alias("url")).withColumn("domain", domain(F.col("url")))
    x = x.where(F.col("domain").isNotNull() & (F.col("domain") != "") & ~F.col("domain").isin(*skip) if skip else F.col("domain").isNotNull() & (F.col("domain") != ""))
    if own:
        d, o = F.col("domain"), F.regexp_replace(F.lower("_own"), r"^www\.", "")
        x = x.where(o.isNull() | ~((d == o) | d.endswith(F.concat(F.lit("."), o))))
    return x.select(*keep, "url", "domain")


def listed_domains(df: DataFrame, text: str, keep: list[str], endings: tuple[str, ...], words: tuple[str, ...]) -> DataFrame:
    """keep, domain: names of a list, one on a line, that have one of the endings or contain one of the words; comments
    (after #) and lines without a dot are skipped."""
    line = df.select(*keep, F.explode(F.split(F.col(text), r"\r?\n")).alias("line"))
    name = line.select(*keep, F.lower(F.trim(F.regexp_replace("line", "#.*", ""))).alias("domain")).where(F.col("domain").rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"))
    good = reduce(lambda a, b: a | b, [*(F.col("domain").endswith(e) for e in endings), *(F.col("domain").contains(w) for w in words)])
    return name.where(good).distinct()


def package_domains(df: DataFrame, payload: str, keep: list[str], roots: tuple[str, ...], links: tuple[str, ...], mails: tuple[str, ...], skip: tuple[str, ...] = ()) -> DataFrame:
    """keep, domain: distinct domains of an index's payload, from the addresses at `links` and the mail addresses at
    `mails` of each entry (free mail hosts and those of `skip` left out); what is no JSON gives no rows."""
    v = df.select(*keep, F.try_parse_json(F.col(payload)).alias("v")).where("v is not null")
    lists = [F.expr(f"try_variant_get(v, '{r}', 'array<variant>')") for r in roots]
    each = v.select(*keep, F.explode(F.coalesce(*lists, F.expr("array(v)"))).alias("j"))
    get = lambda p: blank_to_null(F.expr(f"try_variant_get(j, '$.{p}', 'string')"))
    hosts = [domain(get(p)) for p in links] + [F.lower(F.substring_index(get(p), "@", -1)) for p in mails]
    named = each.select(*keep, F.explode(F.array_compact(F.array(*hosts))).alias("domain"))
    return named.where((F.col("domain") != "") & F.col("domain").contains(".") & ~F.col("domain").isin(*FREE_MAIL, *skip)).distinct()


def guessed_domain(name: Column) -> Column:
    """The first two words of a firm's name and .com; null under three letters."""
    words = F.filter(F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: w != "")
    slug = F.array_join(F.slice(words, 1, 2), "")
    return F.when(F.length(slug) >= 3, F.concat(slug, F.lit(".com")))


def filing_domains(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """keep, name, form, domain: the firms of a filings search's payload and the domains guessed for them."""
    schema = "hits struct<hits: array<struct<_source: struct<entity_name: string, display_names: array<string>, form_type: string>>>>"
    hits = df.select(*keep, F.explode(F.from_json(F.col(payload), schema)["hits"]["hits"]).alias("h")).select(*keep, "h._source.*")
    named = hits.select(*keep, F.coalesce(blank_to_null(F.col("entity_name")), F.try_element_at("display_names", F.lit(1))).alias("name"), F.col("form_type").alias("form"))
    return named.withColumn("domain", guessed_domain(F.col("name"))).where("domain is not null")


def result_links(df: DataFrame, text: str, keep: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """keep, url: distinct results of a search, from its JSON (items with a link) or else its page."""
    items = F.from_json(F.col(text), "items array<struct<link: string>>")["items"]["link"]
    page = F.regexp_extract_all(F.col(text), F.lit(r"(?i)<a[^>]+href\s*=\s*[\"'](https?://[^\"'<>\s]+)[\"']"), F.lit(1))
    found = df.select(*keep, F.explode(F.array_distinct(F.coalesce(F.filter(items, lambda x: x.isNotNull()), page))).alias("url"))
    d = domain(F.col("url"))
    return found.where(~d.isin(*skip) if skip else d.isNotNull())


def page_postings(df: DataFrame, html: str, keep: list[str], base: str | None = None) -> DataFrame:
    """keep, title, url, content, location: postings of a page from its structured data; of pages without any, the links to
    postings with their text as title."""
    own = feeds.structured_postings(df, html, keep)
    none = F.lit(None).cast("string")
    found = own.select(*keep, "title", "url", "content", "location")
    links = feeds.job_links(df.where(posting_count(F.col(html)) == 0), html, keep, base)
    return found.unionByName(links.select(*keep, F.col("label").alias("title"), "url", none.alias("content"), none.alias("location")))


def dispatched(df: DataFrame, kind: str, payload: str, keep: list[str]) -> DataFrame:
    """Records of payloads of several kinds, each by its own reader, together with their kind; unknown kinds give no rows."""
    parts = []
    for name in boards.BOARDS:
        rows = boards.board_records(df.where(F.col(kind) == name), payload, name, keep)
        parts.append(rows.select(F.lit(name).alias("kind"), *keep, "position", "id", "title", "link", "company"))
    items = feeds.feed_items(df.where(F.col(kind) == "rss"), payload, keep)
    parts.append(items.select(F.lit("rss").alias("kind"), *keep, "position", F.col("guid").alias("id"), "title", "link", F.col("creator").alias("company")))
    return reduce(DataFrame.unionByName, parts)


def valid_sources(df: DataFrame, kind: str, url: str, name: str) -> DataFrame:
    """Rows with an address of http or https with a host, a kind and a name."""
    return df.where(F.col(url).rlike(r"^https?://[^/\s]+") & (host(F.col(url)) != "") & (F.trim(kind) != "") & (F.trim(name) != ""))


def chosen_portfolios(all_: DataFrame, recent: DataFrame, key: str, n: int = 2, seed: int = 0) -> DataFrame:
    """n rows of those not crawled recently, of all if there are none such, by a hash of key and seed."""
    fresh = all_.join(recent.select(key).distinct(), key, "left_anti").withColumn("_rank", F.lit(0))
    rest = all_.withColumn("_rank", F.lit(1))
    both = fresh.unionByName(rest).groupBy(*all_.columns).agg(F.min("_rank").alias("_rank"))
    best = both.orderBy("_rank", F.xxhash64(key, F.lit(seed)), key).limit(n)
    top = best.agg(F.min("_rank").alias("_best"))  # one row
    return best.join(F.broadcast(top), F.col("_rank") == F.col("_best")).drop("_rank", "_best")
