"""Feeds, pages and listings that have landed as text, parsed to rows with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_domain, blank_to_null, decode_entities, domain, sanitize, strip_markup

#: Structured data of pages and the links that count as postings (fixed values).
LD_BLOCK = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
ANCHOR = r"(?is)<a\s[^>]*href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
JOB_PATH = r"(?i)/(?:jobs?|careers?|positions?|openings?|vacanc(?:y|ies)|opportunit(?:y|ies)|roles?|apply)/"


def tag_text(xml: Column, tag: str) -> Column:
    """The text of the first such tag, from CDATA if it has any; null without the tag or without text."""
    cdata = F.regexp_extract(xml, rf"(?is)<{tag}[^>]*>\s*<!\[CDATA\[(.*?)\]\]>\s*</{tag}>", 1)
    plain = F.regexp_extract(xml, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.coalesce(blank_to_null(F.trim(cdata)), blank_to_null(F.trim(plain)))


def all_tag_texts(xml: Column, tag: str) -> Column:
    raw = F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    bare = F.transform(raw, lambda x: F.trim(F.regexp_replace(x, r"(?is)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))
    return F.filter(bare, lambda x: x != "")


def feed_items(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """One row per item or entry of RSS and Atom texts: position, title, link, guid, published, content, creator,
    categories. Link and guid stand in for each other. Null texts and texts without items give no rows."""
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(item|entry)[\s>](.*?)</\1>"), F.lit(2))
    items = df.select(*keep, F.posexplode(blocks).alias("position", "b"))
    b = F.col("b")
    href = blank_to_null(F.regexp_extract(b, r"(?i)<link[^>]+href\s*=\s*[\"']([^\"']+)[\"']", 1))
    link, guid = F.coalesce(tag_text(b, "link"), href), F.coalesce(tag_text(b, "guid"), tag_text(b, "id"))
    parts = F.array_compact(F.array(*[tag_text(b, t) for t in ("description", "summary", "content:encoded", "content")]))
    return items.select(
        *keep,
        "position",
        sanitize(tag_text(b, "title")).alias("title"),
        F.coalesce(link, F.when(guid.startswith("http"), guid)).alias("link"),
        F.coalesce(guid, link).alias("guid"),
        F.coalesce(*[tag_text(b, t) for t in ("pubDate", "published", "updated", "dc:date")]).alias("published"),
        sanitize(F.array_join(parts, " ")).alias("content"),
        sanitize(F.coalesce(tag_text(b, "author"), tag_text(b, "dc:creator"))).alias("creator"),
        all_tag_texts(b, "category").alias("categories"),
    )


def anchors(df: DataFrame, html: str, keep: list[str], base: str | None = None) -> DataFrame:
    """(position, url, label) of links with 5 to 200 characters of text; relative ones resolved against the column base."""
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(2)).alias("label"))
    x = df.select(*keep, *([base] if base else []), F.posexplode(pairs).alias("position", "a")).select(
        *keep, *([base] if base else []), "position", F.col("a.href").alias("href"), strip_markup(F.col("a.label")).alias("label")
    )
    origin = F.regexp_extract(F.col(base), r"^(https?://[^/]+)", 1) if base else F.lit("")
    url = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(origin, "href")).otherwise(F.concat(origin, F.lit("/"), F.col("href")))
    return x.withColumn("url", url).where(F.length("label").between(5, 200)).select(*keep, "position", "url", "label")


def job_links(df: DataFrame, html: str, keep: list[str], base: str | None = None, path: str = JOB_PATH) -> DataFrame:
    """The first link to each posting-like address of each text; `path` is what such an address has."""
    found = anchors(df, html, keep, base).where(F.col("url").rlike(path))
    return found.groupBy(*keep, "url").agg(F.min(F.struct("position", "label")).alias("m")).select(*keep, "url", "m.position", "m.label")


def structured_postings(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Postings of the JSON-LD blocks of pages: alone, in arrays, in @graph, in item lists; blocks that are no JSON are
    skipped."""
    block = F.explode(F.regexp_extract_all(F.col(html), F.lit(LD_BLOCK), F.lit(1)))
    v = df.select(*keep, block.alias("raw")).select(*keep, F.try_parse_json("raw").alias("v")).where("v is not null")
    listed = lambda path: F.coalesce(F.expr(f"try_variant_get(v, '{path}', 'array<variant>')"), F.expr("array()"))
    each = v.select(*keep, F.explode(F.concat(F.array("v"), listed("$"), listed('$["@graph"]'), listed("$.itemListElement"))).alias("n"))
    each = each.select(*keep, F.explode(F.array(F.col("n"), F.expr("try_variant_get(n, '$.item', 'variant')"))).alias("n"))
    get = lambda path: blank_to_null(F.expr(f"try_variant_get(n, '{path}', 'string')"))
    remote = F.when(get("$.jobLocationType") == "TELECOMMUTE", "Remote")
    return each.where(F.expr("try_variant_get(n, '$[\"@type\"]', 'string')") == "JobPosting").select(
        *keep,
        F.coalesce(get("$.title"), get("$.name")).alias("title"),
        F.coalesce(get("$.hiringOrganization.name"), get("$.hiringOrganization.legalName")).alias("company"),
        F.coalesce(get("$.url"), get("$.sameAs")).alias("url"),
        strip_markup(get("$.description")).alias("content"),
        F.coalesce(get("$.jobLocation.address.addressLocality"), get("$.jobLocation.name"), remote).alias("location"),
        get("$.datePosted").alias("published"),
    )


def json_lines(df: DataFrame, text: str, keep: list[str], schema: str) -> DataFrame:
    """Rows of JSON objects, one or several on a line, also of a list written so; lines that are no JSON are skipped."""
    lines = df.select(*keep, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))
    bare = F.regexp_replace("line", r"^\s*\[|\]\}?\s*$|,\s*$", "")
    parsed = lines.select(*keep, "line_no", F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]"))).alias("v")).where("v is not null")
    each = parsed.select(*keep, "line_no", F.explode(F.expr("try_variant_get(v, '$', 'array<variant>')")).alias("o"))
    return each.select(*keep, "line_no", F.from_json(F.to_json("o"), schema).alias("j")).select(*keep, "line_no", "j.*")


def sitemap_locations(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    loc = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)))
    return df.select(*keep, loc.alias("url")).withColumn("url", decode_entities(F.col("url"))).withColumn("domain", domain(F.col("url")))


def header_rows(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Rows of a JSON array of arrays whose first row is a header: line and its fields as an array."""
    rows = F.from_json(F.col(text), "array<array<string>>")
    return df.select(*keep, F.posexplode(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))).alias("line_no", "fields"))


def certificate_domains(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Distinct base domains of certificate log entries: the common name and each line of the alternative names."""
    each = df.select(*keep, F.explode(F.from_json(F.col(text), "array<struct<common_name:string,name_value:string>>")).alias("e"))
    names = F.explode(F.concat(F.array("e.common_name"), F.split(F.coalesce("e.name_value", F.lit("")), r"\\n|\n")))
    return each.select(*keep, names.alias("name")).where(F.trim("name") != "").select(*keep, base_domain(F.trim("name")).alias("domain")).distinct()


