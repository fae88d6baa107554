"""Payloads of job boards as one canonical record, by a table of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, domain, sanitize

#: For each kind of board: where its list stands, and for each field the paths to try in turn; "cats" are paths of
#: single categories, "flags" paths of booleans that stand for "Remote", "lists" arrays with a path in each element
#: (fixed values).
BOARDS: dict[str, dict[str, list[str]]] = {
    "greenhouse": {"roots": ["$.jobs"], "title": ["title"], "link": ["absolute_url"], "content": ["content"], "date": ["updated_at"], "lists": ["departments.name"], "cats": ["location.name"]},
    "lever": {"roots": ["$"], "title": ["text"], "link": ["hostedUrl"], "content": ["descriptionPlain", "description"], "epoch": ["createdAt"], "cats": ["categories.department", "categories.commitment", "categories.location", "categories.team"]},
    "ashby": {"roots": ["$.data.jobBoard.jobPostings", "$.jobs"], "title": ["title"], "link": ["jobUrl", "externalLink"], "content": ["descriptionPlain", "descriptionHtml"], "date": ["publishedAt"], "cats": ["departmentName", "locationName", "employmentType"], "flags": ["isRemote"]},
    "workable": {"roots": ["$.results"], "title": ["title"], "link": ["url"], "content": ["description"], "date": ["published"], "cats": ["department", "location.city", "location.country"], "flags": ["location.remote"]},
    "smartrecruiters": {"roots": ["$.content", "$.results"], "title": ["name"], "link": ["ref", "applyUrl"], "content": ["name"], "date": ["releasedDate"], "company": ["company.name"], "cats": ["department.label", "location.city", "location.country"], "flags": ["location.remote"]},
    "recruitee": {"roots": ["$.offers"], "title": ["title"], "link": ["careers_url"], "content": ["description"], "date": ["published_at", "created_at"], "cats": ["department", "city", "country", "location"], "flags": ["remote"]},
    "workday": {"roots": ["$.jobPostings"], "title": ["title"], "link": ["externalPath"], "content": ["descriptionPlainText", "title"], "date": ["postedOn"], "cats": ["locationsText", "postedOn"], "lists": ["bulletFields"]},
    "breezy": {"roots": ["$", "$.positions"], "title": ["name"], "link": ["url"], "content": ["description"], "date": ["published_date", "creation_date"], "company": ["company.name"], "cats": ["location.name", "location.city", "location.country", "department", "type.name"], "flags": ["location.is_remote"]},
    "rippling": {"roots": ["$", "$.jobs", "$.results"], "title": ["title", "name"], "link": ["url", "applyUrl"], "content": ["description"], "date": ["createdAt", "publishedAt"], "cats": ["location", "department", "remoteType"]},
    "dover": {"roots": ["$", "$.jobs", "$.data"], "title": ["title", "name"], "link": ["url", "apply_url"], "content": ["description"], "date": ["published_at", "created_at"], "cats": ["location", "department"], "flags": ["remote"]},
    "pinpoint": {"roots": ["$", "$.data", "$.postings"], "title": ["title"], "link": ["url", "application_url"], "content": ["description"], "date": ["published_at", "created_at"], "cats": ["location.name", "department.name"], "flags": ["remote"]},
    "freshteam": {"roots": ["$", "$.job_postings", "$.data"], "title": ["title"], "link": ["applicant_apply_link", "url"], "content": ["description"], "date": ["created_at"], "cats": ["branch.name", "department.name", "location", "type"], "flags": ["remote"]},
    "jobvite": {"roots": ["$.requisitions", "$"], "title": ["title"], "link": ["detail_url", "applyLink"], "content": ["briefDescription", "description"], "date": ["date"], "cats": ["location", "category", "department", "jobType"]},
    "plain": {"roots": ["$", "$.jobs", "$.data", "$.results"], "title": ["title", "name"], "link": ["url", "link"], "content": ["snippet", "description", "content"], "date": ["date"], "lists": ["skills"], "flags": ["remote"]},
}
#: Hosts of boards: kind, pattern of the host, where the name of the firm stands (path part from 0, or "sub"), and sub
#: domains that are none (fixed values).
HOSTS = [
    ("greenhouse", r"boards\.greenhouse\.io", 0, ""), ("lever", r"jobs\.lever\.co", 0, ""), ("ashby", r"jobs\.ashbyhq\.com", 0, ""), ("ashby", r"\.ashbyhq\.com$", "sub", "api|jobs"),
    ("workable", r"apply\.workable\.com", 0, "api"), ("breezy", r"jobs\.breezy\.hr", 0, ""), ("breezy", r"\.breezy\.hr$", "sub", "jobs"), ("smartrecruiters", r"careers\.smartrecruiters\.com", 0, ""),
    ("recruitee", r"\.recruitee\.com$", "sub", ""), ("rippling", r"app\.rippling\.com", 1, ""), ("pinpoint", r"\.pinpointhq\.com$", "sub", "app"), ("teamtailor", r"\.teamtailor\.com$", "sub", "careers"),
    ("dover", r"app\.dover\.com", 1, ""), ("freshteam", r"\.freshteam\.com$", "sub", ""), ("jobvite", r"jobs\.jobvite\.com", 0, ""), ("workday", r"\.wd\d+\.myworkdayjobs\.com$", "sub", ""),
]


def board_records(df: DataFrame, payload: str, kind: str, keep: list[str]) -> DataFrame:
    """One row per posting of payloads of one kind: position, id, title, link, content, published, company, categories.

    A payload may be a list, with or without its brackets, an object with a list, or a single object with a title; what
    is no JSON gives no rows."""
    spec = BOARDS[kind]
    wrapped = df.select(*keep, F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]"))).alias("w")).where("w is not null")
    alone = F.expr("try_variant_get(w, '$[1]', 'variant') is null")  # else it is a list without its brackets
    v = wrapped.select(*keep, F.when(alone, F.expr("try_variant_get(w, '$[0]', 'variant')")).otherwise(F.col("w")).alias("v")).where("v is not null")
    roots = [F.expr(f"try_variant_get(v, '{r}', 'array<variant>')") for r in spec["roots"]]
    jobs = v.select(*keep, F.posexplode(F.coalesce(*roots, F.expr("array(v)"))).alias("position", "j"))

    def get(path: str, kind: str = "string") -> Column:
        return F.expr(f"try_variant_get(j, '$.{path}', '{kind}')")

    first = lambda field: F.coalesce(*[blank_to_null(get(p)) for p in spec.get(field, [])], F.lit(None).cast("string"))
    cats = [F.array_compact(F.array(*[blank_to_null(get(p)) for p in spec["cats"]]))] if spec.get("cats") else []
    for path in spec.get("lists", []):
        name, _, inner = path.partition(".")
        each = F.coalesce(F.expr(f"try_variant_get(j, '$.{name}', 'array<variant>')"), F.expr("array()"))
        inner_path = "$." + inner if inner else "$"
        cats.insert(0, F.array_compact(F.transform(each, lambda x: F.call_function("try_variant_get", x, F.lit(inner_path), F.lit("string")))))
    for path in spec.get("flags", []):
        cats.append(F.when(F.coalesce(get(path, "boolean"), F.lit(False)), F.array(F.lit("Remote"))).otherwise(F.array().cast("array<string>")))
    published = first("date")
    if "epoch" in spec:
        published = F.date_format(F.timestamp_millis(get(spec["epoch"][0], "bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return jobs.select(
        *keep, "position", get("id").alias("id"), first("title").alias("title"), first("link").alias("link"), sanitize(first("content")).alias("content"),
        published.alias("published"), first("company").alias("company"), (F.concat(*cats) if cats else F.array().cast("array<string>")).alias("categories"),
    ).where("title is not null")


def board_of(url: Column) -> Column:
    """struct(kind, slug) of an address on a known board; null elsewhere, and where no firm is named."""
    h = domain(url)
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    out = F.lit(None).cast("struct<kind:string,slug:string>")
    for kind, pattern, place, none in reversed(HOSTS):
        slug = F.split_part(h, F.lit("."), F.lit(1)) if place == "sub" else F.try_element_at(parts, F.lit(place + 1))
        good = slug.isNotNull() & (slug != "") & (~slug.rlike(f"^(?:{none})$") if none else F.lit(True))
        out = F.when(h.rlike(f"(?i){pattern}") & good, F.struct(F.lit(kind).alias("kind"), slug.alias("slug"))).otherwise(out)
    return out
