"""Readers of pages, lists and board payloads over what the tables would look like when they land: each record is rendered
as a page or payload of its kind and read back; the SQL takes the same fields from the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..sources import boards, discovery, feeds
from .registry import Registry
from .texts import clean_sql

R = Registry()
QUERIES, SQL = R.queries, R.sql
_full = "case when trim({0}) <> '' then {0} end"
_link = f"coalesce({_full.format('link')}, {_full.format('url')})"
_clean = clean_sql("contentsnippet")
_terms = "list_filter(coalesce(categories, []), lambda x: x is not null)"
_one = lambda *cols: "list_filter([" + ", ".join(cols) + "], lambda x: trim(x) <> '')"
_flag = "case when row_id % 2 = 0 then ['Remote'] else [] end"
_day = "strftime(make_timestamp(epoch_us(fetched_at)), '%Y-%m-%d')"
_stamp = "strftime(make_timestamp(epoch_us(fetched_at)), '%Y-%m-%dT%H:%M:%S.%gZ')"
c, lit = F.col, F.lit
_even = lambda: F.col("row_id") % 2 == 0
_date = lambda: F.date_format("fetched_at", "yyyy-MM-dd")


def S(**fields):
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _named(name):
    return F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda x: F.struct(x.alias(name)))


#: For each kind of board: its record, what it stands in, and in SQL the link, date, firm and categories that come of it.
KINDS = {
    "greenhouse": (lambda: S(id=c("id"), title=c("title"), absolute_url=c("link"), content=c("contentsnippet"), updated_at=_date(), departments=_named("name"), location=S(name=c("sourcename"))), lambda r: S(jobs=F.array(r)), _full.format("link"), _day, "null", f"list_concat({_terms}, {_one('sourcename')})"),
    "lever": (lambda: S(id=c("id"), text=c("title"), hostedUrl=c("url"), descriptionPlain=c("contentsnippet"), createdAt=F.unix_millis("fetched_at"), categories=S(department=c("sourcename"), commitment=lit("Full-time"), location=lit(" "), team=c("sourcetype"))), lambda r: F.array(r), _full.format("url"), _stamp, "null", _one("sourcename", "'Full-time'", "sourcetype")),
    "ashby": (lambda: S(id=c("id"), title=c("title"), jobUrl=c("link"), externalLink=c("url"), descriptionHtml=c("contentsnippet"), publishedAt=_date(), departmentName=c("sourcename"), employmentType=c("sourcetype"), isRemote=_even()), lambda r: S(data=S(jobBoard=S(jobPostings=F.array(r)))), _link, _day, "null", f"list_concat({_one('sourcename', 'sourcetype')}, {_flag})"),
    "workable": (lambda: S(id=c("id"), title=c("title"), url=c("url"), description=c("contentsnippet"), published=_date(), department=c("sourcetype"), location=S(city=c("sourcename"), country=lit("DE"), remote=_even())), lambda r: S(results=F.array(r)), _full.format("url"), _day, "null", f"list_concat({_one('sourcetype', 'sourcename')}, ['DE'], {_flag})"),
    "smartrecruiters": (lambda: S(id=c("id"), name=c("title"), ref=c("link"), applyUrl=c("url"), releasedDate=_date(), company=S(name=c("company")), department=S(label=c("sourcetype")), location=S(city=c("sourcename"), remote=_even())), lambda r: S(content=F.array(r)), _link, _day, _full.format("company"), f"list_concat({_one('sourcetype', 'sourcename')}, {_flag})"),
    "recruitee": (lambda: S(id=c("id"), title=c("title"), careers_url=c("url"), description=c("contentsnippet"), created_at=_date(), department=c("sourcetype"), city=c("sourcename"), remote=_even()), lambda r: S(offers=F.array(r)), _full.format("url"), _day, "null", f"list_concat({_one('sourcetype', 'sourcename')}, {_flag})"),
    "workday": (lambda: S(id=c("id"), title=c("title"), externalPath=c("link"), descriptionPlainText=c("contentsnippet"), postedOn=_date(), locationsText=c("sourcename"), bulletFields=c("categories")), lambda r: S(jobPostings=F.array(r)), _full.format("link"), _day, "null", f"list_concat({_terms}, {_one('sourcename')}, case when fetched_at is not null then [{_day}] else [] end)"),
    "breezy": (lambda: S(id=c("id"), name=c("title"), url=c("url"), description=c("contentsnippet"), creation_date=_date(), company=S(name=c("company")), location=S(name=c("sourcename"), is_remote=_even()), type=S(name=c("sourcetype"))), lambda r: S(positions=F.array(r)), _full.format("url"), _day, _full.format("company"), f"list_concat({_one('sourcename', 'sourcetype')}, {_flag})"),
    "rippling": (lambda: S(id=c("id"), name=c("title"), url=c("link"), applyUrl=c("url"), description=c("contentsnippet"), createdAt=_date(), location=c("sourcename"), department=c("sourcetype")), lambda r: S(results=F.array(r)), _link, _day, "null", _one("sourcename", "sourcetype")),
    "dover": (lambda: S(id=c("id"), title=c("title"), url=c("link"), apply_url=c("url"), description=c("contentsnippet"), published_at=_date(), location=c("sourcename"), department=c("sourcetype"), remote=_even()), lambda r: S(data=F.array(r)), _link, _day, "null", f"list_concat({_one('sourcename', 'sourcetype')}, {_flag})"),
    "pinpoint": (lambda: S(id=c("id"), title=c("title"), url=c("link"), application_url=c("url"), description=c("contentsnippet"), published_at=_date(), location=S(name=c("sourcename")), department=S(name=c("sourcetype")), remote=_even()), lambda r: S(postings=F.array(r)), _link, _day, "null", f"list_concat({_one('sourcename', 'sourcetype')}, {_flag})"),
    "freshteam": (lambda: S(id=c("id"), title=c("title"), applicant_apply_link=c("link"), url=c("url"), description=c("contentsnippet"), created_at=_date(), branch=S(name=c("sourcename")), type=c("sourcetype"), remote=_even()), lambda r: S(job_postings=F.array(r)), _link, _day, "null", f"list_concat({_one('sourcename', 'sourcetype')}, {_flag})"),
    "jobvite": (lambda: S(id=c("id"), title=c("title"), detail_url=c("link"), applyLink=c("url"), briefDescription=c("contentsnippet"), date=_date(), location=c("sourcename"), category=c("sourcetype")), lambda r: S(requisitions=F.array(r)), _link, _day, "null", _one("sourcename", "sourcetype")),
}
NUMBERS = dict(zip(KINDS, ("06", "07", "08", "09", "10", "11", "13", "14", "15", "16", "17", "18", "19")))


def _payload(kind: str):
    record, around, *_ = KINDS[kind]
    return F.to_json(around(record()))


for _kind, (_, _, _l, _d, _f, _cats) in KINDS.items():
    _text = clean_sql("title") if _kind == "smartrecruiters" else _clean
    if _kind == "workday":  # the title stands in for a text
        _text = f"case when trim(contentsnippet) <> '' then {_clean} else {clean_sql('title')} end"

    @R.add(f"src{NUMBERS[_kind]}_{_kind}", f"select row_id, 0 as position, id, title, {_l} link, {_text} as content, {_d} published, {_f} company, {_cats} categories from raw_jobs where trim(title) <> ''")
    def _(t, kind=_kind):
        return boards.board_records(t("raw_jobs").select("row_id", _payload(kind).alias("payload")), "payload", kind, ["row_id"])


@R.add("src22_dispatched", "select ['greenhouse', 'lever', 'dover', 'rss'][1 + row_id % 4] kind, count(*) n, count(distinct id) ids from raw_jobs where trim(title) <> '' and (row_id % 4 <> 3 or trim(id) <> '') group by 1")
def _(t):
    item = F.concat(lit("<rss><item><title><![CDATA["), F.coalesce("title", lit("")), lit("]]></title><guid>"), F.coalesce("id", lit("")), lit("</guid></item></rss>"))
    kinds = ("greenhouse", "lever", "dover")
    payload = F.when(c("row_id") % 4 == 3, item)
    for i, kind in enumerate(kinds):
        payload = payload.when(c("row_id") % 4 == i, _payload(kind))
    landed = t("raw_jobs").select("row_id", F.element_at(F.array(*map(lit, (*kinds, "rss"))), (c("row_id") % 4 + 1).cast("int")).alias("sort"), payload.alias("payload"), "title", "id")
    landed = landed.where("trim(title) <> '' and (sort <> 'rss' or trim(id) <> '')").drop("title", "id")
    return discovery.dispatched(landed, "sort", "payload", ["row_id"]).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


_label = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&[^;\\s]{{1,10}};', ' ', 'g'), '\\s{{2,}}', ' ', 'g'))"


def _page(t):
    """A page a record: structured data in four forms and a broken block, or links."""
    posting = F.to_json(F.struct(lit("JobPosting").alias("@type"), c("title"), F.struct(c("company").alias("name")).alias("hiringOrganization"), c("link").alias("url"), c("contentsnippet").alias("description"), F.when(_even(), "TELECOMMUTE").alias("jobLocationType")))
    form = F.element_at(F.array(posting, F.concat(lit("["), posting, lit("]")), F.concat(lit('{"@graph":[{"@type":"Thing"},'), posting, lit("]}")), F.concat(lit('{"@type":"ItemList","itemListElement":[{"item":'), posting, lit("}]}"))), (c("row_id") % 4 + 1).cast("int"))
    block = lambda x: F.concat(lit('<script type="application/ld+json">'), x, lit("</script>"))
    return t("raw_jobs").where("not coalesce(contains(lower(concat_ws(' ', title, company, contentsnippet, link)), '</script'), false)").select("row_id", "sourceurl", F.concat(lit("<html>"), block(lit("{broken")), block(form)).alias("html"))


@R.add("src20_structured_postings", f"select row_id, {_full.format('title')} title, {_full.format('company')} company, {_full.format('link')} url, {_label.format('coalesce(contentsnippet, chr(32))')} as content, case when row_id % 2 = 0 then 'Remote' end as location from raw_jobs where not coalesce(contains(lower(concat_ws(' ', title, company, contentsnippet, link)), '</script'), false)")
def _(t):
    x = feeds.structured_postings(_page(t), "html", ["row_id"])
    return x.select("row_id", "title", "company", "url", "content", "location")


def _links(t):
    link = lambda href, text: F.concat(lit('<a class="x" href="'), href, lit('">'), text, lit("</a> "))
    title = F.coalesce("title", lit(""))
    n = c("row_id").cast("string")
    return t("raw_jobs").select("row_id", "sourceurl", F.concat(link(F.concat(lit("/jobs/"), n), F.concat(lit("<b>"), title, lit("</b>"))), link(lit("/about"), lit("About our firm")), link(F.concat(lit("/jobs/"), n), lit("The same again")), link(F.concat(lit("https://other.example/careers/"), n, lit("?x=1")), lit("QA <i>Lead</i>"))).alias("html"))


_links_sql = f"select row_id, coalesce(nullif(regexp_extract(sourceurl, '^(https?://[^/]+)', 1), ''), '') origin, {_label.format('coalesce(title, chr(32))')} as t from raw_jobs where sourceurl is not null"


@R.add("src21_job_links", f"with x as ({_links_sql}) select row_id, origin || '/jobs/' || row_id as url, case when length(t) between 5 and 200 then t else 'The same again' end as label from x union all select row_id, 'https://other.example/careers/' || row_id || '?x=1', 'QA Lead' from x")
def _(t):
    return feeds.job_links(_links(t).where("sourceurl is not null"), "html", ["row_id"], "sourceurl").select("row_id", "url", "label")


@R.add("src19_short_links", "select row_id, 'https://jobs.board.example/acme/j/o' || row_id as url from raw_jobs")
def _(t):
    """Postings of boards that have no payload, by their short links."""
    n = c("row_id").cast("string")
    html = F.concat(lit('<a href="/acme/j/o'), n, lit('">The post itself</a> <a href="/acme/about">About the firm</a> <a href="/acme/j/o'), n, lit('">Apply to the post</a>'))
    pages = t("raw_jobs").select("row_id", html.alias("html"), lit("https://jobs.board.example/acme").alias("base"))
    return feeds.job_links(pages, "html", ["row_id"], "base", r"/j/[^/?#]+").select("row_id", "url")


@R.add("src12_page_postings", f"with x as ({_links_sql}) select row_id, case when length(t) between 5 and 200 then t else 'The same again' end as title from x where row_id % 3 = 0 union all select row_id, 'QA Lead' from x where row_id % 3 = 0 union all select row_id, {_full.format('title')} from raw_jobs where row_id % 3 <> 0 and not coalesce(contains(lower(concat_ws(' ', title, company, contentsnippet, link)), '</script'), false)")
def _(t):
    pages = _links(t).where("sourceurl is not null and row_id % 3 = 0").unionByName(_page(t).where("row_id % 3 <> 0"))
    return discovery.page_postings(pages, "html", ["row_id"], "sourceurl").select("row_id", "title")


@R.add("sx27_link_counts", "select row_id, 2 + 1 as job_links, 0 as postings from raw_jobs")
def _(t):
    x = _links(t)
    return x.select("row_id", discovery.job_link_count(c("html")).alias("job_links"), discovery.posting_count(c("html")).alias("postings"))


_slug = "'firm' || (row_id % 97)"


@R.add("sx26_board_redirects", f"select row_id, unnest(case row_id % 3 when 0 then ['https://boards.greenhouse.io/' || {_slug}, 'https://' || {_slug} || '.recruitee.com'] when 1 then ['https://jobs.lever.co/' || {_slug}] else [] end) as url from raw_jobs")
def _(t):
    slug = F.concat(lit("firm"), (c("row_id") % 97).cast("string"))
    a, b = F.concat(lit("boards.greenhouse.io/"), slug), F.concat(slug, lit(".recruitee.com"))
    html = F.when(c("row_id") % 3 == 0, F.concat(lit('<a href="https://'), b, lit('/o/1">x</a> <iframe src="https://'), a, lit('/embed"></iframe> https://'), a)).when(c("row_id") % 3 == 1, F.concat(lit("https://jobs.lever.co/"), slug, lit("?a=1"))).otherwise("<p>boards.example</p>")
    return t("raw_jobs").select("row_id", F.explode(discovery.board_links(html)).alias("url"))


#: Addresses on boards, with FIRM for the firm's name: what kind they are of; none where no firm is named.
ADDRESSES = [
    ("https://boards.greenhouse.io/FIRM/jobs/1", "greenhouse"), ("https://jobs.lever.co/FIRM", "lever"), ("https://jobs.ashbyhq.com/FIRM/x", "ashby"), ("https://FIRM.ashbyhq.com/", "ashby"), ("https://api.ashbyhq.com/FIRM", None),
    ("https://apply.workable.com/FIRM/j/1", "workable"), ("https://apply.workable.com/api/FIRM", None), ("https://jobs.breezy.hr/FIRM/p", "breezy"), ("https://FIRM.breezy.hr/", "breezy"), ("https://careers.smartrecruiters.com/FIRM", "smartrecruiters"),
    ("https://FIRM.recruitee.com/o/x", "recruitee"), ("https://app.rippling.com/jobs/FIRM", "rippling"), ("https://FIRM.pinpointhq.com/", "pinpoint"), ("https://FIRM.teamtailor.com/jobs", "teamtailor"), ("https://app.dover.com/jobs/FIRM", "dover"),
    ("https://FIRM.freshteam.com/jobs", "freshteam"), ("https://jobs.jobvite.com/FIRM/jobs", "jobvite"), ("https://FIRM.wd5.myworkdayjobs.com/site", "workday"), ("https://www.FIRM.example/careers", None), ("FIRM", None),
]


@R.add("sx25_boards", f"select row_id, [{', '.join('null' if k is None else repr(k) for _, k in ADDRESSES)}][1 + row_id % {len(ADDRESSES)}] as kind, case when [{', '.join('null' if k is None else repr(k) for _, k in ADDRESSES)}][1 + row_id % {len(ADDRESSES)}] is not null then {_slug} end as slug from raw_jobs")
def _(t):
    form = F.element_at(F.array(*[lit(u) for u, _ in ADDRESSES]), (c("row_id") % len(ADDRESSES) + 1).cast("int"))
    url = F.replace(form, lit("FIRM"), F.concat(lit("firm"), (c("row_id") % 97).cast("string")))
    b = boards.board_of(url)
    return t("raw_jobs").select("row_id", b["kind"].alias("kind"), b["slug"].alias("slug"))


@R.add("src27_sitemap", "select row_id, url, nullif(regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', ''), '') as domain from (select row_id, unnest([sourceurl || '?a=1&b=2', link]) as url from raw_jobs where sourceurl is not null) where url is not null and trim(url) <> ''")
def _(t):
    loc = lambda x: F.concat(lit("<url><loc> "), F.replace(x, lit("&"), lit("&amp;")), lit(" </loc></url>"))
    xml = F.concat(lit("<urlset>"), loc(F.concat("sourceurl", lit("?a=1&b=2"))), F.coalesce(loc(blank_to_null(c("link"))), lit("")), lit("</urlset>"))
    return feeds.sitemap_locations(t("raw_jobs").where("sourceurl is not null").select("row_id", xml.alias("xml")), "xml", ["row_id"])


@R.add("src28_archive_rows", "select row_id, 0 as line_no, sourceurl as url, fetched as time from (select row_id, sourceurl, strftime(make_timestamp(epoch_us(fetched_at)), '%Y%m%d%H%M%S') fetched from raw_jobs) union all select row_id, 1, link, '2' from raw_jobs")
def _(t):
    stamp = F.date_format("fetched_at", "yyyyMMddHHmmss")
    rows = F.to_json(F.array(F.array(lit("original"), lit("timestamp")), F.array("sourceurl", stamp), F.array("link", lit("2"))))
    x = feeds.header_rows(t("raw_jobs").select("row_id", rows.alias("text")), "text", ["row_id"])
    return x.select("row_id", "line_no", c("fields")[0].alias("url"), c("fields")[1].alias("time"))


@R.add("src29_certificates", "select distinct url, unnest([domain, 'other.example']) as domain from source_registry where domain is not null")
def _(t):
    log = F.to_json(F.array(S(common_name=F.concat(lit("*.shop."), "domain"), name_value=F.concat(lit("a."), "domain", lit("\nwww.other.example"))), S(common_name=c("domain"), name_value=lit(None).cast("string"))))
    return feeds.certificate_domains(t("source_registry").where("domain is not null").select("url", log.alias("text")), "text", ["url"])


@R.add("src30_new_domains", "select domain from (select distinct lower(domain) as domain from source_registry where domain is not null) where domain like '%ist.example' or contains(domain, 'ra')")
def _(t):
    lines = F.concat(F.upper("domain"), lit(" # seen\r\nno dot\n#"), "domain")
    return discovery.listed_domains(t("source_registry").where("domain is not null").select(lines.alias("text")), "text", [], ("ist.example",), ("ra",))


@R.add("src32_package_domains", "select distinct row_id, unnest(list_filter(list_distinct([nullif(regexp_replace(lower(regexp_extract(sourceurl, '^https?://([^/:?#]+)', 1)), '^www\\.', ''), ''), case when row_id % 2 = 0 then 'mail' || (row_id % 50) || '.example' end]), lambda x: x is not null)) as domain from raw_jobs")
def _(t):
    mail = F.when(_even(), F.concat(lit("Dev@Mail"), (c("row_id") % 50).cast("string"), lit(".example"))).otherwise("dev@gmail.com")
    entry = S(package=S(links=S(homepage=c("sourceurl")), publisher=S(email=mail)))
    payload = F.to_json(S(objects=F.array(entry)))
    return discovery.package_domains(t("raw_jobs").select("row_id", payload.alias("p")), "p", ["row_id"], ("$.objects",), ("package.links.homepage",), ("package.publisher.email",))


def _portfolio(t):
    a = lambda x: F.concat(lit("<a href='"), x, lit("'>x</a>"))
    html = F.concat(a("sourceurl"), a("sourceurl"), a(lit("https://www.linkedin.com/company/x")), a(lit("/inner")), F.coalesce(a(blank_to_null(c("link"))), lit("")), a(lit("https://jobs.fund.example/x")))
    return t("raw_jobs").where("sourceurl is not null").select("row_id", html.alias("html"), lit("fund.example").alias("own"))


_outside = "select distinct row_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') as domain from (select row_id, unnest([sourceurl, link]) as url from raw_jobs where sourceurl is not null) where regexp_matches(url, '^https?://[^\"''<>\\s]+$')"


@R.add("src38_portfolio_links", _outside)
def _(t):
    return discovery.outside_links(_portfolio(t), "html", ["row_id"], ("linkedin.com",), "own")


@R.add("src33_listed_firms", f"select distinct domain from ({_outside})")
def _(t):
    return discovery.outside_links(_portfolio(t), "html", ["row_id"], ("linkedin.com",), "own").select("domain").distinct()


@R.add("src36_filings", "select entity_id, name, 'D' form, slug || '.com' as domain from (select entity_id, name, array_to_string(list_slice(list_filter(string_split_regex(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: w <> ''), 1, 2), '') slug from known_names) where length(slug) >= 3")
def _(t):
    hit = S(_source=S(entity_name=F.when(c("entity_id") % 2 == 0, c("name")), display_names=F.array("name", lit("x")), form_type=lit("D")))
    payload = F.to_json(S(hits=S(hits=F.array(hit))))
    return discovery.filing_domains(t("known_names").select("entity_id", payload.alias("p")), "p", ["entity_id"])


@R.add("src37_results", "select distinct row_id, url from (select row_id, unnest([sourceurl, link]) as url from raw_jobs where sourceurl is not null) where regexp_matches(url, '^https?://[^\"''<>\\s]+$')")
def _(t):
    a = lambda x: F.concat(lit('<li><a class="r" href="'), x, lit('">x</a>'))
    page = F.concat(a("sourceurl"), F.coalesce(a(blank_to_null(c("link"))), lit("")), a(lit("https://www.search.example/next")))
    valid = F.when(c("link").rlike(r"^https?://[^\"'<>\s]+$"), c("link"))
    listed = F.to_json(S(items=F.array(S(link=c("sourceurl")), S(link=valid))))
    x = t("raw_jobs").where("sourceurl is not null").select("row_id", F.when(_even(), page).otherwise(listed).alias("text"))
    return discovery.result_links(x, "text", ["row_id"], ("search.example",))


@R.add("src25_valid_sources", "select url from source_registry where regexp_matches(url, '^https?://[^/\\s]+') and trim(sourcetype) <> '' and trim(name) <> ''")
def _(t):
    return discovery.valid_sources(t("source_registry"), "sourcetype", "url", "name").select("url")


@R.add("rm11_slug_domains", "select distinct regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') || '.com' as domain from known_names where kind = 'org'")
def _(t):
    href = F.concat(lit('<a href="/products/'), F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), lit('/reviews">x</a>'))
    slug = F.explode(F.regexp_extract_all(href, lit(r"/products/([a-z0-9-]+)/"), lit(1)))
    return t("known_names").where("kind = 'org'").select(slug.alias("s")).select(F.concat("s", lit(".com")).alias("domain")).distinct()
