"""Scores of postings and what is made of them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extract, text
from ..operators.match import keyword_matches, match_terms
from ..operators.score import Rules, further_points, score
from ..operators.series import fan_out
from .registry import Registry
from .texts import _firm, _no_space, alone_sql, clean_sql

R = Registry()
QUERIES, SQL = R.queries, R.sql
#: Rules of the example query (fixed values).
RULES = Rules(
    roles=("data engineer", "backend engineer", "platform engineer", "site reliability engineer"), must=("python", "kafka", "spark", "docker", "postgres"),
    should=("kubernetes", "scala", "airflow", "terraform", "aws", "gcp"), nice=("rust", "go", "flink", "redis", "graphql"), places=("remote", "remote-friendly"),
    exclude=("php",), synonyms={"postgres": ("postgresql",), "go": ("golang",)}, combinations=((("kafka", "spark"), 8), (("docker", "kubernetes"), 6)), penalties=((("haskell", "elixir"), -15),), wishes=("mid-level", "4 years"),
)


def _scored(t):
    return score(t("raw_jobs"), RULES, "title", "content", ["row_id", "sourceurl", "fetched_at"])


#: The older score: similarity counts above 0.6, and the cap without must terms is higher (fixed values).
OLDER = replace(RULES, cap_without_must=55, semantic_from=0.6, semantic_weight=20, semantic_base=0.6)


def _score_sql(r: Rules, similarity: str = "0") -> str:
    """The score of each record (row_id, score, excluded and its parts) in SQL."""
    semantic = f"(case when {similarity} > {r.semantic_from} then floor(({similarity} - {r.semantic_base}) / (1 - {r.semantic_base}) * {r.semantic_weight} + 0.5) else 0 end)::bigint"

    def hit(term: str, column: str) -> str:
        before, after = ("a-z0-9_+.\\-" if end in "+.-" else "a-z0-9_" for end in (term[0], term[-1]))
        quoted = "".join("\\" + c if c in "+.#-" else c for c in term)
        return f"regexp_matches({column}, '(^|[^{before}]){quoted}($|[^{after}])')"

    hits = lambda terms, column: "(" + (" + ".join(f"{hit(t, column)}::int" for t in terms) or "0") + ")"
    all_of = lambda terms: " and ".join(hit(t, "x") for t in terms)
    w = r.weights
    bonus = " + ".join([f"case when {all_of(c)} then {p} else 0 end" for c, p in r.combinations] + [f"case when must = 0 and {hits(c, 'x')} > 0 then {p} else 0 end" for c, p in r.penalties])
    steps = "case roles " + " ".join(f"when {i} then {x}" for i, x in enumerate(r.title_steps[:-1])) + f" else {r.title_steps[-1]} end"
    return f"""
with c as (select row_id, lower({clean_sql("title")}) t, lower(concat_ws(' ', {clean_sql("title")}, {clean_sql("content")})) x from raw_jobs),
h as (select *, {hits(r.widened(r.must), "x")} must, {hits(r.widened(r.should), "x")} should, {hits(r.widened(r.nice), "x")} nice, {hits(r.widened(r.roles), "t")} roles,
  {hits(r.widened(r.places), "x")} > 0 place, {hits(r.widened(r.exclude), "x")} > 0 excluded from c),
p as (select *, floor({w["title"]} * {steps} + 0.5)::bigint title_points,
  least({w["skills"]}, floor((must / {len(r.must)} * 0.7 + should / {len(r.should)} * 0.3) * {w["skills"]} + 0.5))::bigint skill_points,
  floor(nice / {len(r.nice)} * {w["tech"]} + 0.5)::bigint tech_points, (case when place then {w["place"]} else 0 end)::bigint place_points, ({bonus})::bigint bonus_points, {semantic} semantic_points from h),
b as (select *, title_points + skill_points + tech_points + place_points base from p),
s as (select *, (case when excluded then 0 else least(case when must = 0 then {r.cap_without_must} else 100 end, greatest(0, least(100, bonus_points + semantic_points + case
  when must + should + nice + roles = 0 then floor(base * 0.1 + 0.5) when must = 0 then base when must + should < {r.least_primary} then floor(base * greatest(0.5, (must + should) / {r.least_primary}) + 0.5) else base end))) end)::bigint score from b)
select row_id, score, excluded, title_points, skill_points, tech_points, place_points, bonus_points, semantic_points from s"""


@R.add("sc09_scores", _score_sql(RULES))
def _(t):
    return _scored(t).drop("sourceurl", "fetched_at", "skills")


_years = "case when x_lo is null then 0 when x_lo > 4 + 1 then -6 when coalesce(x_hi, x_lo) <= 4 then 4 else 0 end"


def _further_sql(r: Rules) -> str:
    """further_points() in SQL."""
    text = f"concat_ws(' ', {clean_sql('title')}, {clean_sql('content')})"
    words = lambda t: "[" + ", ".join(repr(w) for w in r.widened((t,))) + "]"
    count = lambda t: f"len(list_filter(ws, lambda w: list_contains({words(t)}, w)))"
    df = ", ".join(f"count(*) filter ({count(t)} > 0) f{i}" for i, t in enumerate(r.must))
    signal = " + ".join(f"coalesce({count(t)} / nullif(len(ws), 0), 0) * (ln((greatest(n, 1) + 1) / (f{i} + 1)) + 1)" for i, t in enumerate(r.must))
    level = "case " + " ".join(f"when {alone_sql(p, 'lower(x)')} then '{n}'" for n, p in extract.LEVELS) + " else 'unknown' end"
    pair, single, lakhs, money = (p.replace("(?i)", "") for p in (extract.YEAR_RANGE, extract.YEAR_SINGLE, extract.LAKHS, extract.MONEY))
    return f"""
with t as (select row_id, {text} x, list_filter(string_split({_no_space.format(f"lower({text})")}, ' '), lambda w: w <> '') ws from raw_jobs), s as (select count(*) n, {df} from t),
e as (select t.*, s.*, regexp_extract(x, '{pair}', ['lo', 'hi'], 'i') p, regexp_extract(x, '{single}', 1, 'i') one, regexp_extract(x, '{money}', ['a', 'b', 'c', 'd', 'e', 'f'], 'i') m, regexp_matches(x, '{lakhs}', 'i') lakh from t, s),
y as (select *, case when p.lo <> '' then try_cast(p.lo as int) when one <> '' then try_cast(one as int) end x_lo, case when p.lo <> '' then try_cast(p.hi as int) end x_hi, try_cast(replace(m.b, ',', '') as double) * case when m.c <> '' then 1000 else 1 end low, lower(m.f) per from e),
z as (select *, coalesce(try_cast(replace(m.d, ',', '') as double) * case when m.e <> '' then 1000 else 1 end, low) high from y),
w as (select *, case when contains(per, 'hr') or contains(per, 'hour') then 2000 when contains(per, 'mo') then 12 when contains(per, 'wk') or contains(per, 'week') then 50 when high > 0 and high < 300 then 2000 when high >= 300 and high < 4000 then 50 when high >= 4000 and high <= 15000 then 12 else 1 end times from z),
v as (select row_id, floor(least(1.0, ({signal}) * 10) * {r.term_points} + 0.5)::bigint term_points, ({_years})::bigint year_points,
 (case {level} when 'lead' then -8 when 'junior' then 0 when 'mid' then 5 when 'senior' then -8 else 0 end)::bigint level_points, (case when lakh or high * times >= 10000 and low * times <= 1500000 then {r.pay_points} else 0 end)::bigint pay_points from w)
select *, term_points + year_points + level_points + pay_points further from v"""


@R.add("sc10_older_scores", _score_sql(OLDER, "(row_id % 101)::double / 100"))
def _(t):
    with_similarity = t("raw_jobs").withColumn("similarity", (F.col("row_id") % 101).cast("double") / 100)
    return score(with_similarity, OLDER, "title", "content", ["row_id"], "similarity").drop("skills")


@R.add("sc09_further_points", _further_sql(RULES))
def _(t):
    return further_points(t("raw_jobs"), RULES, "title", "content", ["row_id"])


@R.add("sc14_relevant", f"select row_id, total from (select row_id, case when s.excluded then 0 else least(100, greatest(0, s.score + f.further)) end::bigint total from ({_score_sql(RULES)}) s join ({_further_sql(RULES)}) f using (row_id)) where total >= 65")
def _(t):
    s, f = _scored(t).select("row_id", "score", "excluded"), further_points(t("raw_jobs"), RULES, "title", "content", ["row_id"]).select("row_id", "further")
    total = F.when(F.col("excluded"), 0).otherwise(text.clamp(F.col("score") + F.col("further"), 0, 100)).cast("long")
    return s.join(f, "row_id").select("row_id", total.alias("total")).where("total >= 65")


@R.add("jn05_fan_out", f"select s.row_id, p.profile_id, s.score from ({_score_sql(RULES)}) s join profiles p on s.score >= greatest(coalesce(p.notification_threshold, 55), 55)")
def _(t):
    return fan_out(_scored(t).select("row_id", "score"), "score", t("profiles").select("profile_id", "notification_threshold"), "notification_threshold", 55).select("row_id", "profile_id", "score")


@R.add("sc02_salaries", f"""with e as (select row_id, content x, regexp_extract(content, '{extract.MONEY.replace("(?i)", "")}', ['a', 'b', 'c', 'd', 'e', 'f'], 'i') m, regexp_extract(content, '{extract.LAKHS.replace("(?i)", "")}', ['lo', 'hi'], 'i') l from raw_jobs where content is not null),
y as (select *, try_cast(replace(m.b, ',', '') as double) * case when m.c <> '' then 1000 else 1 end low, lower(m.f) per, case when m.a <> '' then m.a else '$' end currency from e), z as (select *, coalesce(try_cast(replace(m.d, ',', '') as double) * case when m.e <> '' then 1000 else 1 end, low) high from y),
w as (select *, case when contains(per, 'hr') or contains(per, 'hour') then 2000 when contains(per, 'mo') then 12 when contains(per, 'wk') or contains(per, 'week') then 50 when high > 0 and high < 300 then 2000 when high >= 300 and high < 4000 then 50 when high >= 4000 and high <= 15000 then 12 else 1 end times, case currency when '€' then 1.08::double when '£' then 1.27::double else 1.0::double end rate from z)
select row_id, case when l.lo <> '' then floor(try_cast(l.lo as double) * 1200 + 0.5) else floor(low * times * rate + 0.5) end::bigint low, case when l.lo <> '' then floor(coalesce(try_cast(l.hi as double), try_cast(l.lo as double)) * 1200 + 0.5) else floor(high * times * rate + 0.5) end::bigint high, case when l.lo <> '' then 'INR' else currency end currency from w where l.lo <> '' or high * times >= 10000 and low * times <= 1500000""")
def _(t):
    x = t("raw_jobs").select("row_id", extract.salary_usd(F.col("content")).alias("s")).where("s is not null")
    return x.select("row_id", F.col("s.low").alias("low"), F.col("s.high").alias("high"), F.col("s.currency").alias("currency"))


_level_of = "case " + " ".join(f"when {alone_sql(p, 'l')} then '{n}'" for n, p in extract.LEVELS) + " else 'unknown' end"


@R.add("sc06_level_fit", f"select fit, count(*) n from (select case {_level_of} when 'lead' then 'mismatch' when 'junior' then 'match' when 'mid' then 'match' when 'senior' then 'mismatch' else 'neutral' end fit from (select lower(coalesce(title, '')) l from raw_jobs)) group by fit")
def _(t):
    return t("raw_jobs").groupBy(extract.seniority_fit(extract.seniority(F.col("title")), ["Entry level", "0-2 years"]).alias("fit")).agg(F.count("*").alias("n"))


@R.add("sc21_sponsorship", f"select offers, count(*) n from (select {alone_sql(extract.SPONSORS, 'l')} and not {alone_sql(extract.NO_SPONSOR, 'l')} offers from (select lower(coalesce(text, '')) l from documents)) group by offers")
def _(t):
    return t("documents").groupBy(extract.offers_sponsorship(F.col("text")).alias("offers")).agg(F.count("*").alias("n"))


_industry = "case " + " ".join(f"when {alone_sql(p, 'l')} then '{n}'" for n, p in extract.INDUSTRIES.items()) + " else 'other' end"


@R.add("sc22_industries", f"select industry, count(*) n from (select {_industry} industry from (select lower(concat_ws(' ', coalesce(title, ''), coalesce(content, ''))) l from raw_jobs)) group by industry")
def _(t):
    return t("raw_jobs").groupBy(extract.industry(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))).alias("industry")).agg(F.count("*").alias("n"))


@R.add("sc18_features", f"select row_id, list_concat(list_transform(list_filter(coalesce(categories, []), lambda x: x is not null), lambda x: 'skill:' || lower(x)), list_filter([case when level <> 'unknown' then 'level:' || level end, case when pay then 'salary:present' end], lambda x: x is not null)) tokens from (select row_id, categories, {_level_of} as level, contains(coalesce(content, ''), '$') pay from (select *, lower(coalesce(title, '')) l from raw_jobs))")
def _(t):
    skills = F.filter("categories", lambda x: x.isNotNull())
    tokens = extract.feature_tokens(skills, F.lit(None).cast("string"), extract.seniority(F.col("title")), F.contains(F.coalesce("content", F.lit("")), F.lit("$")))
    return t("raw_jobs").select("row_id", tokens.alias("tokens"))


def _fuzzy_sql(keyword: str, exact: list[str], single: bool) -> str:
    """keyword_matches() of titles in SQL."""
    words = keyword.split()
    k, bare = len(words), "".join(words)
    target = [bare[i : i + 2] for i in range(len(bare) - 1)]
    counts = ", ".join(f"least(len(list_filter(gs, lambda g: g = '{g}')), {target.count(g)})" for g in dict.fromkeys(target))
    whole = " or ".join(f"regexp_matches(title, '(?i)(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])')" for w in exact)
    tokens = f"list_filter(string_split({_no_space.format('lower(title)')}, ' '), lambda w: w <> '')"
    sizes = [1, k] if single else [k]
    union = " union all ".join(f"select row_id, array_to_string(list_slice(ts, i, i + {n} - 1), '') b from (select row_id, ts, unnest(range(1, len(ts) - {n} + 2)) i from t)" for n in dict.fromkeys(sizes))
    return f"""with t as (select row_id, {tokens} ts from raw_jobs where title is not null), w as ({union}), g as (select row_id, b, list_transform(range(1, length(b)), lambda i: substr(b, i::int, 2)) gs from w),
l as (select distinct row_id from g where b = '{bare}' or len(gs) > 0 and 2.0 * list_sum([{counts}]) / (len(gs) + {len(target)}) >= 0.7)
select row_id from raw_jobs where title is not null and ({whole}) union select row_id from l"""


@R.add("sx09_fuzzy", _fuzzy_sql("platform engineer", ["platform engineer", "infrastructure engineer"], True))
def _(t):
    return t("raw_jobs").where(keyword_matches(F.col("title"), "platform engineer", ("infrastructure engineer",), 0.7)).select("row_id")


@R.add("sx10_fuzzy_phrases", _fuzzy_sql("data scientist", ["data scientist"], False))
def _(t):
    return t("raw_jobs").where(keyword_matches(F.col("title"), "data scientist", (), 0.7, single_words=False)).select("row_id")


@R.add("sx12_categories", "select row_id, list_filter(list_filter(coalesce(categories, []), lambda x: x is not null), lambda x: contains(lower(coalesce(title, '')), lower(x))) named from raw_jobs where len(categories) > 0")
def _(t):
    low = F.lower(F.coalesce("title", F.lit("")))
    named = F.filter(F.filter("categories", lambda x: x.isNotNull()), lambda x: F.contains(low, F.lower(x)))
    return t("raw_jobs").where("size(categories) > 0").select("row_id", named.alias("named"))


@R.add("jn13_large_dictionary", "select k term, count(*) n from (select distinct row_id, k from (select row_id, lower(coalesce(content, '')) c from raw_jobs) join (select distinct lower(split_part(name, ' ', 1)) k from known_names where kind = 'org' and length(split_part(name, ' ', 1)) > 1) on contains(c, k) and regexp_matches(c, '(^|[^a-z0-9_])' || k || '($|[^a-z0-9_])')) group by k")
def _(t):
    names = t("known_names").where("kind = 'org'").select(F.lower(F.split_part("name", F.lit(" "), F.lit(1))).alias("k")).where("length(k) > 1").distinct()
    terms = [r["k"] for r in names.collect()]  # a table of fixed size
    return t("raw_jobs").select(F.explode(match_terms(F.col("content"), terms)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@R.add("sc35_bars", "with h as (select cast(floor(least(99, greatest(0, priority_score)) / 10) * 10 as bigint) bucket, count(*) n from source_registry where priority_score is not null group by 1) select bucket, n, repeat('█', case when n > 0 then greatest(1, floor(n * 20.0 / max(n) over () + 0.5)) else 0 end::int) as bar from h")
def _(t):
    bucket = (F.floor(text.clamp(F.col("priority_score"), 0.0, 99.0) / 10) * 10).alias("bucket")
    h = t("source_registry").where("priority_score is not null").groupBy(bucket).agg(F.count("*").alias("n"))
    return h.select("bucket", "n", text.bar(F.col("n"), F.max("n").over(Window.partitionBy())).alias("bar"))


@R.add("sx17_escaped", "select row_id, regexp_replace(title, '([_*\\[\\]()~`>#+\\-=|{}.!\\\\])', '\\\\\\1', 'g') title from raw_jobs")
def _(t):
    return t("raw_jobs").select("row_id", text.escape_signs(F.col("title")).alias("title"))


@R.add("sx19_slugs", f"select entity_id, unnest(list_filter(list_distinct([regexp_replace(n, '[^a-z0-9]+', '', 'g'), h, split_part(h, '-', 1)]), lambda s: s <> '')) slug from (select *, regexp_replace(regexp_replace(n, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') h from (select entity_id, lower({_firm.format('name')}) n from known_names))")
def _(t):
    return t("known_names").select("entity_id", F.explode(text.slug_variants(F.col("name"))).alias("slug"))


@R.add("sx20_message_parts", """select doc_id, unnest(range(0, len(parts)))::int as part_no, unnest(parts) part from (select doc_id, list_reduce(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: [x]),
lambda acc, x: case when length(acc[-1]) + 1 + length(x[1]) <= 120 then list_append(list_slice(acc, 1, len(acc) - 1), acc[-1] || chr(10) || x[1]) else list_append(acc, x[1]) end) parts from documents)""")
def _(t):
    return t("documents").select("doc_id", F.posexplode(text.message_parts(F.col("text"), 120)).alias("part_no", "part"))


@R.add("dt02_ages", "with m as (select max(fetched_at) m from raw_jobs), a as (select row_id, floor((epoch_us(m) - epoch_us(fetched_at)) / 60000000)::bigint x from raw_jobs, m where fetched_at is not null) select row_id, case when x < 1 then 'just now' when x < 60 then x || ' minute' || case when x = 1 then '' else 's' end || ' ago' when x < 1440 then x // 60 || ' hour' || case when x // 60 = 1 then '' else 's' end || ' ago' else x // 1440 || ' day' || case when x // 1440 = 1 then '' else 's' end || ' ago' end age from a")
def _(t):
    now = t("raw_jobs").agg(F.max("fetched_at").alias("now"))
    return t("raw_jobs").where("fetched_at is not null").select("row_id", "fetched_at").join(F.broadcast(now)).select("row_id", text.ago(F.col("fetched_at"), F.col("now")).alias("age"))


@R.add("ag17_alert_rates", "with d as (select profile_id, epoch_us(sent_at) // 86400000000 as d, count(*) n from sent_alerts where sent_at is not null group by all), r as (select profile_id, n, row_number() over (partition by profile_id order by d desc) - 1 k from d) select profile_id, round(sum(0.3 * pow(0.7, k) * n), 6) rate, count(*) as days from r group by profile_id")
def _(t):
    from ..operators.series import ema

    d = t("sent_alerts").where("sent_at is not null").groupBy("profile_id", F.floor(F.unix_micros("sent_at") / 86_400_000_000).alias("d")).agg(F.count("*").alias("n_a_day"))
    return ema(d, ["profile_id"], ["d"], "n_a_day", 0.7).select("profile_id", F.round("ema", 6).alias("rate"), F.col("n").alias("days"))
