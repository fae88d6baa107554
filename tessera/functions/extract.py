"""Facts read from texts by patterns, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of work arrangement (fixed values): hybrid first, then remote unless negated, then on site.
HYBRID = r"(?<![a-z0-9_])(?:hybrid|\d+\s+days?\s+(?:in|from)\s+office)(?![a-z0-9_])"
REMOTE = r"(?<![a-z0-9_])(?:fully\s+remote|100%\s+remote|remote[-\s]?first|work\s+from\s+(?:home|anywhere)|wfh|distributed)(?![a-z0-9_])"
NO_REMOTE = r"(?<![a-z0-9_])(?:no\s+remote|remote\s+not)(?![a-z0-9_])"
ON_SITE = r"(?<![a-z0-9_])(?:on[-\s]?site|in[-\s]?office|in[-\s]?person|no\s+remote)(?![a-z0-9_])"
#: Levels and their words, the first that matches counts (fixed values).
LEVELS = (
    ("lead", r"vp|vice president|director|c[tse]o|head of engineering|chief"), ("senior", r"staff|principal|lead|senior|sr|expert|architect"),
    ("mid", r"mid[- ]?level|intermediate|associate|sde[-\s]?2|ii|level\s*2"), ("junior", r"junior|jr|entry[- ]?level|graduate|trainee|intern|sde[-\s]?1|i|fresh(?:er)?|0[- ]?(?:to|-)?\s*[12]\s*year"),
)
#: Years of experience: a range, else a single figure (fixed values).
YEAR_RANGE, YEAR_SINGLE = r"(?i)([1-9]\d?)\s*(?:[-–to]+)\s*([1-9]\d?)\s+years?", r"(?i)(?:at\s+least\s+|minimum\s+|min\.?\s+)?([1-9]\d?)\+?\s+years?"
#: Techniques and the words for them, in the order in which they are given (fixed values).
TECHNIQUES = {
    "JavaScript": "javascript|js|es6|ecmascript", "TypeScript": "typescript|ts", "Python": "python", "Go": "golang|go", "Rust": "rust", "Java": "java", "Ruby": "ruby", "PHP": "php",
    "React": r"react\.?js|reactjs|react", "Next.js": r"next\.?js", "Vue": r"vue\.?js", "Angular": "angular", "Node.js": r"node\.?js", "NestJS": r"nest\.?js", "Express": r"express\.?js", "GraphQL": "graphql", "tRPC": "trpc",
    "PostgreSQL": "postgresql|postgres|psql", "MongoDB": "mongodb|mongoose", "MySQL": "mysql", "Redis": "redis", "Prisma": "prisma", "AWS": "aws|amazon web services", "GCP": "gcp|google cloud", "Azure": "azure",
    "Docker": "docker", "Kubernetes": "kubernetes|k8s", "Terraform": "terraform", "Jest": "jest", "Cypress": "cypress", "GitHub Actions": "github actions", "TailwindCSS": "tailwind|tailwindcss",
}
#: Sponsorship offered, and refused (fixed values).
SPONSORS = r"visa sponsorship|h[- ]?1b|work authorization provided|we sponsor|sponsoring visas|sponsorship available"
NO_SPONSOR = r"no visa|cannot sponsor|not able to sponsor|unable to sponsor|must be authorized|us citizen only|citizen or permanent resident"
#: Industries, the first that matches counts (fixed values).
INDUSTRIES = {
    "ai_ml": "machine learning|deep learning|llm|large language model|nlp|computer vision|mlops|ai engineer|artificial intelligence", "web3": "blockchain|web3|defi|nft|smart contract|solidity|ethereum|crypto",
    "fintech": "fintech|payments|banking|lending|insurtech|trading|financial technology", "healthtech": "healthtech|health tech|medtech|telemedicine|ehr|fhir|clinical|patient data",
    "edtech": "edtech|ed-tech|e-learning|learning management|lms|online education", "devtools": "developer tools|devtools|sdk|api platform|cli|open.?source|oss",
    "ecommerce": "ecommerce|e-commerce|shopify|marketplace|retail tech|checkout", "saas": "saas|b2b software|enterprise software|platform",
    "infra": "infrastructure|platform engineering|cloud native|devops|site reliability|sre", "security": "cybersecurity|infosec|appsec|zero trust|soc analyst|penetration testing",
}
#: Wishes that mean a junior or a middle level (fixed values).
WANTS_JUNIOR, WANTS_MID = r"junior|entry|fresher|intern|sde\s*1|0[-–\s]?[12]\s*y(?:ea)?r", r"mid|associate|intermediate|sde\s*2|[23][-–\s]?[45]\s*y(?:ea)?r"
#: A figure of pay, and one in lakhs (fixed values).
LAKHS = r"(?i)([\d.]+)\s*[-–to]*\s*([\d.]+)?\s*(?:lpa|lakhs?\s+per\s+annum)"
MONEY = r"(?i)([$€£]?)\s*([\d,]+(?:\.\d+)?)(k?)(?:\s*[-–to]+\s*[$€£]?\s*([\d,]+(?:\.\d+)?)(k?))?\s*(usd|eur|gbp|per\s+year|/yr|p\.?a\.?|annually|/hr|per\s+hour|/mo|/month|per\s+month|/wk|/week|per\s+week)?"


def alone(text: Column, pattern: str) -> Column:
    """Whether the pattern stands in a lower-cased text with no letter, digit or underscore of ASCII beside it."""
    return text.rlike(rf"(?<![a-z0-9_])(?:{pattern})(?![a-z0-9_])")


def experience_years(text: Column) -> Column:
    """struct(min, max): years from a range or a single figure; null if there is none, max null for a single figure."""
    pair, single = YEAR_RANGE, YEAR_SINGLE
    low, high, one = F.regexp_extract(text, pair, 1), F.regexp_extract(text, pair, 2), F.regexp_extract(text, single, 1)
    number = lambda x: F.when(x != "", x).try_cast("int")
    return F.when(low != "", F.struct(number(low).alias("min"), number(high).alias("max"))).when(one != "", F.struct(number(one).alias("min"), F.lit(None).cast("int").alias("max")))


def work_arrangement(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.rlike(HYBRID), "hybrid")
        .when(t.rlike(REMOTE), "remote")
        .when(t.contains("remote") & t.rlike("(?<![a-z0-9_])remote(?![a-z0-9_])") & ~t.rlike(NO_REMOTE), "remote")
        .when(t.rlike(ON_SITE), "onsite").otherwise("unknown")
    )


def seniority(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("unknown")
    for name, pattern in reversed(LEVELS):
        out = F.when(alone(t, pattern), name).otherwise(out)
    return out


def seniority_fit(level: Column, wanted: list[str]) -> Column:
    """match, mismatch or neutral: a posting's level against the wished ones, which are read when the plan is made."""
    import re

    junior, mid = (any(re.search(p, w, re.I) for w in wanted) for p in (WANTS_JUNIOR, WANTS_MID))
    of = {"lead": "mismatch", "junior": "match" if junior else "neutral" if mid else "mismatch", "mid": "match" if junior or mid else "neutral", "senior": "mismatch" if junior or mid else "neutral"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[level], F.lit("neutral"))


def experience_points(years: Column, wanted: list[str], least: int = 3, lost: int = -6, won: int = 4) -> Column:
    """Points for experience_years: `lost` if the post asks for more than a year beyond the wished most, `won` if all of its
    range is within it, else 0. The wished most is `least` or a larger number of years among the wishes."""
    import re

    most = max([least, *(int(m[1]) for w in wanted if (m := re.search(r"(\d+)\+?\s*(?:yr|year)", w, re.I)))])
    return F.when(years.isNull(), 0).when(years["min"] > most + 1, lost).when(F.coalesce(years["max"], years["min"]) <= most, won).otherwise(0)


def techniques(text: Column) -> Column:
    """The names of TECHNIQUES that a text speaks of, in their order."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(alone(t, p), name) for name, p in TECHNIQUES.items()]))


def offers_sponsorship(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return alone(t, SPONSORS) & ~alone(t, NO_SPONSOR)


def industry(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("other")
    for name, pattern in reversed(INDUSTRIES.items()):
        out = F.when(alone(t, pattern), name).otherwise(out)
    return out


def salary_usd(text: Column) -> Column:
    """struct(low, high, currency): yearly pay in USD by the first figure of a text; null without one, or where it makes no
    yearly pay of 10,000 to 1,500,000. A period that isn't stated is guessed from the amount; lakhs count 1,200."""
    part = lambda p, i: F.regexp_extract(text, p, i)
    n = lambda x: F.regexp_replace(x, ",", "").try_cast("double")
    round_ = lambda x: F.floor(x + 0.5).cast("long")
    read = F.struct(*[F.lower(part(MONEY, i)).alias(k) for i, k in enumerate(("sign", "low", "k1", "high", "k2", "period"), 1)], part(LAKHS, 1).alias("l1"), part(LAKHS, 2).alias("l2"))

    def amounts(g: Column) -> Column:
        low = n(g["low"]) * F.when(g["k1"] != "", 1000).otherwise(1)
        high = F.coalesce(n(g["high"]) * F.when(g["k2"] != "", 1000).otherwise(1), low)
        currency = F.when(g["sign"] != "", g["sign"]).otherwise("$")
        rate = F.when(currency == "€", 1.08).when(currency == "£", 1.27).otherwise(1.0)
        return F.struct(low.alias("low"), high.alias("high"), currency.alias("currency"), rate.alias("rate"), g["period"].alias("period"), n(g["l1"]).alias("l1"), n(g["l2"]).alias("l2"))

    def yearly(m: Column) -> Column:
        stated = F.when(m["period"].contains("hr") | m["period"].contains("hour"), 2000).when(m["period"].contains("mo"), 12).when(m["period"].contains("wk") | m["period"].contains("week"), 50)
        times = stated.when((m["high"] > 0) & (m["high"] < 300), 2000).when((m["high"] >= 300) & (m["high"] < 4000), 50).when((m["high"] >= 4000) & (m["high"] <= 15000), 12).otherwise(1)
        return F.struct(m.alias("m"), times.alias("times"))

    def pay(y: Column) -> Column:
        m, times = y["m"], y["times"]
        by_lakhs = F.struct(round_(m["l1"] * 1200).alias("low"), round_(F.coalesce(m["l2"], m["l1"]) * 1200).alias("high"), F.lit("INR").alias("currency"))
        money = F.struct(round_(m["low"] * times * m["rate"]).alias("low"), round_(m["high"] * times * m["rate"]).alias("high"), m["currency"].alias("currency"))
        return F.when(m["l1"].isNotNull(), by_lakhs).when((m["high"] * times >= 10000) & (m["low"] * times <= 1500000), money)

    # Each step is taken once for the next, as the element of an array of one.
    steps = F.array(read)
    for f in (amounts, yearly, pay):
        steps = F.transform(steps, f)
    return F.when(text.isNotNull(), steps[0])


def feature_tokens(skills: Column, arrangement: Column, level: Column, paid: Column) -> Column:
    """What is learnt from: skill:, remote: and level: with their values, and salary:present."""
    tag = lambda name, x: F.when(x.isNotNull() & (x != "unknown"), F.concat(F.lit(f"{name}:"), x))
    more = F.array_compact(F.array(tag("remote", arrangement), tag("level", level), F.when(paid, "salary:present")))
    return F.concat(F.transform(F.coalesce(skills, F.array().cast("array<string>")), lambda s: F.concat(F.lit("skill:"), F.lower(s))), more)


def keyword_pattern(keyword: str) -> str:
    """A keyword as a whole: its neighbours are no letters or digits, nor signs such as it begins or ends with itself."""
    import re

    k = keyword.lower()
    before = "[A-Za-z0-9_+.-]" if k[0] in "+.-" else "[A-Za-z0-9_]"
    after = "[A-Za-z0-9_+.-]" if k[-1] in "+.-" else "[A-Za-z0-9_]"
    return f"(?<!{before}){re.escape(k)}(?!{after})"


def matched_keywords(text: Column, keywords: list[str]) -> Column:
    """The keywords (of two characters or more) in the text, in order of their first place, longer ones first."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(t.rlike(keyword_pattern(k)), F.struct((F.regexp_instr(t, F.lit(keyword_pattern(k))) + len(k)).alias("at"), F.lit(-len(k)).alias("size"), F.lit(k).alias("k"))) for k in keywords if len(k) > 1]
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda x: x["k"])


def tf_idf(tokens: Column, term: str, documents: Column, frequency: Column) -> Column:
    """Share of the term among tokens times its smoothed inverse document frequency."""
    count = F.size(F.filter(tokens, lambda t: t == term))
    return F.try_divide(count, F.size(tokens)) * (F.ln((F.greatest(documents, F.lit(1)) + 1) / (frequency + 1)) + 1)
