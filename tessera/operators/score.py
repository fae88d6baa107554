"""A relevance score of 0 to 100 from several signals, as a composition of column expressions.

What counts is the caller's: lists of terms, weights, combinations and penalties come as a `Rules` value."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.text import clamp, collapse, round_half_up, sanitize
from ..session import spread
from .match import match_terms


@dataclass(frozen=True)
class Rules:
    roles: tuple[str, ...] = ()
    must: tuple[str, ...] = ()
    should: tuple[str, ...] = ()
    nice: tuple[str, ...] = ()
    places: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: {"title": 30, "skills": 30, "tech": 20, "place": 10})
    title_steps: tuple[float, ...] = (0.0, 0.6, 0.8, 1.0)
    combinations: tuple[tuple[tuple[str, ...], float], ...] = ()
    penalties: tuple[tuple[tuple[str, ...], float], ...] = ()
    least_primary: int = 1
    cap_without_must: float = 50
    #: Similarity counts from semantic_from on: weight x how far it is between semantic_base and 1.
    semantic_from: float = 0.4
    semantic_weight: float = 25
    semantic_base: float = 0.0
    #: Wished levels and years; points for a level that fits or doesn't, for years, for stated pay, and at most for terms.
    wishes: tuple[str, ...] = ()
    level_points: tuple[float, float] = (5, -8)
    year_points: tuple[float, float] = (4, -6)
    pay_points: float = 10
    term_points: float = 15

    def widened(self, terms: tuple[str, ...]) -> list[str]:
        """Terms with their synonyms."""
        return list(dict.fromkeys(w.lower() for t in terms for w in (t, *self.synonyms.get(t, ()))))

    def all_terms(self) -> list[str]:
        lists = (self.roles, self.must, self.should, self.nice, self.places, self.exclude)
        extra = [w for c, _ in (*self.combinations, *self.penalties) for w in c]
        return list(dict.fromkeys([w for x in lists for w in self.widened(x)] + [w.lower() for w in extra]))


def _hits(found: Column, terms: list[str]) -> Column:
    return F.size(F.array_intersect(found, F.array(*[F.lit(t) for t in terms]))) if terms else F.lit(0)


def score(df: DataFrame, rules: Rules, title: str, body: str, keep: list[str], similarity: str | None = None) -> DataFrame:
    """keep, score (0..100), excluded, skills and the parts of the score, one row per row of df.

    Both texts are read once by an automaton; all else is native. Excluded rows score 0. Base points come of roles in
    the title, shares of must, should and nice terms, and places; then combinations, penalties and similarity (if it
    exceeds the rules' bound) are added. Without any hit a tenth of the base is left; without must terms the score is
    capped; below the least number of primary hits the base is scaled, to a half at least. Null texts count as empty."""
    r = rules
    terms = r.all_terms()
    named = spread(df).select(*keep, *([F.col(similarity).alias("_sim")] if similarity else [F.lit(None).cast("double").alias("_sim")]), sanitize(F.col(title)).alias("_t"), sanitize(F.col(body)).alias("_b"))
    read = named.withColumn("_in_title", match_terms(F.col("_t"), terms)).withColumn("_in_text", match_terms(F.concat_ws(" ", "_t", "_b"), terms))
    text, head = F.col("_in_text"), F.col("_in_title")
    must, should, nice = (_hits(text, r.widened(x)) for x in (r.must, r.should, r.nice))
    counted = read.select(
        *keep, "_sim", "_in_text", must.alias("_must"), should.alias("_should"), nice.alias("_nice"), _hits(head, r.widened(r.roles)).alias("_roles"),
        (_hits(text, r.widened(r.places)) > 0).alias("_place"), (_hits(text, r.widened(r.exclude)) > 0).alias("excluded"),
    )
    w = r.weights
    share = lambda n, terms: F.col(n) / len(terms) if terms else F.lit(0.0)
    step = F.element_at(F.array(*[F.lit(x) for x in r.title_steps]), F.least(F.col("_roles"), F.lit(len(r.title_steps) - 1)) + 1)
    added = F.lit(0.0)
    for words, points in r.combinations:
        added = added + F.when(_hits(text, list(map(str.lower, words))) == len(set(words)), points).otherwise(0.0)
    lost = F.lit(0.0)
    for words, points in r.penalties:
        lost = lost + F.when((_hits(text, list(map(str.lower, words))) > 0) & (F.col("_must") == 0), points).otherwise(0.0)
    parts = counted.select(
        "*",
        round_half_up(step * w["title"]).alias("title_points"),
        F.least(F.lit(float(w["skills"])), round_half_up((share("_must", r.must) * 0.7 + share("_should", r.should) * 0.3) * w["skills"])).cast("long").alias("skill_points"),
        round_half_up(share("_nice", r.nice) * w["tech"]).alias("tech_points"),
        F.when(F.col("_place"), w["place"]).otherwise(0).cast("long").alias("place_points"),
        (added + lost).cast("long").alias("bonus_points"),
        F.when(F.col("_sim") > r.semantic_from, round_half_up((F.col("_sim") - r.semantic_base) / (1 - r.semantic_base) * r.semantic_weight)).otherwise(0).cast("long").alias("semantic_points"),
    )
    base = F.col("title_points") + F.col("skill_points") + F.col("tech_points") + F.col("place_points")
    primary = F.col("_must") + F.col("_should")
    no_must = (F.col("_must") == 0) & F.lit(len(r.must) > 0)
    scaled = (
        F.when((primary + F.col("_nice") == 0) & (F.col("_roles") == 0), round_half_up(base * 0.1))
        .when(no_must, base)
        .when(primary < r.least_primary, round_half_up(base * F.greatest(F.lit(0.5), primary / r.least_primary)))
        .otherwise(base)
    )
    total = clamp(scaled + F.col("bonus_points") + F.col("semantic_points"), 0, 100)
    capped = F.when(no_must, F.least(total, F.lit(r.cap_without_must))).otherwise(total)
    final = F.when(F.col("excluded"), 0).otherwise(capped).cast("long")
    scored = parts.withColumn("score", final)
    return scored.select(*keep, "score", "excluded", F.col("_in_text").alias("skills"), "title_points", "skill_points", "tech_points", "place_points", "bonus_points", "semantic_points")


def term_statistics(df: DataFrame, rules: Rules, title: str, body: str) -> DataFrame:
    """One row: the number of texts (`documents`), and for each must term that of the texts with it or a synonym among their
    tokens (f0, f1, ...)."""
    tokens = df.select(_tokens(title, body).alias("_w"))
    has = [F.count_if(F.arrays_overlap("_w", _words(rules, t))).alias(f"f{i}") for i, t in enumerate(rules.must)]
    return tokens.agg(F.count("*").alias("documents"), *has)


def _words(rules: Rules, term: str) -> Column:
    return F.array(*[F.lit(w) for w in rules.widened((term,))])


def _is_one_of(words: list[str]):
    return lambda w: w.isin(*words)


def _tokens(title: str, body: str) -> Column:
    text = F.concat_ws(" ", sanitize(F.col(title)), sanitize(F.col(body)))
    return F.filter(F.split(collapse(F.lower(text)), " "), lambda w: w != "")


def further_points(df: DataFrame, rules: Rules, title: str, body: str, keep: list[str], statistics: DataFrame | None = None) -> DataFrame:
    """keep and points beside score(): for the density of must terms (term_points), years of experience (year_points), level
    (level_points) and stated pay (pay_points), and their sum (further). Null texts count as empty.

    statistics is the one row of term_statistics, of df itself by default; it alone is sent to all tasks."""
    r = rules
    stats = term_statistics(df, rules, title, body) if statistics is None else statistics
    text = F.concat_ws(" ", sanitize(F.col(title)), sanitize(F.col(body)))
    x = df.select(*keep, text.alias("_x"), _tokens(title, body).alias("_w")).join(F.broadcast(stats))
    signal = F.lit(0.0)
    for i, term in enumerate(r.must):
        count = F.size(F.filter("_w", _is_one_of(r.widened((term,)))))
        signal = signal + F.coalesce(F.try_divide(count, F.size("_w")), F.lit(0.0)) * (F.ln((F.greatest("documents", F.lit(1)) + 1) / (F.col(f"f{i}") + 1)) + 1)
    fit = extract.seniority_fit(extract.seniority(F.col("_x")), list(r.wishes))
    years = extract.experience_points(extract.experience_years(F.col("_x")), list(r.wishes), lost=r.year_points[1], won=r.year_points[0])
    parts = x.select(
        *keep, round_half_up(F.least(F.lit(1.0), signal * 10) * r.term_points).cast("long").alias("term_points"), years.cast("long").alias("year_points"),
        F.when(fit == "match", r.level_points[0]).when(fit == "mismatch", r.level_points[1]).otherwise(0).cast("long").alias("level_points"),
        F.when(extract.salary_usd(F.col("_x")).isNotNull(), r.pay_points).otherwise(0).cast("long").alias("pay_points"),
    )
    return parts.withColumn("further", F.col("term_points") + F.col("year_points") + F.col("level_points") + F.col("pay_points"))
