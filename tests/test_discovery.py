import pytest
from pyspark.sql import functions as F

from tessera.functions import extract, maps, text
from tessera.operators.match import keyword_matches
from tessera.operators.merge import evict
from tessera.operators.series import steered
from tessera.sources import discovery
from tessera.sources.mock import mock_postings

PAGE = """<a href="/jobs/1">One post</a><a href='https://boards.greenhouse.io/acme/jobs'>x</a><A HREF = "https://www.other.example/careers/2?a=1">Two</A>
<a href="https://sub.firm.example/x">own</a><a href="https://x.com/firm">x</a><script>{"@type": "JobPosting"}</script> https://acme.recruitee.com/o"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE, "firm.example"), (2, None, None), (3, "", ""), (4, "<a href='https://'>no host</a>", None)], "k int, html string, own string")
    got = df.select("k", discovery.board_links(F.col("html")).alias("b"), discovery.job_link_count(F.col("html")).alias("n"), discovery.posting_count(F.col("html")).alias("p")).collect()
    assert got[0]["b"] == ["https://boards.greenhouse.io/acme", "https://acme.recruitee.com"] and (got[0]["n"], got[0]["p"]) == (2, 1)
    assert got[1]["b"] is None and got[2]["n"] == 0
    out = discovery.outside_links(df, "html", ["k"], ["x.com"], "own").collect()
    assert sorted((r["k"], r["domain"]) for r in out) == [(1, "boards.greenhouse.io"), (1, "other.example")]
    assert discovery.outside_links(df.limit(0), "html", ["k"]).count() == 0


def test_postings_of_a_page(spark):
    ld = '<script type="application/ld+json">{"@type":"JobPosting","title":"LD"}</script><a href="/jobs/1">Not this one</a>'
    df = spark.createDataFrame([(1, ld), (2, '<a href="/jobs/1">The link</a>'), (3, None)], "k int, html string")
    assert sorted((r["k"], r["title"]) for r in discovery.page_postings(df, "html", ["k"]).collect()) == [(1, "LD"), (2, "The link")]


def test_lists_and_payloads(spark):
    df = spark.createDataFrame([("a.ai # new\nB.AI\nplain\n\nx.tech.example\nmy-jobs.net\n",), (None,)], "t string")
    assert sorted(r["domain"] for r in discovery.listed_domains(df, "t", [], (".ai",), ("jobs",)).collect()) == ["a.ai", "b.ai", "my-jobs.net"]
    j = spark.createDataFrame([(1, '{"results":[{"home":"https://www.a.example/x","mail":"me@GMAIL.com"},{"home":null,"mail":"me@b.example"}]}'), (2, "no json"), (3, None), (4, "[]")], "k int, p string")
    assert sorted((r["k"], r["domain"]) for r in discovery.package_domains(j, "p", ["k"], ("$.results",), ("home",), ("mail",)).collect()) == [(1, "a.example"), (1, "b.example")]
    names = spark.createDataFrame([("Acme Widgets, Inc.",), ("A",), ("",), (None,)], "n string")
    assert [r[0] for r in names.select(discovery.guessed_domain(F.col("n"))).collect()] == ["acmewidgets.com", None, None, None]
    r = spark.createDataFrame([(1, '{"items":[{"link":"https://a.example/1"},{"link":null}]}'), (2, '<a href="https://b.example/">x</a><a href="https://s.example/">x</a>'), (3, None)], "k int, t string")
    assert sorted((x["k"], x["url"]) for x in discovery.result_links(r, "t", ["k"], ("s.example",)).collect()) == [(1, "https://a.example/1"), (2, "https://b.example/")]


def test_portfolios(spark):
    all_ = spark.createDataFrame([(x,) for x in "abcd"], "k string")
    chosen = lambda recent, n=2: {r["k"] for r in discovery.chosen_portfolios(all_, spark.createDataFrame([(x,) for x in recent], "k string"), "k", n).collect()}
    assert chosen("abc") == {"d"} and len(chosen("")) == 2 and len(chosen("abcd")) == 2 and chosen("a", 9) == {"b", "c", "d"}


def test_fuzzy_keywords(spark):
    rows = ["We want a Platfrom Engineer", "platform  engineer", "an infra guru", "platformengineer", None, "", "engineer of platforms"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    hit = lambda **k: {r["i"] for r in df.where(keyword_matches(F.col("t"), "platform engineer", ("infra guru",), 0.8, **k)).collect()}
    assert hit() == {0, 1, 2, 3} and hit(single_words=False) == {0, 1, 2}


@pytest.mark.parametrize("s, want", [("$80k", (80000, 80000, "$")), ("€70k-90k", (75600, 97200, "€")), ("$50/hr", (100000, 100000, "$")), ("15 lpa", (18000, 18000, "INR")), ("2+ years, $90k", None), ("hello, $90k", None), ("", None), (None, None)])
def test_salaries(spark, s, want):
    got = spark.createDataFrame([(s,)], "t string").select(extract.salary_usd(F.col("t")).alias("s")).first()["s"]
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("s, want", [("VP of sales", "lead"), ("senior dev", "senior"), ("lead dev", "senior"), ("sde 2", "mid"), ("engineer i", "junior"), ("engineer", "unknown"), (None, "unknown")])
def test_levels(spark, s, want):
    df = spark.createDataFrame([(s,)], "t string")
    assert df.select(extract.seniority(F.col("t"))).first()[0] == want


def test_points_and_features(spark):
    df = spark.createDataFrame([("2-4 years",), ("9 years",), ("none",), (None,)], "t string")
    got = [r[0] for r in df.select(extract.experience_points(extract.experience_years(F.col("t")), ["4 years"])).collect()]
    assert got == [4, -6, 0, 0]
    none = df.select(extract.feature_tokens(F.lit(None).cast("array<string>"), F.lit("unknown"), F.lit("mid"), F.lit(False)).alias("f")).first()["f"]
    assert none == ["level:mid"]


def test_maps(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}), (None, {"c": 1}), (None, None)], "x map<string,bigint>, y map<string,bigint>")
    got = [r[0] for r in df.select(maps.merged(F.col("x"), F.col("y"))).collect()]
    assert got == [{"a": 1, "b": 5}, {"c": 1}, {}]
    assert [tuple(e) for e in df.select(maps.by_count(maps.merged(F.col("x"), F.col("y")))).first()[0]] == [("b", 5), ("a", 1)]


def test_word_hash(spark):
    def model(s):
        import re

        h = 2166136261
        for i, w in enumerate([w for w in re.split("[^a-z0-9_]+", s.lower()) if len(w) > 2][:50]):
            for _ in range(3 if i < 10 else 1):
                for ch in w:
                    h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
        return h if s else 0

    texts = ["", "a b", "Senior Data Engineer at Firm", "word " * 80, "漢字 abc", "x" * 5000]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert [r["h"] for r in df.select(text.word_hash(F.col("t")).alias("h")).collect()] == [*map(model, texts), 0]


def test_evictions_and_steps(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "k int, s int")
    assert {r["k"] for r in evict(df, 8, "s > 0", [F.col("s"), F.col("k")]).collect()} == set(range(10)) - {1, 4}
    assert evict(df, 20, "s > 0", [F.col("k")]).count() == 10 and evict(df.limit(0), 1, "s > 0", [F.col("k")]).count() == 0
    scores = spark.createDataFrame([(1, 60)] * 9 + [(2, 10), (3, 10), (3, None)], "b int, x int")
    assert sorted(map(tuple, steered(scores, "b", "x").collect())) == [(1, 52), (2, 50), (3, 48)]
    assert steered(scores.limit(0), "b", "x").count() == 0


def test_mock(spark):
    rows = mock_postings(spark, 40).collect()
    assert len({r["id"] for r in rows}) == 40 and len({r["content_hash"] for r in rows}) == 36
