import math
import re

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.match import match_terms
from tessera.operators.score import Rules, score

RULES = Rules(
    roles=("data engineer", "backend"), must=("python", "c++", "node.js"), should=("kafka",), nice=("go", "rust"), places=("remote",), exclude=("php",), synonyms={"go": ("golang",)},
    combinations=((("python", "kafka"), 8),), penalties=((("cobol",), -15),), least_primary=2,
)
ROWS = [
    (1, "Data Engineer (backend)", "Python, C++ and node.js with Kafka; remote. Golang, rust.", 0.9), (2, "Data Engineer", "PHP and python", None), (3, None, None, None), (4, "Plumber", "cobol remote", 0.5),
    (5, "Backend", "kafka", 0.3), (6, "Clerk", "python", None), (7, "", "asp.node.js c++x go-to", None), (7, "", "asp.node.js c++x go-to", None), (8, "Data engineer", "kafka " * 5000 + "cobol", 0.41),
]


def has(term, s):
    b = r"[a-z0-9_+.-]" if term[0] in "+.-" else r"[a-z0-9_]"
    e = r"[a-z0-9_+.-]" if term[-1] in "+.-" else r"[a-z0-9_]"
    return bool(re.search(f"(?<!{b}){re.escape(term)}(?!{e})", s.lower()))


def model(title, body, sim, r=RULES):
    title, whole = title or "", f"{title or ''} {body or ''}"
    n = lambda terms, s: sum(has(w, s) for t in terms for w in (t, *r.synonyms.get(t, ())))
    if n(r.exclude, whole):
        return 0
    up = lambda x: math.floor(x + 0.5)
    must, should, nice, roles = n(r.must, whole), n(r.should, whole), n(r.nice, whole), n(r.roles, title)
    base = up(30 * r.title_steps[min(roles, 3)]) + min(30, up((must / 3 * 0.7 + should * 0.3) * 30)) + up(nice / 2 * 20) + (10 if n(r.places, whole) else 0)
    if must + should + nice + roles == 0:
        base = up(base * 0.1)
    elif must and must + should < 2:
        base = up(base * 0.5)
    extra = (8 if has("python", whole) and has("kafka", whole) else 0) + (-15 if has("cobol", whole) and not must else 0) + (up(25 * sim) if sim and sim > 0.4 else 0)
    total = max(0, min(100, base + extra))
    return total if must else min(50, total)


def test_scores_equal_a_plain_model(spark):
    df = spark.createDataFrame(ROWS, "k long, title string, content string, score double")
    got = score(df, RULES, "title", "content", ["k"], "score").collect()
    assert sorted((r["k"], r["score"]) for r in got) == sorted((k, model(t, b, s)) for k, t, b, s in ROWS)
    assert all(0 <= r["score"] <= 100 for r in got) and {r["k"] for r in got if r["excluded"]} == {2}
    assert score(df.limit(0), RULES, "title", "content", ["k"]).count() == 0
    assert score(df, Rules(), "title", "content", ["k"]).count() == len(ROWS)  # no rules at all


def test_terms(spark):
    df = spark.createDataFrame([("Uses C++, .NET and c; not asp.net or c++x",), (None,), ("",)], "x string")
    got = [r["m"] for r in df.select(match_terms(F.col("x"), ["c++", ".net", "c", "C++"]).alias("m")).collect()]
    assert got == [["c++", ".net"], [], []]
    assert df.select(F.size(match_terms(F.col("x"), []))).first()[0] == 0


def test_message_parts_and_names(spark):
    df = spark.createDataFrame([("ab\ncd\n" + "x" * 9 + "\ne",), ("",), (None,)], "x string")
    assert [r["p"] for r in df.select(text.message_parts(F.col("x"), 5).alias("p")).collect()] == [["ab\ncd", "x" * 9, "e"], [""], [""]]
    one = spark.createDataFrame([("acme-bigCorp_x",)], "x string")
    assert one.select(text.name_of_slug(F.col("x"))).first()[0] == "Acme BigCorp X"
