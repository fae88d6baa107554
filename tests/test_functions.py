import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import extract, text, vector
from tessera.sources import boards


def one(spark, column, *values, names=("x", "y")):
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n, _ in zip(names, values)))
    return df.select(column.alias("v")).first()["v"]


def model_lossy(s):
    h = 0x811C9DC5
    raw = s.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h ^= raw[i] | raw[i + 1] << 8
        signed = h - (1 << 32) if h >= 1 << 31 else h
        h = int(float(signed) * 16777619.0) % (1 << 32)
    return f"{h:08x}"


def test_hashes_equal_a_plain_model(spark):
    rng = random.Random(3)
    texts = ["", "a", "acme::react dev", "é😀", *("".join(rng.choice("abc é😀ß漢") for _ in range(rng.randrange(600))) for _ in range(40))]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "x string")
    got = {r["x"]: r["h"] for r in df.select("x", text.lossy_fnv(F.col("x")).alias("h")).collect()}
    assert got == {t: model_lossy(t) for t in texts} | {None: None}
    assert got[""] == "811c9dc5"
    exact = df.where("x = 'a'").select(text.fnv1a32(F.col("x")).alias("h")).first()["h"]
    assert exact == 0xE40C292C


@pytest.mark.parametrize("a, want", [("&amp;lt;p&gt; a <b>c</b>", "<p> a c"), (None, ""), ("", ""), ("a  b", "a b")])
def test_sanitize(spark, a, want):
    assert one(spark, text.sanitize(F.col("x")), a) == want


def test_names(spark):
    for a, want in (("Acme, Inc.", "Acme"), ("Foo GmbH", "Foo"), ("Acme Incident", "Acme Incident"), (None, "")):
        assert one(spark, text.normal_company(F.col("x")), a) == want
    assert one(spark, text.normal_title(F.col("x")), "🔥 Dev (m/w/d) [remote]") == "Dev"


def test_dice_is_a_multiset_coefficient(spark):
    def model(a, b):
        from collections import Counter

        a, b = "".join(a.lower().split()), "".join(b.lower().split())
        if a == b:
            return 1.0
        if min(len(a), len(b)) < 2:
            return 0.0
        x, y = Counter(map("".join, zip(a, a[1:]))), Counter(map("".join, zip(b, b[1:])))
        return 2 * sum((x & y).values()) / (len(a) + len(b) - 2)

    for a, b in (("night", "nacht"), ("aaaa", "aa"), ("a", "b"), ("A b", "ab"), ("banana", "bananas"), ("", "")):
        assert one(spark, text.dice(F.col("x"), F.col("y")), a, b) == pytest.approx(model(a, b))


def model_chunks(s, most=200, overlap=40):
    s = " ".join(s.split())
    if len(s) <= most:
        return [s] if s else []
    out, i = [], 0
    while i < len(s):
        end = i + most
        if end < len(s):
            space = s.rfind(" ", 0, end + 1)
            if space > i + overlap:
                end = space
        else:
            end = len(s)
        if s[i:end].strip():
            out.append(s[i:end].strip())
        before = i
        i = end - overlap
        if i <= before:
            i = end
    return out


@pytest.mark.parametrize("s", ["", "x" * 199, "x" * 200, "x" * 201, "y" * 800, "word " * 150, "a bb ccc " * 70, None])
def test_chunks(spark, s):
    assert one(spark, text.chunks(F.col("x")), s) == model_chunks(s or "")


def test_extraction(spark):
    for s, want in (("2-5 years", (2, 5)), ("3+ years", (3, None)), ("none", None)):
        got = one(spark, extract.experience_years(F.col("x")), s)
        assert (tuple(got) if got else None) == want
    for s, want in (("hybrid remote", "hybrid"), ("no remote", "onsite"), ("fully remote", "remote"), ("wfh", "remote"), ("", "unknown"), (None, "unknown")):
        assert one(spark, extract.work_arrangement(F.col("x")), s) == want
    for s, want in (("VP", "lead"), ("senior dev", "senior"), ("sde 2", "mid"), ("intern", "junior"), (None, "unknown")):
        assert one(spark, extract.seniority(F.col("x")), s) == want


def test_keywords_stand_alone(spark):
    found = extract.matched_keywords(F.col("x"), ["typescript", ".net", "c#", "c", "go"])
    assert one(spark, found, "TypeScript. asp.net C# typescripts go-to") == ["typescript", "c#", "go"]
    assert one(spark, found, "use .NET!") == [".net"]
    assert one(spark, found, None) == []


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([], []), ([0.0], [1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r["s"] for r in df.select(F.round(vector.cosine(F.col("a"), F.col("b")), 4).alias("s")).collect()]
    assert got == [0.7071, 0.0, 0.0, 0.0, 0.0]


PAYLOADS = {
    "greenhouse": '{"jobs":[{"id":1,"title":"A","absolute_url":"u","content":"<p>c</p>","updated_at":"d","departments":[{"name":"Eng"}],"location":{"name":"Rome"}}]}',
    "lever": '[{"id":"1","text":"A","hostedUrl":"u","descriptionPlain":"c","createdAt":0,"categories":{"team":"Eng"}}]',
    "ashby": '{"data":{"jobBoard":{"jobPostings":[{"id":"1","title":"A","externalLink":"u","isRemote":true}]}}}',
    "workable": '{"results":[{"title":"A","url":"u","location":{"city":"Rome","remote":true}}]}',
    "smartrecruiters": '{"results":[{"name":"A","ref":"u","company":{"name":"Firm"}}]}',
    "recruitee": '{"offers":[{"title":"A","careers_url":"u","city":"Rome"}]}',
    "workday": '{"jobPostings":[{"title":"A","externalPath":"u","bulletFields":["R1"]}]}',
    "breezy": '[{"name":"A","url":"u","type":{"name":"Full"}}]',
    "rippling": '{"jobs":[{"name":"A","url":"u"}]}',
    "dover": '{"data":[{"title":"A","apply_url":"u","remote":true}]}',
    "pinpoint": '{"data":[{"title":"A","url":"u","department":{"name":"Eng"}}]}',
    "freshteam": '{"job_postings":[{"title":"A","url":"u","branch":{"name":"Rome"}}]}',
    "jobvite": '{"requisitions":[{"title":"A","detail_url":"u","category":"Eng"}]}',
}


@pytest.mark.parametrize("kind", PAYLOADS)
def test_boards(spark, kind):
    df = spark.createDataFrame([(1, PAYLOADS[kind]), (2, "no json"), (3, None), (4, "{}"), (5, "[]")], "k long, p string")
    (row,) = boards.board_records(df, "p", kind, ["k"]).collect()
    assert (row["k"], row["title"], row["link"]) == (1, "A", "u")
    want = {"greenhouse": ["Eng", "Rome"], "lever": ["Eng"], "ashby": ["Remote"], "workable": ["Rome", "Remote"], "workday": ["R1"], "breezy": ["Full"], "recruitee": ["Rome"]}
    if kind in want:
        assert row["categories"] == want[kind]
    if kind == "lever":
        assert row["published"] == "1970-01-01T00:00:00.000Z"


def test_texts_of_every_kind_are_cut(spark, tmp_path):
    from tessera.plans import inventory, scoring, texts

    lines = [f"line {i} of https://site{i}.example/x " + "w" * (i % 80) for i in range(900)]
    docs = [(1, "alert", "short"), (2, "digest", "\n".join(lines)), (3, "attachment", "word " * 300), (4, None, None)]
    spark.createDataFrame(docs, "doc_id long, doc_kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in texts.QUERIES["sx14_chunks"](spark, str(tmp_path)).orderBy("doc_id", "chunk_no").collect()]
    assert got == [(d, n, c) for d, _, s in docs for n, c in enumerate(model_chunks(s or ""))]
    parts = [r["part"] for r in scoring.QUERIES["sx20_message_parts"](spark, str(tmp_path)).where("doc_id = 2").orderBy("part_no").collect()]
    assert "\n".join(parts) == docs[1][2] and all(len(p) <= 120 for p in parts)
    assert all(len(a) + 1 + len(b.split("\n")[0]) > 120 for a, b in zip(parts, parts[1:]))
    assert inventory.QUERIES["sx24_all_named_domains"](spark, str(tmp_path)).count() == 900
