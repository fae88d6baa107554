from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources import feeds

RSS = """<rss><channel><item><title><![CDATA[A &amp; B]]></title><link>https://x.example/1</link><guid>g1</guid><dc:date>2024</dc:date>
<description>one</description><content:encoded><![CDATA[<p>two</p>]]></content:encoded><category>c1</category><category><![CDATA[c2]]></category></item>
<ITEM><title></title><guid>https://x.example/2</guid></ITEM></channel></rss>"""
ATOM = '<feed><entry><title>T</title><link rel="a" href="https://x.example/3"/><id>i</id><updated>u</updated><author><name>N</name></author><summary>s</summary></entry></feed>'


def test_feeds(spark):
    df = spark.createDataFrame([(1, RSS), (2, ATOM), (3, None), (4, ""), (5, "<rss/>")], "k long, xml string")
    rows = {(r["k"], r["position"]): r for r in feeds.feed_items(df, "xml", ["k"]).collect()}
    assert sorted(rows) == [(1, 0), (1, 1), (2, 0)]
    a, b, c = rows[1, 0], rows[1, 1], rows[2, 0]
    assert (a["title"], a["link"], a["guid"], a["published"], a["content"], a["categories"]) == ("A & B", "https://x.example/1", "g1", "2024", "one two", ["c1", "c2"])
    assert (b["title"], b["link"], b["guid"]) == ("", "https://x.example/2", "https://x.example/2")
    assert (c["link"], c["guid"], c["published"], c["creator"], c["content"]) == ("https://x.example/3", "i", "u", "N", "s")


def test_json_lines(spark):
    df = spark.createDataFrame([(1, '{"id":1,"t":"a"}\r\nbroken {\n{"id":2}\n'), (2, None)], "k long, x string")
    got = [(r["line_no"], r["id"], r["t"]) for r in feeds.json_lines(df, "x", ["k"], "id long, t string").collect()]
    assert got == [(0, 1, "a"), (2, 2, None)]


def test_relative_links(spark):
    df = spark.createDataFrame([(1, "https://x.example/careers?q=1", '<a href="/jobs/1">Engineer one</a><a href="jobs/2">Engineer two</a>')], "k long, u string, h string")
    assert sorted(r["url"] for r in feeds.job_links(df, "h", ["k"], "u").collect()) == ["https://x.example/jobs/1", "https://x.example/jobs/2"]


def test_hash31(spark):
    def model(s):
        h = 0
        raw = s.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = (h * 31 + (raw[i] | raw[i + 1] << 8)) & 0xFFFFFFFF
        h = abs(h - (1 << 32) if h >= 1 << 31 else h)
        out = ""
        while True:
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
            if not h:
                return out

    texts = ["", "a", "acme", "漢字🔥", "x" * 300]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "x string")
    assert {r["x"]: r["h"] for r in df.select("x", text.times31(F.col("x")).alias("h")).collect()} == {t: model(t) for t in texts} | {None: None}
