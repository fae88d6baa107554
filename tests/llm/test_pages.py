from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import labeller
from tessera.llm.pages import main_lines

BODY = ["About the role", "You keep the data lake healthy and tell the tools guild when it is not.", "We value quiet mornings and a careful tone in reviews.", "- Solid Kubernetes", "The stack is Spark and a little Go, all of it in one repository.", "Benefits:", "Interviews are short: one chat and one exercise in Rust."]
HEAD = ["Sign in", "Home > Careers", "Accept all", "This site uses cookies so that pages load faster.", "Benefits"]
FOOT = ["Similar openings", "Senior Plumber", "Follow us on social media", "Terms of use", "(c) All rights reserved."]


def rows(n=120):
    rng = np.random.default_rng(4)
    out = []
    for k in range(n):
        body = [BODY[i] for i in rng.permutation(len(BODY))[: rng.integers(3, 7)]]
        if k % 2:
            out.append((k, f"Post {k}", "\n".join(body), "rss", "x"))
        else:
            head = [HEAD[i] for i in rng.permutation(len(HEAD))[:3]]
            foot = [FOOT[i] for i in rng.permutation(len(FOOT))[:3]]
            out.append((k, f"Post {k}", "\n".join([*head, "", f"Post {k}", *body, " ", *foot]), "scraper", "x"))
    return out


def truth(text, title):
    own = set(BODY) | {title}
    lines = text.split("\n")
    at = next((i for i, x in enumerate(lines) if x == title), 0)
    return {i + 1 for i, x in enumerate(lines) if x.strip() in own and i >= at}


def test_held_out_accuracy(spark):
    data = rows()
    df = spark.createDataFrame(data, "row_id long, title string, content string, sourcetype string, line_no string")
    got: dict = {}
    for r in main_lines(df, F.col("sourcetype") == "scraper").collect():
        got.setdefault(r["row_id"], set()).add(r["line_no"])
    pages = [x for x in data if x[3] == "scraper"]
    both = sum(len(got.get(k, set()) & truth(c, t)) for k, t, c, *_ in pages)
    assert both / sum(map(len, got.values())) > 0.95
    assert both / sum(len(truth(c, t)) for _, t, c, *_ in pages) > 0.95


def test_pages_alone_are_labelled_by_what_they_repeat(spark):
    rng = np.random.default_rng(6)
    nouns = ["".join(rng.choice(list("bdfgklmnprstvz"), 6)) for _ in range(300)]
    data = []
    for k in range(150):
        body = ["You keep the " + " ".join(rng.choice(nouns, 7)) + " healthy." for _ in range(rng.integers(4, 8))]
        head, foot = ([x[i] for i in rng.permutation(len(x))[:3]] for x in ([*HEAD[:4], "Search all openings"], FOOT))
        data.append((None if k % 5 == 0 else k, f"Post {k}", "\n".join([*head, *body, *foot]), "scraper"))
    df = spark.createDataFrame(data, "row_id long, title string, content string, sourcetype string")
    got = main_lines(df, F.col("sourcetype") == "scraper").collect()
    own = sum(t.count("You keep") for _, _, t, _ in data)
    assert sum(4 <= r["line_no"] for r in got) >= 0.95 * own and len(got) <= 1.05 * own


def test_a_kept_model_labels_alike(spark, tmp_path):
    df = spark.createDataFrame(rows(), "row_id long, title string, content string, sourcetype string, line_no string")
    path = str(tmp_path / "labeller")
    first = sorted(map(tuple, main_lines(df, F.col("sourcetype") == "scraper", model=path).collect()))
    assert first == sorted(map(tuple, main_lines(df, F.col("sourcetype") == "scraper", model=path).collect())) and first


def test_edges(spark):
    schema = "row_id long, title string, content string, sourcetype string"
    df = spark.createDataFrame([(1, None, "a\n\n b ", "scraper"), (1, None, "a\n\n b ", "scraper"), (2, None, None, "scraper"), (3, "t", " \n", "scraper"), (4, "t", "x", None)], schema)
    got = sorted(map(tuple, main_lines(df, F.col("sourcetype") == "scraper").collect()))
    assert got == [(1, 1), (1, 1), (1, 3), (1, 3)]
    assert main_lines(df.limit(0), F.col("sourcetype") == "scraper").count() == 0


def test_gradients():
    """The hand-written backward pass against differences."""
    rng = np.random.default_rng(0)
    d, steps, pages = 5, 4, 3
    x = rng.normal(size=(steps, pages, d)).astype(np.float32)
    there = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], np.float32)
    w = rng.normal(0, 0.3, (d + labeller.HIDDEN, 4 * labeller.HIDDEN)).astype(np.float32)
    b = np.zeros(4 * labeller.HIDDEN, np.float32)
    up = rng.normal(size=(steps, pages, labeller.HIDDEN)).astype(np.float32)
    for back in (False, True):
        keep: list = []
        labeller._lstm(x, there, w, b, back, keep)
        dw, db, dx = labeller._lstm_back(up, x, w, keep)
        loss = lambda w_, x_: float((labeller._lstm(x_.astype(np.float32), there, w_.astype(np.float32), b, back, None) * up).sum())
        for i, j in ((0, 3), (4, 50), (d + 2, 10), (d + 9, 80)):
            e = np.zeros_like(w, dtype=np.float64)
            e[i, j] = 1e-2
            assert abs((loss(w + e, x) - loss(w - e, x)) / 2e-2 - dw[i, j]) < 2e-2
        e = np.zeros_like(x, dtype=np.float64)
        e[1, 1, 2] = 1e-2
        assert abs((loss(w, x + e) - loss(w, x - e)) / 2e-2 - dx[1, 1, 2]) < 2e-2


@pytest.mark.skipif(not Path("/root/testdata/sf0.001/raw_jobs.parquet").exists(), reason="no test tables")
def test_weak_labels_are_met_on_pages_not_trained_on(spark):
    import pandas as pd

    from tessera.llm.pages import contrast, repeats

    df = spark.read.parquet("/root/testdata/sf0.01/raw_jobs.parquet")
    table, n, n_other = contrast(df, "content", F.col("sourcetype") == "scraper")
    pages = df.where("sourcetype = 'scraper' and trim(content) <> ''").select("title", "content").orderBy("row_id").toPandas()
    assert n == len(pages)
    half = len(pages) // 2
    make = lambda p: labeller.Lines(p.content.tolist(), p.title.where(pd.notna(p.title), None).tolist(), table)
    first, second = make(pages[:half]), make(pages[half:])

    def labels(lines):
        keys, at = np.unique(labeller.line_keys(lines.text), return_inverse=True)
        own, other, titles = repeats(df, "title", "content", F.col("sourcetype") == "scraper", keys)
        return labeller.weak_labels(lines, own[at], other[at], titles[at], n, n_other)

    model = labeller.train(first, labels(first))
    want = labels(second)
    sure = want >= 0
    assert ((labeller.scores(model, second) >= 0.5) == want)[sure].mean() > 0.98
