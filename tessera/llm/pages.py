"""Problem 2: the posting's own lines out of whole pages, by a recurrent labeller."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists, spread, table
from .chargrid import slices
from .labeller import CONTRAST_BITS, Lines, contrast_table, line_keys, scores, train, weak_labels, words_of

#: The labeller is fitted to about so many pages, chosen by a hash, and to twice as many at most: a bound on the fit
#: alone; counts and labelling cover all rows.
SAMPLE_PAGES = 2000
#: The probability from which a line counts as the posting's.
LEAST = 0.5


def _frequencies(batches):
    """(bucket, scraped, other): the number of records of a task with a word of the bucket; and of records, in bucket -1."""
    size = 1 << CONTRAST_BITS
    counts, n = np.zeros((2, size), np.int64), [0, 0]
    for batch in batches:
        kinds = np.array(batch.column(1).to_pylist(), np.int64)
        for a, b in slices(pc.binary_length(batch.column(0)).to_pylist(), 1 << 20):
            _, ends, lo, h = words_of(batch.column(0).slice(a, b - a).to_pylist())
            own = kinds[a:b]
            text = np.searchsorted(ends, lo, "right") - 1
            seen = np.unique((text << CONTRAST_BITS) | (h >> np.uint64(64 - CONTRAST_BITS)).astype(np.int64))
            kind = own[seen >> CONTRAST_BITS]
            for k in (0, 1):
                counts[k] += np.bincount(seen[kind == k] & (size - 1), minlength=size)
                n[k] += int((own == k).sum())
    at = np.flatnonzero(counts.sum(0))
    columns = [np.append(at, -1), np.append(counts[1][at], n[1]), np.append(counts[0][at], n[0])]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bucket", "scraped", "other"])


def _marked(df: DataFrame, text_col: str, is_page: F.Column, *more: F.Column) -> DataFrame:
    rows = df.select(F.col(text_col).alias("_text"), F.coalesce(is_page, F.lit(False)).cast("long").alias("_page"), *more).where(F.trim("_text") != "")
    return spread(rows).coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)  # each task gives a table of counts, so few tasks


def contrast(df: DataFrame, text_col: str, is_page: F.Column) -> tuple[np.ndarray, int, int]:
    """The contrast table of all rows: 2 ** CONTRAST_BITS numbers, however many rows there are; and how many are pages,
    and how many are not."""
    sums = _marked(df, text_col, is_page).mapInArrow(_frequencies, "bucket long, scraped long, other long").groupBy("bucket").agg(F.sum("scraped").alias("scraped"), F.sum("other").alias("other"))
    got = sums.toPandas()
    both = np.zeros((2, 1 << CONTRAST_BITS), np.int64)
    words = got[got.bucket >= 0]
    both[0][words.bucket], both[1][words.bucket] = words.scraped, words.other
    total = got[got.bucket < 0]
    n, n_other = int(total.scraped.sum()), int(total.other.sum())
    return contrast_table(both[0], both[1], n, n_other), n, n_other


def _repeats(keys: np.ndarray):
    """(key, own, other, titles): in how many pages, and in how many other records, of a task a line with each of the
    sorted keys stands; and a bit for each of 64 hashes of the pages' titles."""

    def run(batches):
        counts, titles = np.zeros((2, len(keys)), np.int64), np.zeros(len(keys), np.uint64)
        for batch in batches:
            kinds, bits = np.array(batch.column(1).to_pylist(), np.int64), np.array(batch.column(2).to_pylist(), np.uint64)
            for a, b in slices(pc.binary_length(batch.column(0)).to_pylist(), 1 << 20):
                lines = [x.split("\n") for x in batch.column(0).slice(a, b - a).to_pylist()]
                h = line_keys([x for p in lines for x in p])
                owner = np.repeat(np.arange(b - a), [len(p) for p in lines])
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                seen = np.unique(owner[hit] * len(keys) + at[hit])
                page, key = a + seen // len(keys), seen % len(keys)
                for k in (0, 1):
                    counts[k] += np.bincount(key[kinds[page] == k], minlength=len(keys))
                own = kinds[page] == 1
                np.bitwise_or.at(titles, key[own], np.uint64(1) << bits[page[own]])
        at = np.flatnonzero(counts.sum(0))
        columns = (at, counts[1][at], counts[0][at], titles[at].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "own", "other", "titles"])

    return run


def repeats(df: DataFrame, title_col: str, text_col: str, is_page: F.Column, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In how many pages, in how many other records, and in pages of how many titles (up to 64) of all rows a line with
    each of the keys stands. The keys are sorted, and those of a bounded sample, so what comes back is bounded, too."""
    out = np.zeros((3, len(keys)), np.int64)
    if len(keys):
        rows = _marked(df, text_col, is_page, F.pmod(F.xxhash64(title_col), F.lit(64)).alias("_title"))
        counted = rows.mapInArrow(_repeats(keys), "key long, own long, other long, titles long")
        got = counted.groupBy("key").agg(F.sum("own").alias("own"), F.sum("other").alias("other"), F.bit_count(F.bit_or("titles")).alias("titles")).toPandas()
        out[0][got.key], out[1][got.key], out[2][got.key] = got.own, got.other, got.titles
    return out[0], out[1], out[2]


class Labeller:
    """A fitted model and the contrast table that it reads: some 1 MB, whatever the corpus."""

    def __init__(self, model: dict[str, np.ndarray] | None, known: np.ndarray):
        self.model, self.known = model, known

    def save(self, spark: SparkSession, path: str) -> None:
        data = io.BytesIO()
        np.savez_compressed(data, _known=self.known, **(self.model or {}))
        spark.createDataFrame([(bytearray(data.getvalue()),)], "labeller binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Labeller:
        with np.load(io.BytesIO(bytes(spark.read.parquet(path).first()[0]))) as data:
            return cls({k: data[k] for k in data.files if k != "_known"} or None, data["_known"])

    def chosen(self, lines: Lines) -> np.ndarray:
        """Which of the lines belong to the posting."""
        if self.model is None:
            return np.flatnonzero((lines.path[:, 12] == 0) & (lines.path[:, 5] < 0.9))
        return np.flatnonzero(scores(self.model, lines) >= LEAST)


def fit_labeller(df: DataFrame, is_page: F.Column, id_col: str = "row_id", title_col: str = "title", text_col: str = "content", sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """A labeller for the pages among the rows of df.

    Labels for training come from the data: how many pages, and how many records that hold a posting alone, have a line.
    They are counted over all rows for the lines of a sample of about `sample_pages` pages, which the model is fitted to.
    Without sure labels of both kinds, as with a handful of pages, there is no model."""
    known, n_pages, n_other = contrast(df, text_col, is_page)
    pages = df.where(is_page).select(F.col(title_col).alias("_title"), F.col(text_col).alias("_text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h")).where(F.trim("_text") != "")
    share = min(1.0, sample_pages / max(1, n_pages))
    sample = pages.where(F.pmod("_h", F.lit(1 << 32)) < int(share * (1 << 32)) + 1).orderBy("_h", "_text").limit(2 * sample_pages).collect()
    if not sample:
        return Labeller(None, known)
    lines = Lines([r["_text"] for r in sample], [r["_title"] for r in sample], known)
    keys, at = np.unique(line_keys(lines.text), return_inverse=True)
    own, other, titles = repeats(df, title_col, text_col, is_page, keys)
    labels = weak_labels(lines, own[at], other[at], titles[at], n_pages, n_other)
    both = (labels == 0).any() and (labels == 1).any()
    return Labeller(train(lines, labels) if both else None, known)


def main_lines(
    df: DataFrame, is_page: F.Column, id_col: str = "row_id", title_col: str = "title", text_col: str = "content", sample_pages: int = SAMPLE_PAGES, model: str | None = None
) -> DataFrame:
    """(id, line_no): the lines of pages (rows where is_page) that belong to the posting; lines count from 1 at "\\n".

    A bidirectional LSTM over each page's lines reads their form (indent, marks, position, ...) and hashed-word vectors
    and labels every line of every page. It is fitted by fit_labeller and, with `model`, kept in that folder: a later run
    loads it from there. Null, empty and blank texts and blank lines give no rows; repeated rows stay repeated; rows with
    a null id stay, with it; other columns are ignored; an empty table gives no rows. Pages alone, without records that
    hold a posting only, are labelled by what pages repeat; where even that gives no sure labels of both kinds (a handful
    of pages), lines with a copyright sign or of separators are left out and the others given. Nothing is shuffled but
    counts of words and lines.
    """
    spark = df.sparkSession
    if model and exists(spark, model):
        fitted = Labeller.load(spark, model)
    else:
        fitted = fit_labeller(df, is_page, id_col, title_col, text_col, sample_pages)
        if model:
            fitted.save(spark, model)
    sent = spark.sparkContext.broadcast(fitted)  # of fixed size
    pages = df.where(is_page).select(F.col(id_col).alias("_id"), F.col(title_col).alias("_title"), F.col(text_col).alias("_text")).where(F.trim("_text") != "")
    key = df.schema[id_col].dataType

    def run(batches):
        labeller = sent.value
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(2)).to_pylist(), 1 << 20):
                part = Lines(*(batch.column(c).slice(a, b - a).to_pylist() for c in (2, 1)), labeller.known)
                hit = labeller.chosen(part)
                own = batch.column(0).slice(a, b - a).take(pa.array(part.page[hit]))
                yield pa.RecordBatch.from_arrays([own, pa.array(part.number[hit], pa.int64())], names=[id_col, "line_no"])

    return spread(pages).mapInArrow(run, f"`{id_col}` {key.simpleString()}, line_no long")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_lines(table(spark, sf_dir, "raw_jobs"), F.col("sourcetype") == "scraper")


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
