"""Searches over hashes and vectors that compare all pairs that can count."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Vectors, and queries, of one block.
BLOCK = 1024


def near_hashes(df: DataFrame, id_col: str, hash_col: str, most: int = 5) -> DataFrame:
    """(a, b, d), a < b: all pairs of 32-bit hashes that differ in at most `most` bits.

    The bits are cut into most + 1 bands: of these a pair has at least one in common."""
    cuts = [round(k * 32 / (most + 1)) for k in range(most + 2)]
    band = lambda k: F.shiftright(F.col("h"), cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))
    bands = F.array(*[F.struct(F.lit(k).alias("no"), band(k).alias("bits")) for k in range(most + 1)])
    h = df.select(F.col(id_col).alias("id"), F.col(hash_col).cast("long").alias("h")).select("id", "h", F.explode(bands).alias("band"))
    a, b = h.select(F.col("id").alias("a"), "h", "band"), h.select(F.col("id").alias("b"), F.col("h").alias("g"), "band")
    return a.join(b, "band").where("a < b").select("a", "b", text.hamming(F.col("h"), F.col("g")).alias("d")).where(F.col("d") <= most).distinct()


def _compare(k: int | None, least: float | None):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                q, e = (batch.column(i)[row].values for i in (0, 1))
                ids = [x.field(0).to_numpy() for x in (q, e)]
                vectors = [[np.asarray(v.values, np.float64) if v.is_valid else np.zeros(0) for v in x.field(1)] for x in (q, e)]
                labels = e.field(2).to_numpy(zero_copy_only=False)
                for size in {len(v) for v in vectors[0]} - {0}:
                    at = [np.array([i for i, v in enumerate(x) if len(v) == size], np.int64) for x in vectors]
                    if len(at[1]):
                        m = [np.stack([x[i] for i in own]) for x, own in zip(vectors, at)]
                        length = [np.sqrt((x * x).sum(1)) for x in m]
                        both = length[0][:, None] * length[1]
                        sim = np.round(np.divide(m[0] @ m[1].T, both, out=np.zeros_like(both), where=both > 0), 6)
                        yield from _kept(ids[0][at[0]], ids[1][at[1]], labels[at[1]], sim, k, least)

    return run


def _kept(query, vec, label, sim, k, least):
    if least is not None:
        i, j = np.nonzero((sim >= least) & (query[:, None] < vec))
    else:
        i, j = [], []
        for g in np.unique(label):
            own = np.flatnonzero(label == g)
            for x in range(len(query)):
                best = own[np.lexsort((vec[own], -sim[x, own]))[:k]]
                i += [x] * len(best)
                j += best.tolist()
        i, j = np.array(i, np.int64), np.array(j, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query[i], vec[j], label[j].astype(np.int64), sim[i, j])], names=["query", "vec_id", "label", "sim"])


def compared(vectors: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """(query, vec_id, label, sim): cosines, to six digits, of queries (vec_id, embedding) and vectors (vec_id, embedding,
    label), blocks of both against each other. With `least` the pairs query < vec_id of at least so much; else for each
    query, label and block the k best. Vectors of different lengths aren't compared."""
    many = [max(1, math.ceil(x.count() / BLOCK)) for x in (queries, vectors)]

    def blocks(df, n, name, *more):
        item = F.struct(F.col("vec_id").cast("long").alias("vec_id"), "embedding", *more)
        return df.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block")).agg(F.collect_list(item).alias(name))

    q = blocks(queries, many[0], "q").select("q", F.explode(F.sequence(F.lit(0), F.lit(many[1] - 1)).cast("array<long>")).alias("block"))
    e = blocks(vectors, many[1], "e", F.col("label").cast("long").alias("label"))
    return q.join(e, "block").select("q", "e").mapInArrow(_compare(k, least), "query long, vec_id long, label long, sim double")
