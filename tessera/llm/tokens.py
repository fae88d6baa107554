"""Problem 6: the whole corpus as token ids of a public tokenizer."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import spread, table
from .bpe import Encoder, load_vocabulary
from .chargrid import slices

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str | None = None):
    """A broadcast of the tokenizer's merges: a fixed file of some 600 KB, whatever the corpus."""
    return spark.sparkContext.broadcast(load_vocabulary(f"{folder or TOKENIZERS}/{name}.json"))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "byte_bpe_50k", folder: str | None = None, counts_only: bool = False) -> DataFrame:
    """id_col with `ids` (or `n_tokens`), one row per row of df.

    Null and empty texts give an empty list (0 tokens). Special tokens are ordinary text. Rows with a null id stay, with
    their ids; repeated rows stay repeated; other columns of df are ignored, so they may have any names. There is no
    shuffle: each task reads its own rows, in slices of bounded size.
    """
    vocab = vocabulary(df.sparkSession, tokenizer, folder)
    key = df.schema[id_col]
    value = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType(), False))

    def run(batches):
        encoder = Encoder(vocab.value)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for a, b in slices(lengths, 1 << 21):
                texts = texts_of(column.slice(a, b - a))
                if counts_only:
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(encoder.counts(texts), pa.int64())], names=[id_col, "n_tokens"])
                    continue
                for (lo, hi), flat, n in encoder.ids(texts):
                    ends = pa.array([0, *n.cumsum().tolist()], pa.int32())
                    kind = pa.list_(pa.field("element", pa.int32(), False))
                    yield pa.RecordBatch.from_arrays([ids.slice(a + lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()), type=kind)], names=[id_col, "ids"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, T.StructType([T.StructField(id_col, key.dataType), value]))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
