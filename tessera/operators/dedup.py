"""Exact duplicates: first rows, ordered layers of keys, inserts that skip what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order` (which should leave no ties); nulls are a key like others."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def layered_dedup(df: DataFrame, layers: list[str], position: str) -> DataFrame:
    """df with `dropped_by`: null for kept rows, else the first layer in which an earlier kept row has the same key.

    Rows are taken in order of `position` (unique); a row is dropped if a kept row before it shares a key of a layer,
    and dropped rows take no part. Null keys never match. Each round settles all rows that are first among the open ones
    in every layer, and then those that share a key with a kept row, so nothing runs row by row; rounds end when no row
    is open."""

    def clashes(rows: DataFrame, kept: DataFrame) -> DataFrame:
        """The first layer of each row in which a kept row before it has the same key."""
        flags = []
        for i, layer in enumerate(layers):
            seen = kept.where(F.col(layer).isNotNull()).groupBy(layer).agg(F.min(position).alias(f"_p{i}"))
            rows = rows.join(seen, layer, "left")
            flags.append(F.when(F.col(f"_p{i}") < F.col(position), layer))
        return rows.withColumn("dropped_by", F.coalesce(*flags)).select(position, *layers, "dropped_by")

    every = written(df.select(position, *layers), "layered")
    open_rows, kept = every, None
    while not open_rows.isEmpty():
        first, marked = F.lit(True), open_rows
        for i, layer in enumerate(layers):  # by joins, so that a key of many rows can be split
            least = open_rows.where(F.col(layer).isNotNull()).groupBy(layer).agg(F.min(position).alias(f"_m{i}"))
            marked = marked.join(least, layer, "left")
            first = first & (F.col(layer).isNull() | (F.col(f"_m{i}") == F.col(position)))
        marked = marked.select(position, *layers, first.alias("_first"))
        keep = written(marked.where("_first").drop("_first"), "kept")
        kept = keep if kept is None else kept.unionByName(keep)
        open_rows = written(clashes(marked.where("not _first").drop("_first"), keep).where("dropped_by is null").drop("dropped_by"), "open")
    if kept is None:
        return df.withColumn("dropped_by", F.lit(None).cast("string"))
    rest = every.join(kept.select(position), position, "left_anti")
    settled = kept.select(position, F.lit(None).cast("string").alias("dropped_by")).unionByName(clashes(rest, kept).select(position, "dropped_by"))
    return df.join(settled, position)


def insert_or_ignore(rows: DataFrame, target: DataFrame, unique: list[str], position: str) -> DataFrame:
    """The rows that an insert ignoring conflicts would add: first of each unique key in turn, and none that the target
    has. A null key conflicts with nothing."""
    out = rows
    for key in unique:
        has, none = out.where(F.col(key).isNotNull()), out.where(F.col(key).isNull())
        fresh = first_wins(has, [key], [F.col(position)]).join(target.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
        out = fresh.unionByName(none)
    return out
