"""Writes as pure functions from (target, changes) to the new target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add_counts(target: DataFrame, changes: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Counters of changes added to those of the target by key; keys of either side stay."""
    summed = changes.groupBy(key).agg(*[F.sum(c).alias(f"_{c}") for c in counters])
    return target.join(summed, key, "full").select(key, *[(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in counters])


def last_write(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """For each key the latest change, or what the target has."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    latest = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    kept = target.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def fill_changes(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Non-null values of changes (one row a key) over those of the target."""
    fields = [c for c in target.columns if c != key]
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in fields])
    return target.join(c, key, "full").select(key, *[F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) for x in fields])


def guarded_insert(rows: DataFrame, target: DataFrame, key: list[str], guards: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Distinct new rows whose references exist (guards: table and {column: its column}) and whose key the target lacks."""
    out = rows.dropDuplicates(key)
    for table, columns in guards:
        there = table.select(*[F.col(theirs).alias(ours) for ours, theirs in columns.items()]).distinct()
        out = out.join(there, list(columns), "left_semi")
    return out.join(target.select(*key).distinct(), key, "left_anti")


def versions(changes: DataFrame, key: str, order: str) -> DataFrame:
    """All versions of each key with version number, end of validity and whether it is the active one."""
    w = Window.partitionBy(key).orderBy(order)
    return changes.select("*", F.row_number().over(w).alias("version"), F.lead(order).over(w).alias("valid_to")).withColumn("active", F.col("valid_to").isNull())


def evict(target: DataFrame, most: int, candidates: str, order: list) -> DataFrame:
    """target without so many candidates, worst first by `order`, as it has rows above `most`. The order ends with a key, so
    that ties are none. The number is small beside the table: it is counted first, and that many are found by an ordered
    limit, which every task applies to its own rows before they meet."""
    over = max(0, target.count() - most)
    gone = target.where(candidates).orderBy(*order).limit(over).select(target.columns[0])
    return target.join(gone, target.columns[0], "left_anti")
