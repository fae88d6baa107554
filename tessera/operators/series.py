"""Runs, averages and ranks over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, keep: float) -> DataFrame:
    """The exponential average (from 0; each value weighs 1 - keep) after all rows of each key.

    It is a weighted sum over ranks from the last row, so no group is gathered in memory."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    weighed = df.where(F.col(value).isNotNull()).withColumn("_w", (1 - keep) * F.pow(F.lit(keep), F.row_number().over(w) - 1))
    return weighed.groupBy(*keys).agg(F.sum(F.col("_w") * F.col(value)).alias("ema"), F.count("*").alias("n"))


def failure_runs(df: DataFrame, keys: list[str], order: list[str], ok: Column) -> DataFrame:
    """df with `run`: the number of failures in a row up to each row, 0 at a success."""
    w = Window.partitionBy(*keys).orderBy(*order)
    islands = df.withColumn("_ok", F.coalesce(ok, F.lit(False)).cast("int")).withColumn("_island", F.sum("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "_island").orderBy(*order)
    fails = F.sum(1 - F.col("_ok")).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return islands.withColumn("run", fails.cast("long")).drop("_ok", "_island")


def ranked_statistics(df: DataFrame, keys: list[str], value: str, last: int, order: list[Column]) -> DataFrame:
    """Of the last `last` rows of each key: count, mean rounded half up, and the values at floor(n * 0.75) and
    floor(n * 0.9) of the sorted ones."""
    recent = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= last)
    w = Window.partitionBy(*keys)
    placed = recent.select(*keys, value, (F.row_number().over(w.orderBy(value, "_r")) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    at = lambda q: F.max(F.when(F.col("_i") == F.floor(F.col("_n") * q), F.col(value)))
    return placed.groupBy(*keys).agg(F.count("*").alias("n"), F.floor(F.avg(value) + 0.5).cast("long").alias("mean"), at(0.75).alias("p75"), at(0.9).alias("p90"))


def top_per_key(df: DataFrame, keys: list[str], k: int, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fan_out(scores: DataFrame, score: str, profiles: DataFrame, threshold: str, floor: int) -> DataFrame:
    """Each scored row with each profile whose threshold (or the floor, if higher) it reaches.

    Scores and thresholds are whole numbers of 0..100, so rows meet by equality: each score is joined with the at most
    101 thresholds that it reaches and these with their profiles."""
    least = F.greatest(F.coalesce(F.col(threshold), F.lit(floor)), F.lit(floor)).cast("int")
    wanted = profiles.withColumn("_least", least)
    steps = wanted.select("_least").distinct()
    reached = scores.select("*", F.explode(F.sequence(F.lit(0), F.floor(score).cast("int"))).alias("_least")).join(steps, "_least", "left_semi")
    return reached.join(wanted, "_least").drop("_least")


def steered(df: DataFrame, batch: str, score: str, start: int = 50, low: int = 30, high: int = 70, step: int = 2, most: int = 8, least: int = 1) -> DataFrame:
    """(batch, threshold): the threshold after each batch, in order: up a step if more than `most` of its scores reach the
    one before, down if fewer than `least` do, always from low to high.

    Every threshold that can occur is counted for every batch at once; what is folded in order is one short row a batch, so
    it grows with the number of batches alone."""
    steps = list(range(low, high + 1, step))
    if start not in steps:
        raise ValueError("the start must be a whole number of steps from the lowest threshold")
    counts = df.where(F.col(batch).isNotNull()).groupBy(batch).agg(F.array(*[F.count_if(F.col(score) >= s) for s in steps]).alias("n"))
    row = counts.agg(F.array_sort(F.collect_list(F.struct(F.col(batch).alias("b"), "n"))).alias("all"))
    first = F.array(F.struct(F.lit(None).cast(df.schema[batch].dataType).alias("b"), F.lit(steps.index(start)).alias("at")))

    def move(done: Column, x: Column) -> Column:
        at = F.element_at(done, -1)["at"]
        n = F.element_at(x["n"], at + 1)
        to = F.when(n > most, F.least(at + 1, F.lit(len(steps) - 1))).when(n < least, F.greatest(at - 1, F.lit(0))).otherwise(at)
        return F.concat(done, F.array(F.struct(x["b"].alias("b"), to.cast("int").alias("at"))))

    path = row.select(F.explode(F.slice(F.aggregate("all", first, move), 2, 2**31 - 2)).alias("s"))
    return path.select(F.col("s.b").alias(batch), (F.col("s.at") * step + low).alias("threshold"))
