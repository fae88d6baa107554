"""Streams of events: counts by day, trailing windows, keys seen before, runs of failures, a steered threshold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(events: DataFrame, time: str, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """Rows a day and key; a day is final once events are `lateness` past it."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, "1 day").alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), *keys, "n")


def trailing_counts(events: DataFrame, time: str, keys: list[str], span: str = "7 days", step: str = "1 day", lateness: str = "1 day") -> DataFrame:
    return events.withWatermark(time, lateness).groupBy(F.window(time, span, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.end").alias("until"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, time: str, keys: list[str], within: str = "7 days") -> DataFrame:
    """The first event of each key; a key is forgotten `within` after it was seen."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def breaker(events: DataFrame, key: str, time: str, ok: str, opens_at: int = 5, closes_after: str | None = None, forget_after: str | None = None) -> DataFrame:
    """(key, at, run, open): the run of failures after each event, and whether the circuit is open.

    The circuit opens at a run of `opens_at`. With closes_after (as "30 minutes") it closes by itself so long after the
    failure that opened it: the next event starts a new run. With forget_after the state of a key goes that long after its
    last event, as far as the watermark tells. The state is two numbers; events of a batch are taken in order of time."""
    span = pd.Timedelta(closes_after).value // 1000 if closes_after else None
    keep = pd.Timedelta(forget_after).value // 1_000_000 if forget_after else 0

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        run, opened = state.get if state.exists else (0, None)
        parts = [pdf.sort_values(time, kind="stable") for pdf in batches if len(pdf)]
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts).sort_values(time, kind="stable")
        at, runs = pdf[time].astype("datetime64[us]").astype("int64").tolist(), []
        for us, good in zip(at, pdf[ok].fillna(False).tolist()):
            if span is not None and opened is not None and us - opened > span:
                run, opened = 0, None
            run = 0 if good else run + 1
            opened = None if good else us if run == opens_at else opened
            runs.append(run)
        state.update((run, opened))
        if forget_after:
            state.setTimeoutTimestamp(max(at[-1] // 1000, state.getCurrentWatermarkMs()) + keep)
        yield pd.DataFrame({"key": str(k[0]), "at": pdf[time].to_numpy(), "run": runs, "open": [r >= opens_at for r in runs]})

    rows = events.select(F.col(key).alias("_k"), time, ok).where("_k is not null")
    if forget_after:
        rows = rows.withWatermark(time, forget_after)
    timeout = GroupStateTimeout.EventTimeTimeout if forget_after else GroupStateTimeout.NoTimeout
    return rows.groupBy("_k").applyInPandasWithState(step, "key string, at timestamp, run long, open boolean", "run long, opened long", "append", timeout)


def steered_threshold(batch: DataFrame, previous: float, score: str, low: float = 30, high: float = 70, step: float = 2, most: int = 8, least: int = 1) -> float:
    """The threshold after a batch: up a step if more than `most` rows reach it, down if fewer than `least` do."""
    n = batch.where(F.col(score) >= previous).count()
    return min(high, max(low, previous + (step if n > most else -step if n < least else 0)))


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over all that is there and stops; the sink is a folder of Parquet files."""
    if mode == "append":
        return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
