"""Problem 1: timestamps in mixed notations and zones as UTC instants, through a dictionary of distinct values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instant_text import parse_instant
from ..session import drop_at_exit, exists, scratch_path, written

KEYS = ["raw", "tz_name", "locale"]
DICTIONARY = "raw string, tz_name string, locale string, utc_us long"


def _parse(batches):
    for pdf in batches:
        none = lambda s: s.astype(object).where(s.notna(), None)
        utc = [parse_instant(*x) for x in zip(none(pdf["raw"]), none(pdf["tz_name"]), none(pdf["locale"]))]
        yield pdf.assign(utc_us=pd.array(utc, dtype="Int64"))


def extend_dictionary(values: DataFrame, path: str) -> DataFrame:
    """Adds the values (raw, tz_name, locale) that the dictionary at path lacks, each parsed once; gives all of it.

    Values that name no instant are kept, too, with null, so that no later run parses them again. Each run appends files;
    compact_dictionary makes them few again. Runs at one time may append a value twice, so readers take each value once.
    """
    spark = values.sparkSession
    new = values.select(*KEYS).distinct()
    if exists(spark, path):
        known = spark.read.schema(DICTIONARY).parquet(path)
        same = [new[k].eqNullSafe(known[k]) for k in KEYS]
        new = new.join(known, same[0] & same[1] & same[2], "left_anti")
    new.mapInPandas(_parse, DICTIONARY).write.mode("append").parquet(path)
    return spark.read.schema(DICTIONARY).parquet(path)


def compact_dictionary(spark: SparkSession, path: str) -> None:
    """Rewrites the dictionary at path with each value once, in few files. No run may use it meanwhile."""
    once = written(spark.read.schema(DICTIONARY).parquet(path).dropDuplicates(KEYS), "dictionary")
    once.write.mode("overwrite").parquet(path)


def normalise_instants(df: DataFrame, locales: DataFrame, fields: list[str], id_col: str = "row_id", source_col: str = "sourceurl", dictionary: str | None = None) -> DataFrame:
    """(id, field, utc_us): one row per row of df and field that names one definite instant.

    The distinct (value, zone, locale) of all fields form a dictionary that is parsed once and persisted at `dictionary`
    (a new folder beside the checkpoints by default; pass a lasting one to parse only what is new next time); the
    instants are joined back to the rows by value. Null, empty and blank values and values without an instant give no
    row; a source without a locale row leaves only values that state their own zone; repeated rows stay repeated; other
    columns, whatever their names, are ignored; an empty table gives no rows. A value that fills many rows stays one
    entry; a join partition of such a value is split by adaptive execution.
    """
    path = dictionary or scratch_path(df.sparkSession, "instants")
    zones = locales.select(F.col("sourceurl").alias("_source"), "tz_name", "locale").dropDuplicates(["_source"])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields])).alias("_x")
    long = (
        df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), each)
        .select("_id", "_source", "_x.field", "_x.raw")
        .where(F.trim("raw") != "")
        .join(zones, "_source", "left")
        .select("_id", "field", "raw", F.coalesce("tz_name", F.lit("")).alias("tz_name"), F.coalesce("locale", F.lit("")).alias("locale"))
    )
    parsed = extend_dictionary(long, path).where("utc_us is not null")
    if dictionary:
        parsed = parsed.dropDuplicates(KEYS)  # by the keys of the join: no shuffle more
    else:
        drop_at_exit(df.sparkSession, path)
    return long.join(parsed, KEYS).select(F.col("_id").alias(id_col), "field", "utc_us")
