"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.instants import normalise_instants
from ..session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_instants(table(spark, sf_dir, "raw_jobs"), table(spark, sf_dir, "feed_locales"), ["pubdate", "isodate"])


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
