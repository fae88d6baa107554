"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.quantities import extract_quantities
from ..session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_quantities(table(spark, sf_dir, "raw_jobs"), table(spark, sf_dir, "unit_factors"))


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {}
