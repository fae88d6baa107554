"""Records for load tests, made by rule from their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("Software Engineer", "Data Engineer", "Product Manager", "Designer")


def mock_postings(spark: SparkSession, n: int, firms: int = 50) -> DataFrame:
    """n records; each tenth repeats the content hash of the record nine before it."""
    i = F.col("id")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (i % len(ROLES) + 1).cast("int"))
    number = i.cast("string")
    return spark.range(n).select(
        F.concat(F.lit("mock-"), number).alias("id"), F.concat(role, F.lit(" "), number).alias("title"), F.concat(F.lit("Firm "), (i % firms).cast("string")).alias("company"),
        F.concat(F.lit("https://jobs.example/"), number).alias("link"), F.concat(F.lit("hash-"), F.when(i % 10 == 9, i - 9).otherwise(i).cast("string")).alias("content_hash"),
    )
