"""Maps of counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(a: Column, b: Column) -> Column:
    """Counts of both maps added by key; a null map counts as empty."""
    empty = F.create_map().cast("map<string,bigint>")
    zero = F.lit(0).cast("long")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda k, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def by_count(m: Column) -> Column:
    """The entries of a map as structs (key, value), the greatest count first, then by key."""
    order = lambda x, y: F.when(x["value"] != y["value"], F.when(x["value"] > y["value"], -1).otherwise(1)).when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)
    return F.array_sort(F.map_entries(m), order)
