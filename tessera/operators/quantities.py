"""Problem 3: quantities in texts in common units."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantity_text import Factors, automaton, quantities
from ..session import spread

RESULT = "quantity string, low long, high long"


def extract_quantities(df: DataFrame, factors: DataFrame, id_col: str = "row_id", text_col: str = "content") -> DataFrame:
    """(id, quantity, low, high) of each text: pay in USD a year, experience in months, distance in metres, working time
    in minutes a week, in the common units of `factors` (quantity, unit, factor; a fixed small table).

    Figures are found by their units: the unit string is segmented by dynamic programming over tries of prefixes, roots
    and exponents with the priors of each quantity, and must have the quantity's dimension. What the sentence speaks of
    nearest to the figure decides whether it is the post's; units of working time say so by themselves. Bare pay figures take currency, scale and period from where the record states them;
    without any, they give no row. A single figure is both ends, fractions are rounded half up. Null, empty and blank
    texts give no row; of several statements of a quantity the first counts; repeated rows stay repeated; an empty table
    gives no rows. There is no shuffle (but see spread).
    """
    table = [(r["quantity"], r["unit"], r["factor"]) for r in factors.select("quantity", "unit", "factor").collect()]
    key = df.schema[id_col]

    def run(batches):
        known, topics = Factors(table), automaton()
        for pdf in batches:
            rows = []
            for i, text in zip(pdf[id_col], pdf["_text"]):
                rows += [(i, *q) for q in quantities(text.lower(), topics, known)]
            yield pd.DataFrame(rows, columns=[id_col, "quantity", "low", "high"])

    schema = T.StructType([T.StructField(id_col, key.dataType), T.StructField("quantity", T.StringType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])
    return spread(df.select(F.col(id_col), F.col(text_col).alias("_text")).where(F.trim("_text") != "")).mapInPandas(run, schema)
