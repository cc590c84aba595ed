"""Column helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, **columns: str) -> DataFrame:
    """df with columns that are computed once for each row.

    The optimizer folds a projection into the next, also into a lambda there, which would compute the
    column again for each element that the lambda sees. A generator of one row is not folded.
    """
    return df.select("*", F.inline(F.array(F.struct(*(F.expr(x).alias(name) for name, x in columns.items())))))
