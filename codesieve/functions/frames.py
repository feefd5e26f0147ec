"""Plan helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """Compute the columns here, once per row.

    The optimizer substitutes expensive projections into every filter and
    projection above them.  A one-element generator keeps the values as they
    are: later operators see plain columns, and no row leaves its task.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))
