"""Which of several rows to keep: the last, or the first that says something, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each group by ``order``, pre-aggregated in each task; ``first_at`` is the order of the group's first."""
    others = [c for c in rows.columns if c not in keys]
    place = F.struct(*order)
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), place).alias("_row"), F.min(place).alias("first_at"))
    return out.select(*keys, "_row.*", "first_at")


def first_said(value: Column, order: Column) -> Column:
    """The aggregate: the first value by ``order`` that isn't null or empty text."""
    said = value.isNotNull() & (value.cast("string") != "")
    return F.min_by(value, F.when(said, order))
