"""Ranking a table of any size: rows in ranges by sampled bounds, counted by range."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Bits of Spark's row ids that number the rows of a partition (fixed by Spark).
WITHIN = (1 << 33) - 1


def in_ranges(rows: DataFrame, *order: str | Column, ranges: int | None = None) -> DataFrame:
    """The rows with ``part``, the number of the range that a row is in, and ``at``, its place there from 0; each range is a partition, sorted.

    Ranges are cut by bounds sampled over all of ``order``, so ties of its first columns are split by the
    others; only rows that are alike in all of them share a range whatever their number. The rows are
    read twice, once for the sample: write them first where they are dear. The numbers hold for one
    evaluation: write the result before using it twice.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return sorted_.withColumns({"part": F.shiftright(number, 33), "at": number.bitwiseAND(WITHIN)})


def numbered(rows: DataFrame, *order: str | Column, name: str = "place", first: int = 1, ranges: int | None = None) -> DataFrame:
    """The rows with a dense number from ``first`` in the given order; no task holds more than a range of them.

    What goes through the driver is one count for each range.
    """
    table = written(in_ranges(rows, *order, ranges=ranges), "ranges")
    counts = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.count("*").alias("n")).collect())
    before = accumulate((n for _, n in counts), initial=first)
    ahead = table.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "part long, ahead long")
    return table.join(F.broadcast(ahead), "part").select(*rows.columns, (F.col("at") + F.col("ahead")).alias(name))
