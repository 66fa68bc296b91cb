"""Places in a total order without one task that holds all rows.

Rows are dealt into ranges of the order and stored with their range; ranges are counted, the
counts before each range are added up, and each range numbers its own rows.  Ties go by the
last columns of the order, so equal values may lie in several ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.sources import io

RANGE, BEFORE = "__range", "__before"


def numbered(df: DataFrame, order: list[Column], groups: list[str] | None = None, out: str = "position", size: str | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with each row's place in the order, from 1, and with ``size`` the number of rows; in each group by itself.

    A group is spread over as many ranges as its rows fill, so neither a hot date nor the whole
    table meets in one task.  Rows equal in the whole order are numbered in any order.
    """
    groups = groups or []
    by = [*[F.col(g).asc_nulls_last() for g in groups], *order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    # stored: borders come from a sample, so another run could deal otherwise
    dealt = io.store(dealt.withColumn(RANGE, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*groups, RANGE).agg(F.count(F.lit(1)).alias("__n"))
    # a row for each range, and for each group that starts inside one
    w = Window.partitionBy(*groups).orderBy(RANGE)
    before = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.select(*groups, RANGE, before.alias(BEFORE), *([F.sum("__n").over(Window.partitionBy(*groups)).alias(size)] if size else []))
    same = F.lit(True)
    for c in (*groups, RANGE):
        same = same & dealt[c].eqNullSafe(sums[c])
    joined = dealt.join(sums, same).select(dealt["*"], BEFORE, *([size] if size else []))
    place = F.col(BEFORE) + F.row_number().over(Window.partitionBy(*groups, RANGE).orderBy(*order))
    return joined.withColumn(out, place).drop(RANGE, BEFORE)


def ranked(df: DataFrame, value: str, tie: str, groups: list[str] | None = None, ascending: bool = True) -> DataFrame:
    """``df`` with position, rank (ties share the least place) and size; missing values come last."""
    groups = groups or []
    order = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    placed = numbered(df, [order, F.col(tie)], groups, "position", "size")
    first = placed.groupBy(*groups, value).agg(F.min("position").alias("rank"))
    same = F.lit(True)
    for c in (*groups, value):
        same = same & placed[c].eqNullSafe(first[c])
    return placed.join(first, same).select(placed["*"], "rank")


def tile(position, size, n: int) -> Column:
    """Which of n tiles a place falls in, from 1; the first tiles are one row larger if they don't come out even."""
    place, each, more = F.col(position) - 1, F.floor(F.col(size) / n), F.col(size) % n
    inside = F.floor(place / (each + 1))
    return F.when(place < more * (each + 1), inside).otherwise(more + F.floor((place - more * (each + 1)) / F.greatest(each, F.lit(1)))) + 1

