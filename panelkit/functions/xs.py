"""Cross-sectional Column builders: all entities of one date."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.ts import DATE, ENTITY, col

# the Arrow helpers go to the tasks with the query, so workers need not have the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def by_date(*more: str):
    return Window.partitionBy(DATE, *more)


def steady(x, digits: int) -> Column:
    """Rounding before a rank: values that differ in the last bits of a sum tie; halves lie off the border."""
    scale = float(10**digits)
    return F.floor(col(x) * scale + 0.50001) / scale


def rank(x, *more: str) -> Column:
    return F.rank().over(by_date(*more).orderBy(col(x).asc_nulls_last()))


def ntile(x, n: int) -> Column:
    return F.ntile(n).over(by_date().orderBy(col(x).asc_nulls_last(), ENTITY))


def pct_rank(x, *more: str) -> Column:
    """Average-tie percentile rank in (0, 1] among rows that aren't missing."""
    w = by_date(*more).orderBy(col(x).asc_nulls_last())
    everything = by_date(*more)
    size = F.count(F.lit(1)).over(everything)
    average = (F.rank().over(w) + F.round(F.cume_dist().over(w) * size)) / 2
    return F.when(col(x).isNotNull(), F.try_divide(average, F.count(col(x)).over(everything)))


def _peers(table: pa.Table, name: str, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    column = table.column(name)
    return peers(np.asarray(column.fill_null(0.0)), np.asarray(column.is_null()), order)


def peers(value: np.ndarray, null: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(rows by rising value, nulls last; place of the first and of the last row with the same value; values that aren't null).

    Rows of one value stay in ``order``.  As in Spark, NaN is the largest value and equals itself, and -0 equals 0.
    """
    kind = "stable" if order is not None else None  # any order of equal values will do
    order = np.arange(len(value)) if order is None else order
    known = order[~null[order]]
    known = known[np.argsort(value[known], kind=kind)]
    sorted_rows, v = np.concatenate([known, order[null[order]]]), value[known]
    new = np.ones(len(value), bool)
    new[1 : len(v)] = (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])) if len(v) else False
    new[len(v) + 1 :] = False
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    return sorted_rows, starts[group], np.append(starts[1:], len(value))[group] - 1, len(v)


def shares(value: np.ndarray, null: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Percentile ranks of one date, ties at their average; ``out`` keeps what it has where a value is missing."""
    rows, first, last, n = peers(value, null)
    out[rows[:n]] = ((first + last + 2) / 2 / max(n, 1))[:n]
    return out


def pct_rank_long(df: DataFrame, names: list[str], keep: tuple[str, ...] = (), tasks: int | None = None, dealt: bool = False, into: str | None = None) -> DataFrame:
    """Percentile ranks of many columns with one shuffle; numbers in ``keep`` come back as doubles, unranked.

    With ``into`` the ranks come as one array of that name, in the order of ``names`` and 0 where a value is missing.

    Rows are dealt over tasks by date, and a date's columns are ranked one after the other as
    Arrow arrays, so rows aren't multiplied by the number of columns.  Rows that are ``dealt``
    by date already stay.
    """
    rows = df.select(ENTITY, DATE, *[F.col(n).cast("double").alias(n) for n in (*names, *keep)])
    ranked = set(names)

    def rank_array(table: pa.Table) -> pa.Table:
        made = np.zeros((table.num_rows, len(names)))
        for k, name in enumerate(names):
            rows, first, last, n = _peers(table, name)
            made[rows[:n], k] = ((first + last + 2) / 2 / max(n, 1))[:n]
        offsets = np.arange(table.num_rows + 1, dtype=np.int32) * len(names)
        array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.reshape(-1)))
        kept = [ENTITY, DATE, *keep]
        return pa.table([*[table.column(n) for n in kept], array], names=[*kept, into])

    def rank_date(table: pa.Table) -> pa.Table:
        columns = []
        for name in table.column_names:
            if name not in ranked:
                columns.append(table.column(name))
                continue
            rows, first, last, n = _peers(table, name)
            out = np.zeros(len(rows))
            out[rows] = (first + last + 2) / 2 / max(n, 1)
            missing = np.zeros(len(rows), bool)
            missing[rows[n:]] = True
            columns.append(pa.array(out, mask=missing))
        return pa.table(columns, names=table.column_names)

    by = (rows if dealt else dealt_by_date(rows, tasks)).groupBy(DATE)
    if into is None:
        return by.applyInArrow(rank_date, rows.schema)
    return by.applyInArrow(rank_array, rows.select(ENTITY, DATE, *keep, F.lit(None).cast("array<double>").alias(into)).schema)


def by_entity(table: pa.Table) -> np.ndarray:
    """Rows by rising entity, nulls first."""
    return np.asarray(pc.sort_indices(table.select([ENTITY]), sort_keys=[(ENTITY, "ascending")], null_placement="at_start"))


def tiles_of(size: int, tiles: int) -> np.ndarray:
    """Tile, from 1, of each place among ``size`` rows."""
    least, more = divmod(size, tiles)
    place = np.arange(size)
    return np.where(place < more * (least + 1), place // (least + 1), (place - more) // max(least, 1)) + 1


def dealt_by_date(rows: DataFrame, tasks: int | None) -> DataFrame:
    return rows.repartition(DATE) if tasks is None else rows.repartition(tasks, DATE)


def with_ranks(df: DataFrame, keep: list[str], bases: dict[str, Column], ranks: dict[str, tuple[str, str]], tiles: int, out: str, tasks: int | None = None) -> DataFrame:
    """The columns ``keep`` and an array of ranks over each date, nulls last: {name: ("rank" or "tile", base)} in order.

    One shuffle, by date; a date's bases are ranked one after the other as Arrow arrays.  Equal
    values share a rank, and their tiles go by entity.
    """
    rows = df.select(*keep, *[c.cast("double").alias(f"__base_{n}") for n, c in bases.items()])
    places = {b: [k for k, (_, base) in enumerate(ranks.values()) if base == b] for b in bases}
    kinds = [kind for kind, _ in ranks.values()]

    def rank_date(table: pa.Table) -> pa.Table:
        size = table.num_rows
        entities, tile = by_entity(table), tiles_of(size, tiles)
        made = np.empty((size, len(kinds)), np.int32)
        for base, wanted in places.items():
            rows, first, _, _ = _peers(table, f"__base_{base}", entities)
            for k in wanted:
                made[rows, k] = first + 1 if kinds[k] == "rank" else tile
        offsets = np.arange(size + 1, dtype=np.int32) * len(kinds)
        array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.reshape(-1)))
        return pa.table([*[table.column(n) for n in keep], array], names=[*keep, out])

    schema = df.select(*keep, F.lit(None).cast("array<int>").alias(out)).schema
    return dealt_by_date(rows, tasks).groupBy(DATE).applyInArrow(rank_date, schema)


def median(x, *more: str) -> Column:
    return F.median(col(x)).over(by_date(*more))


def industry_ratio(x, industry: str = "industry") -> Column:
    return F.try_divide(col(x), median(x, industry) + F.lit(1e-8))


def industry_diff(x, industry: str = "industry") -> Column:
    return col(x) - median(x, industry)


def top_k(df: DataFrame, score: str, k: int, ascending: bool = False) -> DataFrame:
    order = F.asc_nulls_last(score) if ascending else F.desc_nulls_last(score)
    nth = F.row_number().over(by_date().orderBy(order, ENTITY))
    return df.withColumn("nth", nth).where(F.col("nth") <= k)


def percentile(x, p: float) -> Column:
    return F.percentile(col(x), F.lit(p)).over(by_date())


def confidence(ci) -> Column:
    most = F.greatest(F.max(col(ci)).over(by_date()), F.lit(1e-8))
    return 1 - col(ci) / most


def normalize(weight) -> Column:
    return F.try_divide(col(weight), F.sum(col(weight)).over(by_date()))
