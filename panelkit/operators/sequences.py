"""Fixed-length sequences of an entity's rows as arrays, normalised with array functions."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelkit.functions import ts

# the Arrow helpers go to the tasks with the query, so workers need not have the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Features of a rank sequence, in order: of each row, of its date, and of the last row alone.
RAW = ["open", "high", "low", "close", "volume", "vwap", "volume_ratio", "turnover_rate", "ret_5d", "close_ma20", "atr_ratio"]
SEASON = ["year_sin", "year_cos", "er_sin", "er_cos", "quarter_sin", "quarter_cos"]
LAST_ONLY = ["vol_spike_3d", "pe_rel", "pb_rel", "ind_momentum"]
RANK_FEATURES = RAW + SEASON + LAST_ONLY
#: Of them, those divided by the last close, less 1.
PRICES = ["open", "high", "low", "close", "vwap"]
#: Sequences of an entity that are held as arrays at a time.
CHUNK = 1024


def build(panel: DataFrame, columns: list[str], length: int = 60, stride: int = 1, exclusive: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(entity, trade_date, keep..., seq): array of rows, each an array of the columns' values.

    A sequence ends at its row, or at the row before if ``exclusive``.  Rows with fewer rows
    before them, off the stride, or with a missing value in the sequence have none, nor has
    an entity's last row.
    """
    row = F.array(*[F.col(c).cast("double") for c in columns])
    frame = ts.rows(-length, -1) if exclusive else ts.trailing(length)
    out = panel.select("entity", "trade_date", *keep, F.collect_list(row).over(frame).alias("seq"), ts.row_number().alias("__rn"), F.count(F.lit(1)).over(Window.partitionBy("entity")).alias("__n"))
    first = length + 1 if exclusive else length
    good = (F.size("seq") == length) & ((F.col("__rn") - first) % stride == 0)
    if not exclusive:
        good &= F.col("__rn") < F.col("__n")
    return out.where(good).where(~F.exists("seq", lambda r: F.exists(r, lambda v: v.isNull()))).drop("__rn", "__n")


def _column(seq: Column, k: int) -> Column:
    return F.transform(seq, lambda r: F.get(r, F.lit(k)))


def _square(mean: Column):
    return lambda a, v: a + (v - mean) * (v - mean)


def _standard(mean: Column, std: Column):
    return lambda v: (v - mean) / std


def fit_volume(panel: DataFrame, volume: str = "volume") -> tuple[float, float]:
    """(mean, population deviation + 1e-8) of log(1 + volume) over a training split, for ``volume_stats``."""
    v = F.col(volume).cast("double")
    log = F.when(v.isNotNull(), F.log1p(F.greatest(v, F.lit(0.0))))  # greatest would take a missing volume for 0
    mean, std = panel.agg(F.avg(log), F.stddev_pop(log)).first()
    return (mean or 0.0), (std or 0.0) + 1e-8


def normalize(seqs: DataFrame, names: list[str], ratios: list[str], volume: str | None, volume_stats: tuple[float, float] | None = None, others: bool = True, limit: float = 5.0) -> DataFrame:
    """Columns of ``seq`` as arrays: ratios to the last close less 1, log volume, z-scores of the rest.

    A z-score is by the sequence's own mean and population deviation, clipped, and 0 where the
    deviation is at most 1e-8.  Means and deviations are columns of their own, so that no
    element computes them again.
    """
    close = names.index("close")
    last = F.get(F.get(F.col("seq"), F.size("seq") - 1), F.lit(close))
    out = seqs.select("entity", "trade_date", F.when(last > 0, last).otherwise(F.lit(1.0)).alias("__last"), *[_column(F.col("seq"), k).alias(f"__a{k}") for k in range(len(names))])
    scored = [k for k, n in enumerate(names) if others and n not in ratios and n != volume]
    fold = lambda c, f: F.aggregate(c, F.lit(0.0), f) / F.size(c)
    out = out.select("*", *[fold(F.col(f"__a{k}"), lambda a, v: a + v).alias(f"__m{k}") for k in scored])
    out = out.select("*", *[F.sqrt(fold(F.col(f"__a{k}"), _square(F.col(f"__m{k}")))).alias(f"__s{k}") for k in scored])
    made = []
    for k, name in enumerate(names):
        values = F.col(f"__a{k}")
        if name in ratios:
            values = F.transform(values, lambda v: v / F.col("__last") - 1)
        elif name == volume:
            mean, std = volume_stats or (0.0, 1.0)
            values = F.transform(values, lambda v: (F.log1p(F.greatest(v, F.lit(0.0))) - mean) / std)
        elif k in scored:
            z = _standard(F.col(f"__m{k}"), F.col(f"__s{k}"))
            values = F.when(F.col(f"__s{k}") > 1e-8, F.transform(values, lambda v: F.greatest(F.least(z(v), F.lit(limit)), F.lit(-limit)))).otherwise(F.transform(values, lambda v: F.lit(0.0)))
        made.append(values.alias(name))
    return out.select("entity", "trade_date", *made)


def with_agent_state(seqs: DataFrame, position: Column, days: Column) -> DataFrame:
    """Two more values in each row of ``seq``: a position, and min(days, 30) / 30."""
    more = F.array(position.cast("double"), F.least(days, F.lit(30)) / 30.0)
    return seqs.withColumn("seq", F.transform("seq", lambda r: F.concat(r, more)))


def season() -> list[Column]:
    """SEASON: sine and cosine of the day of the year over 365 and 90, and of the quarter over 4."""
    day, quarter = F.dayofyear("trade_date"), F.quarter("trade_date")
    angles = [part * (2 * math.pi) / period for part, period in ((day, 365.0), (day, 90.0), (quarter, 4.0))]
    return [c.alias(n) for n, c in zip(SEASON, [f(a) for a in angles for f in (F.sin, F.cos)])]


def _steps(values: np.ndarray, rows: np.ndarray, length: int):
    """For each place of the sequences that end before ``rows``: RANK_FEATURES of these sequences, a row for each feature.

    ``values`` has a row for each of RAW, SEASON, log volume, and LAST_ONLY but the first.
    """
    names, place = len(RAW + SEASON), {n: k for k, n in enumerate(RANK_FEATURES)}
    prices, volume = [place[n] for n in PRICES], place["volume"]
    mean = lambda n: sum(values[volume, rows - k] for k in range(n, 0, -1)) / n
    spike = mean(3) / np.maximum(mean(length), 1e-8)
    close = values[place["close"], rows - 1]
    # a NaN is above 0, as in Spark
    last = np.where(close <= 0, 1.0, close)
    for k in range(length, 0, -1):
        step = np.zeros((len(RANK_FEATURES), len(rows)))
        found = values[: names + 1, rows - k]
        step[:names] = found[:names]
        step[prices] = found[prices] / last - 1
        step[volume] = found[names]
        if k == 1:
            step[names] = spike
            step[names + 1 :] = values[names + 1 : names + len(LAST_ONLY), rows]
        yield step


def sums_by_place(steps) -> np.ndarray:
    """The sum of each feature of each sequence, and its sum weighted by place from 1; added in order of place."""
    plain = placed = 0.0
    for k, step in enumerate(steps, 1):
        plain = plain + step
        placed = placed + step * k
    return np.concatenate([plain, placed])


def _whole(steps) -> np.ndarray:
    """All values of each sequence, feature by feature."""
    cube = np.stack(list(steps), axis=1)
    return cube.reshape(-1, cube.shape[2])


def rank_cache(panel: DataFrame, length: int = 60, horizons: tuple[int, ...] = (5, 20, 60), digest=None, into: tuple[str, ...] = ()) -> DataFrame:
    """(entity, trade_date, RANK_FEATURES, fwd_5, fwd_20, fwd_60): each feature an array of ``length`` values.

    ``panel`` has RAW, pe_ttm, pb and industry.  A sequence holds the rows before its row.
    Prices are ratios to the last close less 1, volumes go to log1p.  LAST_ONLY features are 0
    but at the end: the mean volume of three rows over that of all, and the row's pe_ttm, pb
    and ret_5d less the industry's median (0 if missing).  Rows with fewer rows before or
    after them than asked for, and those with a missing value, have none; a forward return
    without a value is 0.

    Medians are one row for each date and industry, which go to every task; rows stay where
    their entity is.  An entity's sequences are put together there as numpy arrays.  With
    ``digest`` the features of a sequence become numbers by name (``into``) in the same task,
    and these come back in place of the features: it takes, for each place of the sequences in
    turn, an array of feature and sequence, and gives one of number and sequence.
    """
    medians = dict(zip(LAST_ONLY[1:], ("pe_ttm", "pb", "ret_5d")))
    typical = panel.groupBy(F.col("trade_date").alias("__date"), F.col("industry").alias("__industry")).agg(*[F.median(c).alias(f"__{n}") for n, c in medians.items()])
    same = F.col("trade_date").eqNullSafe(F.col("__date")) & F.col("industry").eqNullSafe(F.col("__industry"))
    out = panel.join(F.broadcast(typical), same).select("*", *season())
    needed = [*[F.col(c) for c in RAW + SEASON], F.log1p(F.greatest("volume", F.lit(0.0))), *[F.col(c) - F.coalesce(f"__{n}", F.lit(0.0)) for n, c in medians.items()]]
    forward = [F.coalesce(ts.forward_return("close", h), F.lit(0.0)) for h in horizons]
    # numbers of a row go to and fro as one array, as an entity's rows are few for as many columns
    rows = out.select("entity", "trade_date", F.array(*[c.cast("double") for c in (*needed, *forward)]).alias("__numbers"), ts.lead("close", max(horizons)).isNotNull().alias("__good"))
    width, steps, ahead = len(needed) + len(forward), len(RAW + SEASON), len(needed)
    wide = len(into) if digest else len(RANK_FEATURES) * length

    def of_entity(table: pa.Table) -> pa.Table:
        table = table.sort_by("trade_date").combine_chunks()
        flat = table.column("__numbers").combine_chunks().flatten()
        values = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).reshape(-1, width).T)
        missing = np.asarray(flat.is_null()).reshape(-1, width)
        gaps = np.concatenate([[0], np.cumsum(missing[:, :steps].any(axis=1))])
        # a missing median is NaN by now
        good = np.asarray(table.column("__good")) & ~np.isnan(values[steps + 1 : ahead]).any(axis=0)
        good = np.flatnonzero(good)
        good = good[good >= length]
        good = good[gaps[good] == gaps[good - length]]
        parts = [good[k : k + CHUNK] for k in range(0, len(good), CHUNK)]
        made = [np.concatenate([(digest or _whole)(_steps(values, part, length)), values[ahead:, part]]).T.reshape(-1) for part in parts]
        ends = np.arange(len(good) + 1, dtype=np.int32) * (wide + width - ahead)
        array = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *made])))
        kept = table.select(["entity", "trade_date"]).take(pa.array(good))
        return pa.table([*kept.columns, array], names=["entity", "trade_date", "__numbers"])

    made = rows.groupBy("entity").applyInArrow(of_entity, rows.select("entity", "trade_date", "__numbers").schema)
    number = lambda k: F.get("__numbers", F.lit(k))
    if digest:
        names = [number(k).alias(n) for k, n in enumerate(into)]
    else:
        names = [F.slice("__numbers", k * length + 1, length).alias(n) for k, n in enumerate(RANK_FEATURES)]
    return made.select("entity", "trade_date", *names, *[number(wide + k).alias(f"fwd_{h}") for k, h in enumerate(horizons)])
