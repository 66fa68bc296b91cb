"""Training sets: labels, industry features, percentile ranks, splits and folds."""

from __future__ import annotations

import sys
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions import arrays, ts, xs
from panelkit.operators import order_stats
from panelkit.operators.catalog import FactorCatalog

# dates are ranked in the tasks, so workers need not have the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RISK_FREE = 0.02
HORIZONS = (5, 20, 60)


def label_path(panel: DataFrame) -> DataFrame:
    """Where the close k rows ahead lies between the lowest low and the highest high up to it."""
    out = panel
    for k in (5, 20):
        lo, hi = ts.forward_low("low", k), ts.forward_high("high", k)
        out = out.withColumn(f"label_{k}", F.try_divide(ts.lead("close", k) - lo, hi - lo))
    return out.withColumn("label_60", ts.forward_return("close", 60))


def label_valid(labelled: DataFrame) -> DataFrame:
    return labelled.where("label_5 is not null and label_20 is not null and label_60 is not null")


def industry_features(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Ratios to and differences from the industry's median, and the industry's momentum."""
    made = [xs.industry_ratio(c).alias(f"{c}_ind_ratio") for c in columns]
    momentum = [xs.median(f"back_{k}", "industry").alias(f"ind_mom_{k}") for k in (5, 20)]
    back = panel.select("*", *[ts.back_return("close", k).alias(f"back_{k}") for k in (5, 20)])
    return back.select("*", *made, *momentum)


def risk_free_rows(labelled: DataFrame, features: list[str], returns: dict[int, str], tiles: int) -> DataFrame:
    """``labelled`` and, for each date, a synthetic row: every feature 0.5, labels by the share of returns at or below the rate."""
    share = lambda h: F.avg((F.col(returns[h]) <= RISK_FREE * h / 252).cast("double"))
    label = lambda h: F.least((share(h) * tiles).cast("int"), F.lit(tiles - 1))
    rows = labelled.groupBy("trade_date").agg(*[label(h).alias(f"tile_{h}") for h in returns])
    rows = rows.select(F.lit(None).cast("long").alias("entity"), "trade_date", *[F.lit(0.5).alias(f) for f in features], *[f"tile_{h}" for h in returns])
    real = labelled.select("entity", "trade_date", *features, *[f"tile_{h}" for h in returns])
    return real.unionByName(rows, allowMissingColumns=True)


def split_dates(train_end, val_start, val_end) -> Column:
    return F.when(F.col("trade_date") <= train_end, "train").when(F.col("trade_date").between(val_start, val_end), "val")


def session_ordinals(calendar: DataFrame) -> DataFrame:
    """One row for each session, numbered in order; the calendar is a small dimension."""
    return calendar.where("is_open = 1").select("trade_date").distinct().withColumn("nth", F.row_number().over(Window.orderBy("trade_date")))


def purge_embargo(calendar: DataFrame, train_end, val_start, purge: int = 60, embargo: int = 5) -> DataFrame:
    """One row (train_end, val_start): moved apart by sessions where the boundary is a session."""
    nth = session_ordinals(calendar)
    last = F.max("nth")
    at = nth.agg(F.max(F.when(F.col("trade_date") == train_end, F.col("nth"))).alias("a"), F.max(F.when(F.col("trade_date") == val_start, F.col("nth"))).alias("b"), last.alias("n"))
    a, b = F.greatest(F.col("a") - purge, F.lit(1)), F.least(F.col("b") + embargo, F.col("n"))
    ends = nth.crossJoin(F.broadcast(at)).agg(
        F.coalesce(F.max(F.when(F.col("nth") == a, F.col("trade_date"))), F.lit(train_end)).alias("train_end"),
        F.coalesce(F.max(F.when(F.col("nth") == b, F.col("trade_date"))), F.lit(val_start)).alias("val_start"))
    return ends


def tabular(features: DataFrame, names: list[str], bars: DataFrame, securities: DataFrame, flags: DataFrame, train_end, val_start, val_end, calendar: DataFrame) -> DataFrame:
    """Full training set: universe, path labels, industry ratios, percentile ranks, purged split."""
    from panelkit.operators import universe

    labelled = label_valid(label_path(bars)).select("entity", "trade_date", "label_5", "label_20", "label_60")
    base = universe.exclude_flagged(features, flags).join(securities.where("market <> 'AFRICA'").select("entity", "industry"), "entity").dropna(subset=names)
    base = base.join(labelled, ["entity", "trade_date"])
    ratios = [xs.industry_ratio(n).alias(f"{n}_ind_ratio") for n in names]
    base = base.select("*", *ratios)
    ranked = xs.pct_rank_long(base, [*names, *[f"{n}_ind_ratio" for n in names]])
    out = base.select("entity", "trade_date", "label_5", "label_20", "label_60").join(ranked, ["entity", "trade_date"])
    ends = purge_embargo(calendar, train_end, val_start)
    out = out.crossJoin(F.broadcast(ends.withColumnsRenamed({"train_end": "__te", "val_start": "__vs"})))
    split = F.when(F.col("trade_date") <= F.col("__te"), "train").when(F.col("trade_date").between(F.col("__vs"), F.lit(val_end)), "val")
    return out.withColumn("split", split).where("split is not null").drop("__te", "__vs")


#: Factors without gain, left out of training sets; those with a ratio to the industry's median.
ZERO_GAIN = [
    "SUM_close_5", "SUM_close_10", "SUM_close_20", "SUM_close_30", "SUM_close_60", "O2C", "DRP", "HLC", "pe_ttm", "pb",
    "ROE_RAW", "ROE", "MV", "VOLRATIO", "EMA12C", "EMA26C", "MACD", "RSI14", "SLOPE5", "SLOPE20",
]
INDUSTRY_FACTORS = ["PE_TTM_MINMAX_750", "PB_MINMAX_750", "MV", "TURN", "ROE"]
#: Digits of industry features before they are ranked.
INDUSTRY_DIGITS = 9


def training_columns(names: list[str]) -> tuple[list[str], list[str]]:
    """(factors, all features) of a training set over a catalog's ``names``."""
    factors = [n for n in names if n not in ZERO_GAIN]
    return factors, [*factors, *[f"{n}_ind" for n in INDUSTRY_FACTORS if n in factors], "ind_mom_5d", "ind_mom_20d"]


def ranked_vectors(factors: FactorCatalog, panel: DataFrame, keep: tuple[str, ...], into: str, tasks: int | None = None) -> DataFrame:
    """(entity, trade_date, ``keep``..., ``into``): all factors' percentile ranks of the date as one array, 0 where a factor is missing."""
    names = factors.names

    def finish(day) -> pa.Table:
        size = day.rows.num_rows
        made = np.zeros((size, len(names)))
        for k, (_, values, missing) in enumerate(day.factors()):
            xs.shares(values, missing, made[:, k])
        array = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * len(names)), pa.array(made.reshape(-1)))
        return day.rows.append_column(into, array)

    schema = panel.select("entity", "trade_date", *keep, F.lit(None).cast("array<double>").alias(into)).schema
    return factors.by_date(panel, finish, schema, tasks, keep)


def _industry_median(value: np.ndarray, null: np.ndarray, industry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(median of the row's industry, whether it has none); missing values don't count."""
    known = np.flatnonzero(~null)
    known = known[np.lexsort((value[known], industry[known]))]
    sizes = np.bincount(industry[known], minlength=industry.max(initial=-1) + 1)
    starts, some = np.cumsum(sizes) - sizes, sizes > 0
    middle = np.zeros(len(sizes))
    low, high = (value[known[(starts + k)[some]]] for k in ((sizes - 1) // 2, sizes // 2))
    middle[some] = 0.5 * low + 0.5 * high
    return middle[industry], ~some[industry]


def _column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    values, valid = arrays.series(table.column(name))
    return values, np.zeros(len(values), bool) if valid is None else ~valid


def training_set(catalog: FactorCatalog, panel: DataFrame, securities: DataFrame, calendar: DataFrame, flagged: Column, train_end, val_start, val_end, tiles: int = 10, tasks: int | None = None,
                 digits: dict[str, int] | None = None, rank_digits: int = 6) -> DataFrame:
    """(entity, trade_date, split, tile_5, tile_20, tile_60, features...): rows in the universe with all factors and labels.

    ``panel`` has raw columns of bars and fundamentals, ``label_path`` and ``back_5``, ``back_20``.
    Each feature is its percentile rank of the date, each label its tile of the date.  A row with
    entity NULL for each date stands for the risk-free rate; rows in the purged gap and after
    ``val_end`` go.  Rows go to the dates once, for medians, tiles and ranks.
    """
    factors, every = training_columns(catalog.names)
    ratios = [n for n in INDUSTRY_FACTORS if n in factors]
    labels = [f"label_{h}" for h in HORIZONS]
    ends = purge_embargo(calendar, train_end, val_start).first()
    known = securities.where("market <> 'AFRICA'").select("entity", F.coalesce("industry", F.lit("Unknown")).alias("industry"))
    rows = panel.join(known, "entity", "left").withColumn("split", split_dates(F.lit(ends["train_end"]), F.lit(ends["val_start"]), F.lit(val_end)))
    inside = F.col("industry").isNotNull() & F.col("split").isNotNull() & ~F.coalesce(flagged, F.lit(False)) & F.col("entity").isNotNull()
    for c in labels:
        inside &= F.col(c).isNotNull()
    rows = rows.withColumn("__inside", inside)
    industry_scale, scale = float(10**INDUSTRY_DIGITS), float(10**rank_digits)
    names = ["entity", "trade_date", "split", *[f"tile_{h}" for h in HORIZONS], *every]

    def finish(day) -> pa.Table:
        table, size = day.rows, day.rows.num_rows
        made = np.full((len(every), size + 1), 0.5)
        missing = np.zeros((len(every), size + 1), bool)
        place = {n: k for k, n in enumerate(every)}

        def ranked(name: str, value: np.ndarray, null: np.ndarray) -> None:
            out = xs.shares(value, null, np.zeros(size))
            made[place[name], :size] = np.floor(out * scale + 0.50001) / scale
            missing[place[name], :size] = null

        industry = np.asarray(table.column("industry").combine_chunks().dictionary_encode().indices).astype(np.int64)
        for name, value, null in day.factors():
            ranked(name, value, null)
            if name in ratios:
                middle, none = _industry_median(value, null, industry)
                middle = middle + 1e-8
                none = none | null | (middle == 0)
                ranked(f"{name}_ind", np.floor(value / np.where(none, 1.0, middle) * industry_scale + 0.50001) / industry_scale, none)
        for k in (5, 20):
            middle, none = _industry_median(*_column(table, f"back_{k}"), industry)
            ranked(f"ind_mom_{k}d", np.floor(middle * industry_scale + 0.50001) / industry_scale, none)
        entities, tile, found = xs.by_entity(table), xs.tiles_of(size, tiles) - 1, []
        for h in HORIZONS:
            value, null = _column(table, f"label_{h}")
            out = np.empty(size + 1, np.int32)
            out[xs.peers(value, null, entities)[0]] = tile
            out[size] = min(int(np.mean(value <= RISK_FREE * h / 252) * tiles), tiles - 1)
            found.append(pa.array(out))
        keys = [pa.concat_arrays([table.column(n).combine_chunks(), pa.array([last], table.schema.field(n).type)])
                for n, last in (("entity", None), ("trade_date", table.column("trade_date")[0].as_py()), ("split", table.column("split")[0].as_py()))]
        return pa.table([*keys, *found, *[pa.array(v, mask=m if m.any() else None) for v, m in zip(made, missing)]], names=names)

    schema = rows.select("entity", "trade_date", "split", *[F.lit(0).cast("int").alias(n) for n in names[3:6]], *[F.lit(0.0).alias(n) for n in every]).schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return catalog.by_date(rows, finish, schema, tasks, ("split", "industry", *labels, "back_5", "back_20"), "__inside", factors, True, digits)


def group_ids(rows: DataFrame) -> DataFrame:
    """(trade_date, group_id, n): contiguous query groups in date order."""
    sizes = rows.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("group_id", F.row_number().over(Window.orderBy("trade_date")) - 1)


def nearest_session(calendar: DataFrame, target, after: bool = True) -> Column:
    """Aggregate: first session at or after the target, else the last; or the last at or before it, else the first."""
    d, t = F.col("trade_date"), F.lit(target)
    return F.coalesce(F.min(F.when(d >= t, d)), F.min(d)) if after else F.coalesce(F.max(F.when(d <= t, d)), F.max(d))


def add_months(d: date, n: int) -> date:
    import calendar as cal

    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, cal.monthrange(y, m + 1)[1]))


def walkforward_windows(sessions: DataFrame, start: date, train_years: int = 4, gap_months: int = 2, test_months: int = 12, slide_months: int = 6) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end), ends snapped to sessions.

    Candidate windows are a few dates of the driver; sessions are looked up in Spark.
    """
    last = sessions.agg(F.max("trade_date")).first()[0]
    rows, fold = [], 0
    while last is not None:
        train_end = add_months(start, 12 * train_years)
        test_start = add_months(train_end, gap_months)
        if test_start > last:
            break
        test_end = min(add_months(test_start, test_months), last)
        if test_start < test_end:
            rows.append((fold, start, train_end, test_start, test_end))
            fold += 1
        start = add_months(start, slide_months)
    spark = sessions.sparkSession
    wanted = spark.createDataFrame(rows, "fold int, a date, b date, c date, d date")
    day = F.col("trade_date")
    snapped = sessions.select("trade_date").crossJoin(F.broadcast(wanted)).groupBy("fold").agg(
        F.coalesce(F.min(F.when(day >= F.col("a"), day)), F.min(day)).alias("train_start"), F.coalesce(F.max(F.when(day <= F.col("b"), day)), F.max(day)).alias("train_end"),
        F.coalesce(F.min(F.when(day >= F.col("c"), day)), F.min(day)).alias("test_start"), F.coalesce(F.max(F.when(day <= F.col("d"), day)), F.max(day)).alias("test_end"))
    return snapped.where("train_start < train_end and test_start < test_end")


def assign_folds(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """(fold, split, ...): rows of each fold's train and test range; windows are a few rows."""
    w, d = F.broadcast(windows), F.col("trade_date")
    split = F.when(d.between(F.col("train_start"), F.col("train_end")), "train").when(d.between(F.col("test_start"), F.col("test_end")), "test")
    hit = d.between(F.col("train_start"), F.col("train_end")) | d.between(F.col("test_start"), F.col("test_end"))
    return panel.join(w, hit).withColumn("split", split).drop("train_start", "train_end", "test_start", "test_end")


def time_holdout(rows: DataFrame, share: float = 0.1) -> DataFrame:
    """Flags the last share of dates."""
    dates = rows.select("trade_date").distinct()
    nth = dates.select("trade_date", F.row_number().over(Window.orderBy("trade_date")).alias("__nth"), F.count(F.lit(1)).over(Window.partitionBy()).alias("__n"))
    cut = nth.withColumn("holdout", F.col("__nth") > F.col("__n") - F.floor(F.col("__n") * share)).select("trade_date", "holdout")
    return rows.join(F.broadcast(cut), "trade_date")


def time_splits(rows: DataFrame, n: int = 5) -> DataFrame:
    """(split, side, ...): rows of n time-ordered splits; the test dates follow the train dates.

    Of the sorted dates, split k of n is tested on the k-th of the last n parts of
    ``dates // (n + 1)`` dates each and trained on all before it.  One row for each date is ordered.
    """
    dates = rows.select("trade_date").distinct()
    nth = dates.select("trade_date", (F.row_number().over(Window.orderBy("trade_date")) - 1).alias("__nth"), F.count(F.lit(1)).over(Window.partitionBy()).alias("__n"))
    each = F.floor(F.col("__n") / (n + 1))
    start = lambda k: F.col("__n") - (n - k) * each
    side = lambda k: F.when(F.col("__nth") < start(k), "train").when(F.col("__nth") < start(k) + each, "test")
    told = nth.select("trade_date", F.explode(F.array(*[F.struct(F.lit(k).alias("split"), side(k).alias("side")) for k in range(n)])).alias("x")).select("trade_date", "x.*").where("side is not null")
    return rows.join(F.broadcast(told), "trade_date")


def downsample_majority(rows: DataFrame, label: str, ratio: float = 1.0) -> DataFrame:
    """Rows with each class cut to ``ratio`` times the smallest one's size, exactly.

    A class keeps its rows with the least hashes of (entity, date), numbered range by range, so
    no class meets in one task and another run keeps the same rows.  Rows without a class go.
    """
    known = rows.where(F.col(label).isNotNull())
    # a row for each class
    quota = known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    key = F.md5(F.concat_ws("|", F.col("entity").cast("string"), F.col("trade_date").cast("string")))
    placed = order_stats.numbered(known.withColumn("__key", key), [F.col("__key").asc(), F.col("entity").asc(), F.col("trade_date").asc()], [label], "__place")
    return placed.where(F.col("__place") <= int(quota * ratio)).select(rows.columns)


def balance_classes(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` rows of each entity and class, in hash order."""
    order = F.md5(F.concat_ws("|", F.col("entity").cast("string"), F.col("trade_date").cast("string")))
    nth = F.row_number().over(Window.partitionBy("entity", label).orderBy(order, "trade_date"))
    return rows.withColumn("__nth", nth).where(F.col("__nth") <= most).drop("__nth")


#: Fixed values of the reward: least volatility, cost of a unit of change in position.
LEAST_VOLATILITY, COMMISSION = 1e-6, 0.0003


def scaled_reward(panel: DataFrame, position: str, horizons: tuple[int, ...] = (5, 20)) -> DataFrame:
    """``panel`` with ``reward``: the mean forward return in units of volatility, times the position, less the cost of changing it.

    Volatility is the mean true range of 14 rows over the close, LEAST_VOLATILITY at least.
    The position before an entity's first row is 0; no reward where a forward close or the
    volatility is missing.
    """
    ranged = panel.withColumn("__true_range", ts.true_range())
    ratio = ts.div(ts.mean("__true_range", 14), "close")
    volatility = F.when(ratio.isNotNull(), F.greatest(ratio, F.lit(LEAST_VOLATILITY)))
    gain = sum((ts.forward_return("close", h) for h in horizons), F.lit(0.0)) / len(horizons)
    change = F.abs(F.col(position) - F.coalesce(ts.ref(position, 1), F.lit(0.0)))
    return ranged.withColumn("reward", F.col(position) * (gain / volatility) - change * COMMISSION).drop("__true_range")
