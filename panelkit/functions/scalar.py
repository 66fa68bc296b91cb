"""Scalar Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelkit.functions.ts import col


def clip(x, lo: float, hi: float) -> Column:
    return F.greatest(F.least(col(x), F.lit(hi)), F.lit(lo))


def parse_date(text) -> Column:
    return F.to_date(col(text), "yyyyMMdd")


def format_date(date, pattern: str = "yyyyMMdd") -> Column:
    return F.date_format(col(date), pattern)


def date_path(date) -> Column:
    return F.concat(format_date(date, "yyyy_MM_dd"), F.lit(".parquet"))


def month_key(date) -> Column:
    return format_date(date, "yyyyMM")


def cyclical_date(date) -> list[Column]:
    """Sine and cosine of the day of the year over 365 and 90, and the quarter over 4."""
    day, turn = F.dayofyear(col(date)), 2 * math.pi
    out = []
    for name, period in (("year", 365.0), ("season", 90.0)):
        angle = day / period * turn
        out += [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]
    return [*out, (F.quarter(col(date)) / 4.0).alias("quarter_part")]


def keltner_regime(pos) -> Column:
    """0 ranging, 1 support test, 2 resistance test, 3 breakout up, 4 breakout down."""
    pos = col(pos)
    return F.when(pos > 1.0, 3).when(pos < -1.0, 4).when(pos >= 0.5, 2).when(pos <= -0.5, 1).otherwise(0)


def scenario_label(pos, vol, close, open_, slope, lift: float = 0.005) -> Column:
    """4 breakout, 3 rejection, 2 false breakdown, 1 bounce, 5 before a trend, 0 ranging; first match wins."""
    pos, vol, slope, green = col(pos), col(vol), col(slope), col(close) >= col(open_)
    return (
        F.when((pos > 1.0) & (vol > 1.3), 4)
        .when(pos > 1.0, 3)
        .when((pos < -1.0) & (vol > 1.3) & ~green, 2)
        .when((pos < -1.0) & green, 1)
        .when((pos > 0.3) & (pos < 0.8) & (slope > lift) & (vol > 1.0), 5)
        .otherwise(0)
    )


def sr_bin(level, price, reach: float, bins: int) -> Column:
    """Bin of a level's distance to the price within +-reach; bin ``bins - 1`` marks no level."""
    ratio = F.try_divide(col(level) - col(price), col(price))
    place = ((ratio / reach + 1) * (bins - 1) / 2).cast("int")
    return F.when(ratio.isNull(), F.lit(bins - 1)).otherwise(F.greatest(F.least(place, F.lit(bins - 2)), F.lit(0)))


def sr_weight(distance) -> Column:
    return F.coalesce(1 / (1 + col(distance) / 5.0), F.lit(1.0))


def trend_signal(x, limit: float = 0.3) -> Column:
    return F.when(col(x) > limit, "long").when(col(x) < -limit, "short").otherwise("neutral")
