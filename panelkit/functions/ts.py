"""Time-series Column builders: rows of one entity in date order.

Every builder takes Columns or names and returns a Column.  All trailing frames share one
window specification, so any number of them in one select costs one shuffle and one sort.
Missing values are NULL; divisions by zero give NULL.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ENTITY, DATE = "entity", "trade_date"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def over() -> WindowSpec:
    return Window.partitionBy(ENTITY).orderBy(DATE)


def rows(first: int, last: int) -> WindowSpec:
    return over().rowsBetween(first, last)


def trailing(n: int) -> WindowSpec:
    return rows(-(n - 1), 0)


def div(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def ref(x, n: int) -> Column:
    return F.lag(col(x), n).over(over())


def delta(x, n: int) -> Column:
    return col(x) - ref(x, n)


def mean(x, n: int) -> Column:
    return F.avg(col(x)).over(trailing(n))


def std(x, n: int) -> Column:
    return F.stddev_samp(col(x)).over(trailing(n))


def total(x, n: int) -> Column:
    return F.sum(col(x)).over(trailing(n))


def high(x, n: int) -> Column:
    return F.max(col(x)).over(trailing(n))


def low(x, n: int) -> Column:
    return F.min(col(x)).over(trailing(n))


def corr(x, y, n: int) -> Column:
    """Rolling Pearson correlation; NULL where a side is constant or there is one row."""
    w = trailing(n)
    both = F.stddev_samp(col(x)).over(w) * F.stddev_samp(col(y)).over(w)
    return F.try_divide(F.covar_samp(col(x), col(y)).over(w), both)


def row_number() -> Column:
    return F.row_number().over(over())


def window_position(n: int) -> Column:
    """Place of the row among the last n rows, from 0."""
    return F.least(row_number() - 1, F.lit(n - 1))


def ema_weighted(x, n: int, position) -> Column:
    """Ratio of weighted sums; a row weighs ((n-1)/(n+1)) to the power of its own stored position.

    Positions stop growing at n - 1, so after 2 n - 1 rows all weights are equal.
    """
    weight = F.pow(F.lit((n - 1) / (n + 1)), col(position))
    return F.try_divide(F.sum(col(x) * weight).over(trailing(n)), F.sum(weight).over(trailing(n)))


def ewm(x, span: int, number: Column) -> Column:
    """The same mean as a Column, for short spans; ``number`` is a stored :func:`row_number`.

    Folds as many rows as the span asks for: what lies before weighs less than 2^-60.
    :func:`with_ewm` does without a frame.
    """
    a = 2.0 / (span + 1)
    size = ceil(60 * log(2) / -log(1 - a)) if a < 1 else 1
    frame = F.collect_list(col(x)).over(rows(-size, 0))
    seed = F.when(number <= size + 1, F.lit(None).cast("double")).otherwise(F.lit(0.0))
    return F.aggregate(frame, seed, lambda acc, z: F.coalesce(acc * (1 - a) + z * a, z))


def with_ewm(df: DataFrame, x: str, span: int, out: str) -> DataFrame:
    """``df`` with the recursive exponential mean of a column, for any span; missing values are passed over.

    A step is the affine map y -> b y + (1 - b) x.  Maps are composed inside blocks of an
    entity's values by one running sum each, then from block to block.  Blocks are as long as
    the weights b^-k can be held, 2^500, so what lies before the last two blocks weighs less
    than 2^-500 of what is in them: no double can tell.  All windows have one order by entity
    and date, a row carries a few numbers whatever the span, and there is one more sort.
    """
    keep, b = df.columns, 1 - 2.0 / (span + 1)
    length = max(1, int(500 * log(2) / -log(b))) if b > 0 else 1
    entity, block = over(), Window.partitionBy(ENTITY, "__block").orderBy(DATE)
    so_far = entity.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.count(col(x)).over(so_far)  # from 1; rows before the first value have 0
    t = df.select("*", number.alias("__number"))
    place = F.greatest(F.col("__number") - 1, F.lit(0))
    t = t.select("*", F.floor(place / length).alias("__block"), (place % length).cast("double").alias("__k"))
    if b == 0:
        return t.select(*keep, F.last(x, ignorenulls=True).over(so_far).alias(out))
    # the first value of all is taken whole
    step = F.when(F.col("__number") == 1, F.lit(1.0)).otherwise(F.lit(1 - b)) * col(x) * F.pow(F.lit(b), -F.col("__k"))
    running = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.select("*", (F.sum(step).over(running) * F.pow(F.lit(b), F.col("__k"))).alias("__own"))
    t = t.select("*", F.pow(F.lit(b), F.col("__k") + 1).alias("__fade"), F.col("__own").alias("__y"))
    for _ in range(2):
        # what the block before ended with, by the maps known so far
        t = t.withColumn("__last", F.lag("__y").over(Window.partitionBy(ENTITY).orderBy("__block", DATE)))
        t = t.withColumn("__from", F.first("__last").over(running)).withColumn("__y", F.col("__own") + F.when(F.col("__block") > 0, F.col("__fade") * F.col("__from")).otherwise(F.lit(0.0)))
    return t.select(*keep, F.when(F.col("__number") > 0, F.col("__y")).alias(out))


def affine_scan(df: DataFrame, keys: list[str], order: list[str], fade, add, out: str) -> DataFrame:
    """``df`` with y of the recursion y -> exp(-fade) y + add, from 0 before a key's first row; ``fade`` is 0 or more.

    The maps of a block are composed by one running sum.  A block ends where they have faded by
    e^345; beyond the block before the last one they can't be told in a double any more.
    """
    keep, most = df.columns, 345.0
    rising = Window.partitionBy(*keys).orderBy(*order)
    t = df.select("*", F.sum(fade).over(rising.rowsBetween(Window.unboundedPreceding, 0)).alias("__faded"), add.alias("__add"))
    t = t.withColumn("__block", F.floor(F.col("__faded") / most))
    block = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.col("__faded") - F.col("__block") * most
    t = t.withColumn("__own", F.sum(F.col("__add") * F.exp(inside)).over(block) * F.exp(-inside)).withColumn("__y", F.col("__own"))
    again = Window.partitionBy(*keys).orderBy("__block", *order)
    for _ in range(2):
        t = t.withColumn("__last", F.when(F.lag("__block").over(again) < F.col("__block"), F.struct(F.lag("__y").over(again).alias("y"), F.lag("__faded").over(again).alias("faded"))))
        t = t.withColumn("__from", F.first("__last").over(block))
        t = t.withColumn("__y", F.col("__own") + F.coalesce(F.col("__from.y") * F.exp(F.col("__from.faded") - F.col("__faded")), F.lit(0.0)))
    return t.select(*keep, F.col("__y").alias(out))


def reg_slope(x, n: int, number: Column) -> Column:
    return F.regr_slope(col(x), number).over(trailing(n))


def rsi(change: Column, n: int) -> Column:
    """``change`` is the stored first difference; a missing one counts as 0 in both averages."""
    gain = F.avg(F.when(change > 0, change).otherwise(F.lit(0.0))).over(trailing(n))
    loss = F.avg(F.when(change < 0, -change).otherwise(F.lit(0.0))).over(trailing(n))
    return F.lit(100.0) - F.try_divide(F.lit(100.0), 1 + F.try_divide(gain, loss))


def minmax(x, n: int) -> Column:
    return F.try_divide(col(x) - low(x, n), high(x, n) - low(x, n))


def lead(x, n: int) -> Column:
    return F.lead(col(x), n).over(over())


def forward_low(x, n: int) -> Column:
    return F.min(col(x)).over(rows(0, n))


def forward_high(x, n: int) -> Column:
    return F.max(col(x)).over(rows(0, n))


def back_return(x, n: int) -> Column:
    return div(x, ref(x, n)) - 1


def forward_return(x, n: int) -> Column:
    return div(lead(x, n), x) - 1


def true_range(h="high", l="low", c="close") -> Column:
    previous = ref(c, 1)
    return F.greatest(col(h) - col(l), F.abs(col(h) - previous), F.abs(col(l) - previous))


def log_change(x) -> Column:
    ratio = div(x, ref(x, 1))
    return F.when(ratio > 0, F.ln(ratio))


def local_peak(x, n: int) -> Column:
    return col(x) == F.max(col(x)).over(rows(-n, n))


def local_trough(x, n: int) -> Column:
    return col(x) == F.min(col(x)).over(rows(-n, n))


def verified_peak(flag, x, move: float = 0.005, ahead: int = 3) -> Column:
    """A peak after which the price falls by ``move`` within ``ahead`` rows; the last row keeps its flag."""
    least = F.min(col(x)).over(rows(1, ahead))
    return col(flag) & F.coalesce(F.try_divide(col(x) - least, col(x)) >= move, F.lit(True))


def verified_trough(flag, x, move: float = 0.005, ahead: int = 3) -> Column:
    most = F.max(col(x)).over(rows(1, ahead))
    return col(flag) & F.coalesce(F.try_divide(most - col(x), col(x)) >= move, F.lit(True))


def nearest_future(flag, x, number, ahead: int) -> Column:
    """Struct (number, price) of the first flagged row after this one, within ``ahead`` rows."""
    found = F.when(col(flag), F.struct(col(number).alias("number"), col(x).alias("price")))
    return F.first(found, ignorenulls=True).over(rows(1, ahead))


def vol_spike(x="volume", near: int = 3, far: int = 60) -> Column:
    return F.try_divide(F.avg(col(x)).over(rows(-near, -1)), F.avg(col(x)).over(rows(-far, -1)))


def realized_vol(returns, closes: Column, floor: float = 0.01, n: int = 20, least: int = 6) -> Column:
    """Annualised deviation of the last n stored returns; ``closes`` counts the closes seen."""
    vol = F.stddev_samp(col(returns)).over(trailing(n)) * F.sqrt(F.lit(252.0))
    return F.when(closes < least, F.lit(2 * floor)).otherwise(F.greatest(vol, F.lit(floor)))


def running_peak(x, *keys: str) -> Column:
    w = Window.partitionBy(*(keys or (ENTITY,))).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    return F.max(col(x)).over(w)


def drawdown(x, *keys: str) -> Column:
    return div(x, running_peak(x, *keys)) - 1


def period_return(value, added, *keys: str) -> Column:
    """Return of one period with contributions taken out."""
    w = Window.partitionBy(*(keys or (ENTITY,))).orderBy(DATE)
    return F.try_divide(col(value) - col(added), F.lag(col(value)).over(w)) - 1
