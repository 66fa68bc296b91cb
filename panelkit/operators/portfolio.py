"""Weights, orders, memberships, fills and ledgers as table-to-table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import ts, xs

LOT = 100


def equal_or_score(score="score") -> Column:
    """Weight in proportion to the score if the date's scores differ by more than 5 %, else equal."""
    s, w = ts.col(score), xs.by_date()
    spread = F.max(s).over(w) > 1.05 * F.min(s).over(w)
    return F.when(spread & (F.sum(s).over(w) > 0), F.try_divide(s, F.sum(s).over(w))).otherwise(1.0 / F.count(F.lit(1)).over(w))


def inverse_variance(rows: DataFrame, vol: str, most: float = 0.25) -> DataFrame:
    raw = rows.withColumn("__raw", F.try_divide(F.lit(1.0), F.col(vol) * F.col(vol)))
    capped = raw.withColumn("__raw", F.least(xs.normalize("__raw"), F.lit(most)))
    return capped.withColumn("weight", xs.normalize("__raw")).drop("__raw")


def constrain(weights: DataFrame, universe: DataFrame) -> DataFrame:
    kept = weights.join(universe, ["entity", "trade_date"], "left_semi")
    return kept.withColumn("weight", xs.normalize("weight"))


def order_shares(weight, capital: float, price) -> Column:
    lots = F.floor(F.try_divide(ts.col(weight) * capital, ts.col(price)) / LOT) * LOT
    return F.when(ts.col(price) > 0, lots)


def order_cost(notional, rate: float = 0.0003, least: float = 5.0) -> Column:
    return F.greatest(ts.col(notional) * rate, F.lit(least))


def every_kth(sessions: DataFrame, k: int) -> DataFrame:
    """Sessions number 1, k + 1, 2 k + 1, ...; one row for each date."""
    nth = F.row_number().over(Window.orderBy("trade_date")) - 1
    return sessions.select("trade_date").distinct().withColumn("nth", nth).where(F.col("nth") % k == 0).select("trade_date")


def membership(scores: DataFrame, k: int, least: float) -> DataFrame:
    """(entity, trade_date, held): enters in the top k, leaves when out of them with a score under ``least``.

    The state is the last event, so it is one window over the entity's rows.
    """
    nth = F.row_number().over(xs.by_date().orderBy(F.desc_nulls_last("score"), "entity"))
    rows = scores.withColumn("__top", nth <= k)
    event = F.when(F.col("__top"), 1).when(F.coalesce("score", F.lit(0.0)) < least, 0)
    w = ts.over().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("held", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(0))).drop("__top")


def trades_diff(held: DataFrame) -> DataFrame:
    """Rows at which an entity enters or leaves."""
    was = F.coalesce(F.lag("held").over(ts.over()), F.lit(0))
    rows = held.withColumn("was", was).where("held <> was")
    return rows.select("entity", "trade_date", F.when(F.col("held") == 1, "enter").otherwise("leave").alias("action"))


def fill_triggered(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Fill prices of signals at the entity's next row of bars; null where not triggered."""
    following = bars.select("entity", "trade_date", F.lead("trade_date").over(ts.over()).alias("fill_date"), F.lead("low").over(ts.over()).alias("__l"), F.lead("high").over(ts.over()).alias("__h"))
    rows = signals.join(following, ["entity", "trade_date"])
    t = F.col("target_price")
    buy = F.when((t > 0) & (F.col("__l") <= t), F.greatest(t, F.col("__l") * 1.002))
    sell = F.when((t > 0) & (F.col("__h") >= t), F.least(t, F.col("__h") * 0.98))
    return rows.withColumn("fill_price", F.when(F.col("action") == "buy", buy).otherwise(sell)).drop("__l", "__h")


def positions(trades: DataFrame) -> DataFrame:
    """``trades`` (entity, trade_date, seq, action, shares, price, cost) with running shares and cash flow of the entity."""
    sign = F.when(F.col("action") == "buy", 1).otherwise(-1)
    w = Window.partitionBy("entity").orderBy("trade_date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = trades.withColumn("signed", sign * F.col("shares"))
    return out.select("*", F.sum("signed").over(w).alias("position"), F.sum(-F.col("signed") * F.col("price") - F.col("cost")).over(w).alias("cash_flow"))


def episodes(trades: DataFrame) -> DataFrame:
    """(entity, episode, start, end, bought, avg_cost, pnl): one row for each stretch from flat to flat.

    Average cost is that of all lots bought in the episode, exact when sells close it whole.
    """
    p = positions(trades)
    before = F.coalesce(F.lag("position").over(Window.partitionBy("entity").orderBy("trade_date", "seq")), F.lit(0))
    starts = F.sum(F.when(before == 0, 1).otherwise(0)).over(Window.partitionBy("entity").orderBy("trade_date", "seq").rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("__before", before).withColumn("episode", F.sum(F.when(F.col("__before") == 0, 1).otherwise(0)).over(Window.partitionBy("entity").orderBy("trade_date", "seq").rowsBetween(Window.unboundedPreceding, 0)))
    buy = F.col("signed") > 0
    return p.groupBy("entity", "episode").agg(
        F.min("trade_date").alias("start"), F.max("trade_date").alias("end"),
        F.sum(F.when(buy, F.col("shares")).otherwise(0)).alias("bought"),
        F.try_divide(F.sum(F.when(buy, F.col("shares") * F.col("price"))), F.sum(F.when(buy, F.col("shares")))).alias("avg_cost"),
        F.sum(-F.col("signed") * F.col("price") - F.col("cost")).alias("pnl"),
    )


def average_cost(trades: DataFrame) -> DataFrame:
    """``trades`` with filled, held, avg_cost, pnl and episode, where lots are sold in part and bought again.

    A sale takes no more than is held, and what it earns is counted against the average cost,
    less its fee; a buy moves the average cost; a sale doesn't.  ``avg_cost`` is what is in force
    at the row, so a sale has that of the shares it sold, and is null where nothing is held or sold.

    Holdings are a running sum reflected at zero.  An episode, from flat to flat, starts anew;
    inside it the average cost is a chain of affine maps, composed by :func:`ts.affine_scan`.
    """
    w = Window.partitionBy("entity").orderBy("trade_date", "seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = trades.withColumn("__asked", F.when(F.col("action") == "buy", F.col("shares")).otherwise(-F.col("shares")))
    out = out.withColumn("__sum", F.sum("__asked").over(so_far))
    out = out.withColumn("held", F.col("__sum") - F.least(F.min("__sum").over(so_far), F.lit(0)))
    out = out.withColumn("__was", F.coalesce(F.lag("held").over(w), F.lit(0)))
    out = out.withColumn("filled", F.col("held") - F.col("__was"))
    out = out.withColumn("episode", F.sum(F.when((F.col("__was") == 0) & (F.col("filled") > 0), 1).otherwise(0)).over(so_far))
    bought = F.col("filled") > 0
    share = F.try_divide(F.col("__was").cast("double"), F.col("held").cast("double"))
    fade = F.when(bought & (F.col("__was") > 0), -F.ln(share)).otherwise(F.lit(0.0))
    out = ts.affine_scan(out, ["entity", "episode"], ["trade_date", "seq"], fade, F.when(bought, (1 - share) * F.col("price")).otherwise(F.lit(0.0)), "__cost")
    out = out.withColumn("avg_cost", F.when((F.col("held") > 0) | (F.col("filled") < 0), F.col("__cost")))
    pnl = F.when(F.col("filled") < 0, (F.col("price") - F.col("__cost")) * -F.col("filled") - F.col("cost")).otherwise(F.lit(0.0))
    return out.withColumn("pnl", pnl).drop("__asked", "__sum", "__was", "__cost")


def nav(held: DataFrame, bars: DataFrame, cash: float) -> DataFrame:
    """(trade_date, market_value, total_value): shares times close, a missing price counts 0."""
    rows = held.join(bars.select("entity", "trade_date", "close"), ["entity", "trade_date"], "left")
    value = F.sum(F.col("shares") * F.coalesce("close", F.lit(0.0)))
    return rows.groupBy("trade_date").agg(value.alias("market_value")).withColumn("total_value", F.col("market_value") + cash)


def contributions(sessions: DataFrame, amount: float) -> DataFrame:
    """(trade_date, added): ``amount`` on the first session of each month but the very first session."""
    rows = sessions.select("trade_date").distinct()
    firsts = rows.groupBy(F.trunc("trade_date", "month").alias("m")).agg(F.min("trade_date").alias("trade_date"))
    start = F.min("trade_date").over(Window.partitionBy())
    return firsts.withColumn("__s", start).where("trade_date > __s").select("trade_date", F.lit(amount).alias("added"))


def trailing_stop(rows: DataFrame, p: float) -> DataFrame:
    """Flags rows whose previous close lies more than p under the peak up to that close; by (entity, episode)."""
    w = Window.partitionBy("entity", "episode").orderBy("trade_date")
    out = rows.withColumn("__c", F.lag("close").over(w)).withColumn("__p", F.max("close").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return out.withColumn("stop", F.coalesce(F.col("__c") < F.col("__p") * (1 - p), F.lit(False))).drop("__c", "__p")


def level_stop(close, stop) -> Column:
    return ts.col(close) < ts.col(stop)
