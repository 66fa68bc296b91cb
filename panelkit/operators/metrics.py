"""Evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import xs


def average_rank(x: str) -> Column:
    w = xs.by_date().orderBy(F.col(x))
    ties = Window.partitionBy("trade_date", x)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def rank_ic(rows: DataFrame, pred: str = "pred", true: str = "actual") -> DataFrame:
    """(n_dates, ic_mean, ic_std, icir) of the Spearman correlation of each date with three rows or more."""
    good = rows.dropna(subset=[pred, true]).withColumn("__a", average_rank(pred)).withColumn("__b", average_rank(true))
    ic = F.try_divide(F.covar_samp("__a", "__b"), F.stddev_samp("__a") * F.stddev_samp("__b"))
    by_date = good.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), ic.alias("ic")).where("n >= 3 and ic is not null")
    out = by_date.agg(F.count(F.lit(1)).alias("n_dates"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"))
    return out.withColumn("icir", F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std")).otherwise(F.lit(0.0)))


def pinball(true, pred, a: float) -> Column:
    d = F.col(true) - F.col(pred)
    return F.avg(F.greatest(a * d, (a - 1) * d))


def confusion(rows: DataFrame, true: str, pred: str, classes: int) -> DataFrame:
    return rows.groupBy(true).pivot(pred, list(range(classes))).agg(F.count(F.lit(1))).na.fill(0)


def macro_f1(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """(accuracy, macro_f1) over the classes that appear in either column."""
    pairs = rows.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("t").alias("c"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("real"), F.lit(0).cast("long").alias("told")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("real"), F.col("n").alias("told")))).alias("x")).select("x.*")
    by_class = sides.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("real").alias("real"), F.sum("told").alias("told"))
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("real") + F.col("told"))).otherwise(F.lit(0.0))
    return by_class.agg((F.sum("tp") / F.sum("real")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def in_top(probs: Column, true: Column, k: int = 3) -> Column:
    """Whether the true bin (from 0) is among the k most probable, lower bins first among equals."""
    ranked = F.transform(F.sort_array(F.transform(probs, lambda p, i: F.struct((-p).alias("p"), i.alias("i")))), lambda x: x["i"])
    return F.array_contains(F.slice(ranked, 1, k), true)


def peak_hits(rows: DataFrame, probs: str, true: str, last: str, k: int = 3) -> DataFrame:
    """One row: n, peaks, hit (true bin among the k most probable), peak_found and hit_given_peak.

    The last bin stands for no peak.  A peak is found right if the most probable bin and the
    true one agree on whether there is one; hits given a peak count only rows that have one.
    """
    p, t, none = F.col(probs), F.col(true), F.col(last)
    top = F.array_position(p, F.array_max(p)) - 1
    hit = in_top(p, t, k).cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum((t != none).cast("long")).alias("peaks"), F.avg(hit).alias("hit"),
        F.avg(((top != none) == (t != none)).cast("double")).alias("peak_found"), F.avg(F.when(t != none, hit)).alias("hit_given_peak"))


def entropy(probs: Column) -> Column:
    return F.aggregate(probs, F.lit(0.0), lambda a, p: a - p * F.ln(p + 1e-8))


def cross_entropy(probs: Column, true: Column) -> Column:
    return -F.ln(F.get(probs, true) + 1e-8)


def reward_stats(rows: DataFrame) -> DataFrame:
    """One row: entities' reward mean, deviation, Sharpe and compound return, then their mean, median and win rate."""
    r = F.col("reward")
    by = rows.groupBy("entity").agg(F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), (F.product(1 + r) - 1).alias("total"))
    by = by.withColumn("sharpe", F.coalesce(F.try_divide("mean", "std"), F.lit(0.0)) * F.sqrt(F.lit(252.0)))
    return by.agg(F.count(F.lit(1)).alias("entities"), F.avg("mean").alias("mean_reward"), F.avg("total").alias("mean_total"), F.median("total").alias("median_total"), F.avg("sharpe").alias("mean_sharpe"), F.avg((F.col("total") > 0).cast("double")).alias("win_rate"))


def equity_metrics(nav: DataFrame, invested: float, rate: float = 0.025) -> DataFrame:
    """One row from (trade_date, total_value, added): returns, Sharpe, drawdown and its date.

    The series has one row for each session; it is ordered in one partition.
    """
    w = Window.orderBy("trade_date")
    s = nav.withColumn("ret", F.try_divide(F.col("total_value") - F.col("added"), F.lag("total_value").over(w)) - 1)
    s = s.withColumn("dd", F.try_divide("total_value", F.max("total_value").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1)
    one = s.agg(
        F.max_by("total_value", "trade_date").alias("final_value"), (F.sum("added") + invested).alias("total_invested"), F.count(F.lit(1)).alias("n"),
        F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"), F.min("dd").alias("max_drawdown"), F.min_by("trade_date", F.struct("dd", "trade_date")).alias("dd_date"))
    return one.select(
        "final_value", "total_invested", (F.col("final_value") / F.col("total_invested") - 1).alias("cumulative_return"),
        (F.pow(F.col("final_value") / F.col("total_invested"), F.lit(252.0) / F.col("n")) - 1).alias("annualized_return"),
        F.coalesce(F.try_divide(F.col("m") * 252 - rate, F.col("sd") * F.sqrt(F.lit(252.0))), F.lit(0.0)).alias("sharpe"),
        "max_drawdown", F.when(F.col("max_drawdown") < 0, F.col("dd_date")).alias("max_drawdown_date"))


def position_win_rate(sells: DataFrame) -> DataFrame:
    """Share of positions (entity, buy_date) whose summed pnl is positive."""
    by = sells.groupBy("entity", "buy_date").agg(F.sum("pnl").alias("pnl"))
    return by.agg(F.count(F.lit(1)).alias("positions"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
