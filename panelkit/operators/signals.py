"""Signals: tables of predictions or features to tables of signals and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import ts, xs
from panelkit.operators.dataset import session_ordinals

#: Weights of the 5, 20 and 60 row horizons.
WEIGHTS = {5: 0.35, 20: 0.32, 60: 0.33}
REGIMES = ["ranging", "support_test", "resistance_test", "breakout_up", "breakout_down"]


def ma_cross(features: DataFrame, short: str, long: str) -> DataFrame:
    """Golden and dead crosses against the previous session; a new entity gives no signal."""
    nth = session_ordinals(features.select("trade_date", F.lit(1).alias("is_open")))
    above = F.coalesce(F.col(short) > F.col(long), F.lit(False))
    rows = features.select("entity", "trade_date", above.alias("above")).join(F.broadcast(nth), "trade_date")
    rows = rows.withColumn("was", F.lag("above").over(ts.over())).withColumn("at", F.lag("nth").over(ts.over()))
    rows = rows.where((F.col("at") == F.col("nth") - 1) & (F.col("above") != F.col("was")))
    return rows.select("entity", "trade_date", F.when(F.col("above"), "buy").otherwise("sell").alias("action"), F.when(F.col("above"), 1.0).otherwise(0.0).alias("score"))


def ensemble(pred: dict[int, Column]) -> Column:
    return sum((pred[h] * w for h, w in WEIGHTS.items()), F.lit(0.0))


def quantile_ci(low: dict[int, Column], high: dict[int, Column]) -> Column:
    return (ensemble(high) - ensemble(low)) / 2


def predict_ci(low: dict[int, Column], high: dict[int, Column]) -> Column:
    return sum((F.abs(high[h] - low[h]) / 2 for h in low), F.lit(0.0)) / len(low)


def expected_level(probs: Column, reach: float, bins: int) -> tuple[Column, Column, Column]:
    """(expected ratio, confidence near it, probability of no level) of a distribution over price bins and one more."""
    step = 2 * reach / (bins - 2)
    prices = F.slice(probs, 1, bins - 1)
    mass = F.aggregate(prices, F.lit(0.0), lambda a, p: a + p)
    weighted = F.aggregate(F.transform(prices, lambda p, i: p * (i * step - reach)), F.lit(0.0), lambda a, p: a + p)
    expected = F.when(mass > 1e-6, F.try_divide(weighted, mass)).otherwise(F.lit(0.0))
    return expected, mass, F.get(probs, F.lit(bins - 1))


def near_mass(probs: Column, expected: Column, reach: float, bins: int) -> Column:
    step = 2 * reach / (bins - 2)
    near = lambda i: (i * step - reach > expected - 0.01) & (i * step - reach < expected + 0.01)
    return F.aggregate(F.transform(F.slice(probs, 1, bins - 1), lambda p, i: F.when(near(i), p).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, p: a + p)


def sr_decode(rows: DataFrame, up: str, down: str, reach: float, bins: int) -> DataFrame:
    """Expected moves, confidences, risk/reward ratio, entry and exit from two distributions."""
    e_up, m_up, _ = expected_level(F.col(up), reach, bins)
    e_down, m_down, _ = expected_level(F.col(down), reach, bins)
    out = rows.select("*", e_up.alias("expected_up"), e_down.alias("__down"), m_up.alias("__mu"), m_down.alias("__md"))
    conf = lambda p, e, m: near_mass(F.col(p), F.col(e), reach, bins) / F.greatest(F.col(m), F.lit(1e-6))
    out = out.select("*", (-F.col("__down")).alias("expected_down"), conf(up, "expected_up", "__mu").alias("resistance_confidence"), conf(down, "__down", "__md").alias("support_confidence"))
    out = out.withColumn("rr_ratio", F.abs("expected_up") / F.greatest(F.abs("expected_down"), F.lit(1e-6)))
    return out.withColumn("entry", (F.col("rr_ratio") > 2) & (F.col("support_confidence") > 0.1)).withColumn("exit", F.col("resistance_confidence") > 0.3).drop("__down", "__mu", "__md")


def sr_orders(decoded: DataFrame, close: str = "close") -> DataFrame:
    """Buy and sell rows with target and stop prices, from decoded distributions."""
    c = F.col(close)
    buy_at, sell_at = c * (1 + F.col("expected_down")), c * (1 + F.col("expected_up"))
    row = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, ("action", "score", "target_price", "stop_price"))])
    buy = F.when(F.col("entry"), row(F.lit("buy"), F.least(F.col("rr_ratio") * F.col("support_confidence"), F.lit(1.0)), buy_at, buy_at * 0.93))
    sell = F.when(F.col("exit"), row(F.lit("sell"), F.col("resistance_confidence"), sell_at, F.lit(0.0)))
    both = F.filter(F.array(buy, sell), lambda x: x.isNotNull())
    return decoded.select("entity", "trade_date", F.explode(both).alias("x")).select("entity", "trade_date", "x.*")


def regime_decode(probs: str) -> tuple[Column, Column, Column]:
    """(most probable regime, its probability, its name)."""
    most = F.array_max(probs)
    at = F.array_position(F.col(probs), most) - 1
    return at.cast("int"), most, F.element_at(F.array(*map(F.lit, REGIMES)), (at + 1).cast("int"))


def sell_confident_low(rows: DataFrame, least: float, upper: float) -> DataFrame:
    return rows.where((F.col("confidence") >= least) & (F.col("score") + F.col("ci") < upper))


def adjust_kelly(scores: DataFrame, history: DataFrame) -> DataFrame:
    """score times min(mean / variance, 3) for entities with three or more rows of history."""
    h = history.groupBy("entity").agg(F.count(F.lit(1)).alias("__n"), F.avg("score").alias("__m"), F.var_samp("score").alias("__v"))
    f = F.least(F.col("__m") / (F.col("__v") + 1e-8), F.lit(3.0))
    return scores.join(h, "entity", "left").withColumn("adjusted", F.when(F.col("__n") >= 3, F.col("score") * f).otherwise(F.col("score"))).drop("__n", "__m", "__v")


def adjust_momentum(scores: DataFrame, history: DataFrame) -> DataFrame:
    h = history.groupBy("entity").agg(F.count(F.lit(1)).alias("__n"))
    return scores.join(h, "entity", "left").withColumn("adjusted", F.col("score") * (1 + F.least(F.coalesce("__n", F.lit(0)) / 5.0, F.lit(1.0)))).drop("__n")


def adjust_vol(score, vol) -> Column:
    return ts.col(score) / (F.coalesce(ts.col(vol), F.lit(0.0)) + 1e-8)


def low_scores(rows: DataFrame, p: float) -> DataFrame:
    """Flags scores below the date's percentile."""
    return rows.withColumn("low", F.col("score") < xs.percentile("score", p))
