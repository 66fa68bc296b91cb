"""Universe filters over (entity, trade_date) panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions import xs
from panelkit.operators.order_stats import numbered

KEYS = ["entity", "trade_date"]


def in_market(panel: DataFrame, securities: DataFrame, markets: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """Entities of the wanted markets; securities is a dimension, so the join can broadcast."""
    chosen = securities.where(F.col("market").isin(markets)) if markets else securities.where(~F.col("market").isin(without or []))
    return panel.join(chosen.select("entity"), "entity", "left_semi")


def exclude_flagged(panel: DataFrame, flags: DataFrame) -> DataFrame:
    return panel.join(flags.select(*KEYS), KEYS, "left_anti")


def min_price(panel: DataFrame, bars: DataFrame, least: float) -> DataFrame:
    return panel.join(bars.where(F.col("high") >= least).select(*KEYS), KEYS, "left_semi")


def quality(panel: DataFrame, cap: float = 500_000, turnover: float = 0.1, lower_pb: bool = True, zero_medians: float | None = 1e-6) -> DataFrame:
    """Industry-relative bands of pe_ttm and pb; rows with a missing input go first."""
    rows = panel.dropna(subset=["industry", "pe_ttm", "pb", "circ_mv", "turnover_rate"])
    pe, pb = xs.median("pe_ttm", "industry"), xs.median("pb", "industry")
    if zero_medians is not None:
        pe, pb = (F.when(m == 0, F.lit(zero_medians)).otherwise(m) for m in (pe, pb))
    rows = rows.withColumn("__pe", pe).withColumn("__pb", pb)
    keep = (F.col("circ_mv") >= cap) & (F.col("turnover_rate") >= turnover)
    keep &= (F.col("pe_ttm") > 0) & (F.col("pe_ttm") < F.col("__pe") * 1.5) & (F.col("pe_ttm") >= F.col("__pe") * 0.1)
    keep &= (F.col("pb") > 0) & (F.col("pb") < F.col("__pb") * 1.5)
    if lower_pb:
        keep &= F.col("pb") >= F.col("__pb") * 0.1
    return rows.where(keep).drop("__pe", "__pb")


def quality_lite(panel: DataFrame, flags: DataFrame, cap: float = 500_000, turnover: float = 0.1) -> DataFrame:
    return exclude_flagged(quality(panel, cap, turnover, lower_pb=False, zero_medians=None), flags)


def absolute_quality(panel: DataFrame, listed: str, cap: float, days: int = 365) -> DataFrame:
    return panel.where((F.datediff("trade_date", listed) >= days) & (F.col("circ_mv") >= cap) & F.col("pe_ttm").between(5, 40) & (F.col("pe_ttm") > 5) & (F.col("pe_ttm") < 40) & (F.col("pb") > 0) & (F.col("pb") < 10) & (F.col("turnover_rate") > 0.1))


def cap_percentile(panel: DataFrame, p: float) -> DataFrame:
    """Entities whose largest circ_mv is at or above the value at sorted index int(n p)."""
    most = panel.groupBy("entity").agg(F.max("circ_mv").alias("cap"))
    placed = numbered(most.where("cap is not null"), [F.col("cap").asc(), F.col("entity").asc()], out="__nth", size="__n")
    limit = placed.where(F.col("__nth") - 1 == F.floor(F.col("__n") * p)).select(F.col("cap").alias("limit"))
    # one row
    return panel.join(most.join(F.broadcast(limit)).where("cap >= limit").select("entity"), "entity", "left_semi")


def min_history(panel: DataFrame, days: int, most: int | None = None) -> DataFrame:
    """Entities with enough rows; at most ``most`` of them, chosen by the hash of the entity."""
    enough = panel.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= days)
    if most is not None:
        enough = enough.orderBy(F.md5(F.col("entity").cast("string")), "entity").limit(most)
    return panel.join(enough.select("entity"), "entity", "left_semi")
