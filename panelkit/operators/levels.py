"""Level panel: derived features, Keltner channel, and nearest support and resistance ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions import ts

#: Half-width of the centred window and how far ahead levels are looked for.
HORIZONS = {"short": (2, 5), "mid": (10, 20), "long": (30, 60)}
#: The names of the derived columns.
FEATURES = ["volume_ratio", "hl_ratio", "ret_5d", "close_ma20", "atr_ratio", "vol_change", "amt_change", "keltner_pos", "keltner_width", "keltner_above_ema"]


def derived(panel: DataFrame) -> DataFrame:
    """``panel`` with FEATURES, missing values filled as documented: ratio 1, everything else 0."""
    positive = lambda x: F.when(F.col(x) != 0, F.col(x))
    out = panel.withColumn("__rn", ts.row_number()).withColumn("__tr", ts.true_range())
    out = ts.with_ewm(out, "close", 20, "__ema").withColumn("__atr20", ts.mean("__tr", 20)).withColumn("__c", positive("close"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.select(
        "*",
        F.coalesce(ts.div("volume", F.avg(positive("volume")).over(ts.trailing(20))), F.lit(1.0)).alias("volume_ratio"),
        zero(ts.div(F.col("high") - F.col("low"), "close")).alias("hl_ratio"),
        zero(ts.back_return("close", 5)).alias("ret_5d"),
        zero(ts.div("close", F.avg("__c").over(ts.trailing(20))) - 1).alias("close_ma20"),
        zero(ts.div(ts.mean("__tr", 14), "close")).alias("atr_ratio"),
        zero(ts.log_change("volume")).alias("vol_change"),
        zero(ts.log_change("amount")).alias("amt_change"),
        zero(ts.div(F.col("close") - F.col("__ema"), F.col("__atr20") * 2)).alias("keltner_pos"),
        zero(ts.div("__atr20", "__ema")).alias("keltner_width"),
        zero(ts.div("close", "__ema") - 1).alias("keltner_above_ema"),
    )
    return out.drop("__tr", "__ema", "__atr20", "__c")


def levels(panel: DataFrame) -> DataFrame:
    """``panel`` (with a stored __rn) plus, for each horizon, price and distance of the next verified peak and trough."""
    out = panel
    for n in sorted({n for n, _ in HORIZONS.values()}):
        out = out.withColumn(f"__peak{n}", ts.local_peak("high", n)).withColumn(f"__trough{n}", ts.local_trough("low", n))
        out = out.withColumn(f"__peak{n}", ts.verified_peak(f"__peak{n}", "high")).withColumn(f"__trough{n}", ts.verified_trough(f"__trough{n}", "low"))
    for name, (n, ahead) in HORIZONS.items():
        out = out.withColumn(f"__r{name}", ts.nearest_future(f"__peak{n}", "high", "__rn", ahead)).withColumn(f"__s{name}", ts.nearest_future(f"__trough{n}", "low", "__rn", ahead))
    columns = []
    for name in HORIZONS:
        for side, key in (("resistance", "r"), ("support", "s")):
            found = F.col(f"__{key}{name}")
            columns += [found["price"].alias(f"{side}_{name}"), (found["number"] - F.col("__rn")).alias(f"{side}_{name}_dist")]
    return out.select(*[c for c in panel.columns if not c.startswith("__")], *columns)


def panel_levels(panel: DataFrame) -> DataFrame:
    """One row for each entity and session: bars, derived features and levels; no shuffle but by entity."""
    return levels(derived(panel))
