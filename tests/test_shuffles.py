"""What is shuffled: no row of factors, and ranks by date without a row for each column."""

import math
import random
from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelkit.functions import xs
from panelkit.plans import registry


def exchanges(df):
    """Columns of each shuffle of the plan."""
    found = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        if node.nodeName() == "Exchange":
            found.append(node.output().size())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("name", ["feat_price_volume", "feat_combined"])
def test_factors_are_not_shuffled(spark, small, name):
    widths = exchanges(registry.queries()[name](spark, small))
    assert widths and max(widths) < 50


def test_ranks_by_date(spark):
    rng = random.Random(3)
    some = [None, math.nan, 0.0, -0.0, 1.5, -2.0]
    rows = [(e if e else None, date(2020, 1, d), rng.choice(some + [rng.random()]), rng.choice([None, 7.0])) for d in (1, 2, 3) for e in range(rng.choice([1, 4, 23]))]
    df = spark.createDataFrame(rows, "entity long, trade_date date, v double, w double")
    ranks = {"rank_v": ("rank", "v"), "tile_w": ("tile", "w"), "tile_v": ("tile", "v")}
    by = lambda c, *more: Window.partitionBy("trade_date").orderBy(F.col(c).asc_nulls_last(), *more)
    got = xs.with_ranks(df, ["entity", "trade_date"], {"v": F.col("v"), "w": F.col("w")}, ranks, 5, "r")
    want = df.select("entity", "trade_date", F.array(F.rank().over(by("v")), F.ntile(5).over(by("w", "entity")), F.ntile(5).over(by("v", "entity"))).alias("r"))
    rows = lambda d: sorted((r[0] or 0, r[1], r[2]) for r in d.collect())
    assert rows(got) == rows(want)
    pct = xs.pct_rank_long(df, ["v", "w"])
    want = df.select("entity", "trade_date", F.struct(xs.pct_rank("v"), xs.pct_rank("w")))
    assert rows(pct.select("entity", "trade_date", F.struct("v", "w"))) == rows(want)
