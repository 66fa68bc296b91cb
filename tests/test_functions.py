"""Exact values of window functions, levels, ledgers and filters on small tables."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelkit.functions import scalar, ts, xs
from panelkit.operators import catalog, dataset, levels, metrics, portfolio, sequences, signals, universe
from panelkit.sources import io

DAY = date(2024, 1, 1)


def series(spark, values, **more):
    names = ["entity", "trade_date", "close", *more]
    rows = [(1, DAY + timedelta(days=k), v, *[m[k] for m in more.values()]) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, names)


def column(df, c):
    return [r[0] for r in df.orderBy("entity", "trade_date").select(c).collect()]


def test_constant_and_missing_values(spark):
    df = series(spark, [5.0, 5.0, 0.0, 5.0], volume=[1.0, 1.0, 1.0, 1.0])
    assert column(df.withColumn("x", ts.corr("close", "volume", 3)), "x") == [None] * 4
    assert column(df.withColumn("x", ts.back_return("close", 1)), "x") == [None, 0.0, -1.0, None]
    assert column(df.withColumn("x", ts.minmax("close", 2)), "x") == [None, None, 0.0, 1.0]


def test_ewm_equals_the_recursion(spark):
    values = [float((k * 37) % 101) + 1 for k in range(900)]
    got = column(series(spark, values).withColumn("rn", ts.row_number()).withColumn("x", ts.ewm("close", 20, F.col("rn"))), "x")
    want, e = [], None
    for v in values:
        e = v if e is None else e * (19 / 21) + v * (2 / 21)
        want.append(e)
    assert got == pytest.approx(want, rel=1e-12)


def test_nearest_level_ahead(spark):
    prices = [1.0, 3.0, 2.0, 5.0, 1.0]
    df = series(spark, prices, flag=[False, True, False, True, False]).withColumn("rn", ts.row_number())
    near = df.withColumn("n", ts.nearest_future("flag", "close", "rn", 2))
    assert column(near.withColumn("p", F.col("n")["price"]), "p") == [3.0, 5.0, 5.0, None, None]


def test_ranks_with_ties_and_missing(spark):
    rows = [(k, DAY, v) for k, v in enumerate([3.0, 1.0, 3.0, None, 2.0])]
    df = spark.createDataFrame(rows, "entity long, trade_date date, v double")
    assert column(df.withColumn("x", xs.pct_rank("v")), "x") == [0.875, 0.25, 0.875, None, 0.5]
    assert column(df.withColumn("x", xs.rank("v")), "x") == [3, 1, 3, 5, 2]
    wide = xs.pct_rank_long(df.withColumn("u", -F.col("v")), ["v", "u"])
    assert column(wide, "v") == [0.875, 0.25, 0.875, None, 0.5] and column(wide, "u") == [0.375, 1.0, 0.375, None, 0.75]


def test_catalog_sizes_and_names():
    assert (len(catalog.price_volume().names), len(catalog.extended().names), len(catalog.fundamental().names), len(catalog.combined().names)) == (191, 13, 8, 212)
    with pytest.raises(ValueError):
        catalog.price_volume().add(catalog.price_volume().factors["REF_open_1"])


def test_drawdown_and_win_rate(spark):
    nav = spark.createDataFrame([(DAY + timedelta(days=k), v, 0.0) for k, v in enumerate([100.0, 120.0, 110.0, 96.0, 130.0])], "trade_date date, total_value double, added double")
    r = metrics.equity_metrics(nav, 100.0).first()
    assert r["max_drawdown"] == pytest.approx(-0.2) and r["max_drawdown_date"] == DAY + timedelta(days=3)
    assert r["cumulative_return"] == pytest.approx(0.3)
    sells = spark.createDataFrame([(1, "a", 10.0), (2, "a", -5.0), (3, "a", 2.0)], "entity long, buy_date string, pnl double")
    assert metrics.position_win_rate(sells).first()["win_rate"] == pytest.approx(2 / 3)


def test_episodes_and_lots(spark):
    trades = spark.createDataFrame([(1, DAY, 0, "buy", 100, 10.0, 0.0), (1, DAY + timedelta(days=1), 0, "buy", 100, 12.0, 0.0), (1, DAY + timedelta(days=2), 0, "sell", 200, 13.0, 0.0)], "entity long, trade_date date, seq int, action string, shares int, price double, cost double")
    r = portfolio.episodes(trades).first()
    assert r["avg_cost"] == 11.0 and r["bought"] == 200 and r["pnl"] == pytest.approx(400.0)
    shares = spark.createDataFrame([(0.6, 10.0), (0.2, 10.0), (0.5, 0.0)], "w double, p double").select(portfolio.order_shares("w", 100_000.0, "p").alias("s")).collect()
    assert [r["s"] for r in shares] == [6000, 2000, None]


def test_cross_needs_the_session_before(spark):
    rows = [(1, 0, 1.0, 2.0), (1, 1, 3.0, 2.0), (2, 0, 3.0, 2.0), (2, 2, 1.0, 2.0), (3, 2, 5.0, 1.0), (1, 2, 1.0, 2.0)]
    df = spark.createDataFrame([(e, DAY + timedelta(days=d), s, l) for e, d, s, l in rows], "entity long, trade_date date, s double, l double")
    got = {(r["entity"], (r["trade_date"] - DAY).days, r["action"]) for r in signals.ma_cross(df, "s", "l").collect()}
    assert got == {(1, 1, "buy"), (1, 2, "sell")}


def test_trailing_stop_uses_the_close_before(spark):
    df = series(spark, [100.0, 120.0, 100.0, 130.0]).withColumn("episode", F.lit(1))
    assert column(portfolio.trailing_stop(df, 0.1), "stop") == [False, False, False, True]


def test_sequence_ratio_and_last_row(spark):
    df = series(spark, [float(k + 10) for k in range(12)])
    seqs = sequences.build(df, ["close"], 5)
    assert seqs.count() == 7  # twelve rows have eight windows of five; the last row has none
    first = sequences.normalize(seqs, ["close"], ["close"], None).orderBy("trade_date").first()
    assert first["close"][0] == pytest.approx(10 / 14 - 1) and first["close"][-1] == 0.0


def test_universe_and_registry(spark):
    bars = series(spark, [5.0, 6.0], high=[9.0, 11.0])
    assert universe.min_price(bars, bars, 10.0).count() == 1
    log = spark.createDataFrame([("a", DAY, 1, "2024-01-01 00:00:00"), ("a", DAY, 2, "2024-01-02 00:00:00"), ("a", None, 3, "2024-01-01 00:00:00"), ("b", DAY, 4, "2024-01-01 00:00:00")], "api_name string, trade_date date, row_count long, pull_time string").withColumn("pull_time", F.to_timestamp("pull_time"))
    assert sorted(r["row_count"] for r in io.registry_current(log).collect()) == [2, 3, 4]
    assert sorted(r["row_count"] for r in io.registry_current(io.registry_delete_since(log, "a", DAY, "2025-01-01 00:00:00")).collect()) == [3, 4]


def test_merge_columns_prefers_new_values(spark):
    old = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 6.0)], "k int, x double, y double")
    new = spark.createDataFrame([(2, 9.0, 7.0), (3, 8.0, None)], "k int, x double, z double")
    got = {r["k"]: (r["x"], r["y"], r["z"]) for r in io.merge_columns(old, new, ["k"]).collect()}
    assert got == {1: (1.0, 5.0, None), 2: (9.0, 6.0, 7.0), 3: (8.0, None, None)}


def test_partition_overwrite_keeps_other_dates(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    io.write_partition(series(spark, [1.0, 2.0]), path)
    io.write_partition(series(spark, [7.0]), path)
    assert sorted(r["close"] for r in io.scan_dated(spark, path).collect()) == [2.0, 7.0]


def test_levels_have_one_row_for_each_bar(spark):
    n = 40
    price = [10 + (k % 9) * 0.5 for k in range(n)]
    df = series(spark, price, open=price, high=[p + 0.2 for p in price], low=[p - 0.2 for p in price], volume=[100.0] * n, amount=[1000.0] * n)
    out = levels.panel_levels(df)
    assert out.count() == n and out.orderBy(F.desc("trade_date")).first()["resistance_short"] is None


def test_dates(spark):
    one = spark.createDataFrame([("20240131",)], "t string").select(scalar.parse_date("t").alias("d"))
    r = one.select(F.add_months("d", 1).alias("m"), scalar.date_path("d").alias("p"), scalar.month_key("d").alias("k")).first()
    assert (r["m"], r["p"], r["k"]) == (date(2024, 2, 29), "2024_01_31.parquet", "202401")
    assert dataset.add_months(date(2024, 1, 31), 1) == date(2024, 2, 29)
