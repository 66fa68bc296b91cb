"""Changes of stored tables, scans by file name, increments, total orders and the average-cost ledger."""

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelkit.operators import catalog, increments, order_stats, portfolio, universe
from panelkit.sources import atomic, io
from panelkit.sources import bars as source

DAYS = [date(2024, 1, k) for k in range(1, 11)]


def panel(spark, days, **columns):
    rows = [(e, d, *[float(f(e, d)) for f in columns.values()]) for e in range(3) for d in days]
    return spark.createDataFrame(rows, "entity int, trade_date date" + "".join(f", {c} double" for c in columns))


def times(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def table(df):
    return sorted(map(tuple, df.select("entity", "trade_date", *sorted(set(df.columns) - {"entity", "trade_date"})).collect()), key=repr)


def test_merge_touches_its_dates_only(spark, tmp_path):
    root = str(tmp_path)
    io.merge_into(panel(spark, DAYS, x=lambda e, d: e + d.day), root, "t", ["entity", "trade_date"])
    before = times(f"{root}/t")
    new = panel(spark, DAYS[:3], y=lambda e, d: e * 1.0)
    for _ in range(2):  # a second run gives the same table
        io.merge_into(new, root, "t", ["entity", "trade_date"])
        got = {(r["entity"], r["trade_date"]): (r["x"], r["y"]) for r in io.scan_stored(spark, root, "t").collect()}
        assert got == {(e, d): (float(e + d.day), float(e) if d in DAYS[:3] else None) for e in range(3) for d in DAYS}
    after = times(f"{root}/t")
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("trade_date=")[1][:10] for f in same} == {str(d) for d in DAYS[3:]}
    # the source may be the table itself
    io.merge_into(io.scan_stored(spark, root, "t").withColumn("x", F.col("x") + 1), root, "t", ["entity", "trade_date"])
    assert {r["x"] - r["entity"] - r["trade_date"].day for r in io.scan_stored(spark, root, "t").collect()} == {1.0}


def test_killed_changes(spark, tmp_path):
    root, keys = str(tmp_path), ["entity", "trade_date"]
    io.merge_into(panel(spark, DAYS, x=lambda e, d: 1.0), root, "t", keys)
    old = table(io.scan_stored(spark, root, "t"))
    # before its note a change has done nothing
    change = atomic.Change(spark, root)
    change.replace(panel(spark, DAYS[:4], x=lambda e, d: 2.0), "t")
    assert table(io.scan_dated(spark, f"{root}/t")) == old
    assert atomic.recover(spark, root) == 0 and table(io.scan_stored(spark, root, "t")) == old
    # with its note, and some folders moved, it is finished
    change = atomic.Change(spark, root)
    change.replace(panel(spark, DAYS[:4], x=lambda e, d: 2.0), "t")
    moved = []

    class Dies(atomic.Files):
        def move(self, source, target):
            if "trade_date" in str(target):
                if len(moved) == 2:
                    raise KeyboardInterrupt
                moved.append(target)
            super().move(source, target)

    whole, atomic.Files = atomic.Files, Dies
    try:
        with pytest.raises(KeyboardInterrupt):
            change.commit()
    finally:
        atomic.Files = whole
    got = {r["trade_date"]: r["x"] for r in io.scan_stored(spark, root, "t").collect()}
    assert got == {d: 2.0 if d in DAYS[:4] else 1.0 for d in DAYS}
    assert not whole(spark, root).names(root, atomic.CHANGES)


def test_named_files_outside_the_range_are_not_opened(spark, tmp_path):
    path = str(tmp_path)
    io.write_named_files(panel(spark, DAYS[:5], x=lambda e, d: 1.0), path)
    io.write_named_files(panel(spark, DAYS[4:8], x=lambda e, d: 2.0, y=lambda e, d: 3.0), path)
    (tmp_path / "1990_01_01.parquet").write_bytes(b"not a table")
    (tmp_path / "notes.txt").write_text("not a table either")
    got = io.scan_named_files(spark, path, DAYS[1], DAYS[6])
    assert {(r["trade_date"], r["x"], r["y"]) for r in got.collect()} == {(d, 1.0, None) if d < DAYS[4] else (d, 2.0, 3.0) for d in DAYS[1:7]}
    assert io.scan_named_files(spark, path, date(1980, 1, 1), date(1980, 2, 1), "x double").count() == 0
    assert sorted(io.named_files(spark, path)) == [date(1990, 1, 1), *DAYS[:8]]


def test_bars_of_other_dates_are_not_read(spark, tmp_path):
    raw = panel(spark, DAYS, open=lambda e, d: 1.0, high=lambda e, d: 2.0, low=lambda e, d: 1.0, close=lambda e, d: 1.5, vol=lambda e, d: 0.0 if e else 4.0, amount=lambda e, d: 6.0)
    io.write_partition(raw.select(F.col("entity").cast("string").alias("ts_code"), F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), "open", "high", "low", "close", "vol", "amount"), f"{tmp_path}/bars")
    got = io.scan_bars(spark, f"{tmp_path}/bars", DAYS[2], DAYS[3])
    assert "PartitionFilters: [isnotnull(trade_date" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["entity"], r["trade_date"], r["volume"], r["vwap"]) for r in got.collect()} == {(str(e), d, 0.0 if e else 4.0, None if e else 1.5) for e in range(3) for d in DAYS[2:4]}


def test_increments_write_pending_dates_once(spark, small, tmp_path):
    b, root = source.bars(spark, small), str(tmp_path)
    some = catalog.FactorCatalog([catalog.combined().factors[n] for n in ("MEAN_close_5", "STD_close_20", "RANK_MEAN_close_5", "MAX_high_10")])
    calendar, start = source.calendar(b), date(1998, 1, 1)
    run = lambda today: increments.update(b, calendar, some, root, start, today)
    assert run(date(1998, 6, 30)) == 26 and run(date(1998, 6, 30)) == 0
    before = times(f"{root}/features")
    assert run(date(1998, 12, 31)) == 26
    assert before.items() <= times(f"{root}/features").items()
    whole = some.compute(b).where(F.col("trade_date").between(start, date(1998, 12, 31)))
    rounded = lambda df: sorted((r["entity"], r["trade_date"], *[None if r[n] is None else round(r[n], 6) for n in some.names]) for r in df.collect())
    assert rounded(io.scan_stored(spark, root, "features")) == rounded(whole)
    log = increments.registry(spark, root)
    assert log.count() == 52 and log.agg(F.sum("row_count")).first()[0] == whole.count()


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_numbered_and_ranked(spark, groups):
    rng = random.Random(4)
    # a hot group, a hot value, and missing values
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([5.0, 5.0, rng.random(), None]), k) for k in range(600)]
    df = spark.createDataFrame(rows, "g int, v double, entity int")
    got = order_stats.ranked(df, "v", "entity", groups).withColumn("tile", order_stats.tile("position", "size", 7)).collect()
    by = {}
    for g, v, e in rows:
        by.setdefault(g if groups else 0, []).append((v is None, v or 0.0, e))
    want = {}
    for part in by.values():
        part.sort()
        n, k = len(part), 7
        for at, (none, v, e) in enumerate(part):
            tiles = [t for t in range(k) for _ in range(n // k + (t < n % k))]
            want[e] = (at + 1, 1 + sum(x[:2] < (none, v) for x in part), n, tiles[at] + 1)
    assert {r["entity"]: (r["position"], r["rank"], r["size"], r["tile"]) for r in got} == want


def test_no_single_partition_over_entities(spark, small):
    b = source.bars(spark, small)
    plan = universe.cap_percentile(b, 0.7)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("Scan parquet")[0] or "row_number() windowspecdefinition(cap" not in plan
    placed = order_stats.numbered(b.groupBy("entity").agg(F.max("circ_mv").alias("cap")), [F.col("cap").asc(), F.col("entity").asc()])
    assert "row_number() windowspecdefinition(__range" in placed._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_average_cost_against_a_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(e, date(2020, 1, 1) + timedelta(days=k // 2), k, rng.choice(["buy", "buy", "sell", "sell"]), rng.choice([1, 10, 100, 10**6]), rng.uniform(1, 50), 5.0) for e in range(4) for k in range(400)]
    got = {(r["entity"], r["seq"]): r for r in portfolio.average_cost(spark.createDataFrame(rows, "entity int, trade_date date, seq int, action string, shares long, price double, cost double")).collect()}
    assert len(got) == len(rows)
    for e in range(4):
        held, average, episode = 0, None, 0
        for _, _, k, action, shares, price, cost in rows[e * 400 : e * 400 + 400]:
            row = got[e, k]
            if action == "buy":
                episode += held == 0
                average = ((average or 0.0) * held + price * shares) / (held + shares) if held else price
                held, filled, pnl = held + shares, shares, 0.0
            else:
                filled = -min(shares, held)
                pnl = (price - average) * -filled - cost if filled else 0.0
                held += filled
            assert (row["held"], row["filled"], row["episode"]) == (held, filled, episode)
            assert row["pnl"] == pytest.approx(pnl, rel=1e-9, abs=1e-6)
            assert row["avg_cost"] == (pytest.approx(average, rel=1e-9) if held or filled else None)
            if not held:
                average = None


def test_average_cost_of_empty_trades(spark):
    none = spark.createDataFrame([], "entity int, trade_date date, seq int, action string, shares long, price double, cost double")
    assert portfolio.average_cost(none).count() == 0
