"""Windows over arrays against the same windows as Columns, and what factors shuffle."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest

from panelkit.functions import arrays
from panelkit.functions.rolling import select_rolling
from panelkit.operators import catalog
from panelkit.plans import registry
from test_shuffles import exchanges

NAN = math.nan


def made(seed):
    """Entities of 1 to 150 rows, with nulls, NaN and values that stay the same for a while."""
    rng, rows = random.Random(seed), []
    for entity, size in enumerate((1, 2, 150, 7, 150, 3)):
        level = 10.0 ** rng.randint(-3, 6)
        for day in range(size):
            x = level * (1 if 40 < day < 80 else rng.uniform(0.9, 1.1))
            y = rng.choice([rng.gauss(0, 3), rng.gauss(0, 3), None if entity != 4 else 5.0])
            rows.append((entity, day, None if entity in (2, 3) and rng.random() < 0.05 else x, NAN if entity == 4 and day % 9 == 0 else y))
    return rows


WINDOWS = {f"{kind}_{n}": make for n in (2, 5, 20, 60) for kind, make in {
    "total": lambda r, n=n: r.total("x", n), "ordered": lambda r, n=n: r.total_ordered("x", n), "mean": lambda r, n=n: r.mean("y", n), "std": lambda r, n=n: r.std("x", n),
    "sdy": lambda r, n=n: r.std("y", n), "corr": lambda r, n=n: r.corr("x", "y", n), "slope": lambda r, n=n: r.slope("x", n), "high": lambda r, n=n: r.high("x", n),
    "low": lambda r, n=n: r.low("x", n), "minmax": lambda r, n=n: r.minmax("x", n), "ref": lambda r, n=n: r.div(r.ref("x", n), "x"), "gain": lambda r, n=n: r.mean(r.define(f"g{n}", r.gain(r.delta("x", 1))), n)}.items()}


@pytest.mark.parametrize("cells", [1, 320, arrays.CELLS])
def test_arrays_equal_columns(spark, monkeypatch, cells):
    monkeypatch.setattr(arrays, "CELLS", cells)
    rows = made(cells)
    want = select_rolling(spark.createDataFrame(rows, "entity int, trade_date int, x double, y double"), ["entity", "trade_date"], WINDOWS)
    want = {(r["entity"], r["trade_date"]): r for r in want.collect()}
    columns = {n: arrays.series(pa.array([r[k] for r in rows], pa.float64())) for n, k in (("x", 2), ("y", 3))}
    seen = 0
    for cells_of, taken, places in arrays.blocks(np.array([r[1] + 1 for r in rows])):
        block = arrays.block_of(columns, cells_of)
        for name, make in WINDOWS.items():
            values, valid = catalog._picked(make(block), cells_of.shape, places)
            for k, row in enumerate(taken):
                expected = want[rows[row][:2]][name]
                if valid is not None and not valid[k]:
                    assert expected is None, (name, rows[row])
                else:
                    assert expected is not None and values[k] == pytest.approx(expected, rel=1e-9, abs=1e-12, nan_ok=True), (name, rows[row])
        seen += len(taken)
    assert seen == len(rows)


@pytest.mark.parametrize("sizes,most", [([3, 1, 4, 1, 5], 4), ([10], 3), ([2, 2, 2], 100), ([1] * 7, 1)])
def test_chunks_are_whole_entities(sizes, most):
    number = np.concatenate([np.arange(1, n + 1) for n in sizes])
    table = pa.table({"n": number, "e": np.repeat(np.arange(len(sizes)), sizes)})
    for width in (1, 2, 100):
        got = list(arrays.chunks(iter(table.to_batches(max_chunksize=width)), "n", most))
        assert pa.concat_tables(got).equals(table)
        assert all(t.column("n")[0].as_py() == 1 for t in got) and len(got) >= sum(sizes) // (most + max(sizes))


def test_messages_come_back():
    rng = np.random.default_rng(1)
    columns = [rng.normal(size=9), rng.integers(0, 9, 9).astype(np.int32), rng.integers(0, 9, 9).astype(np.int8)]
    got, more = arrays.unpack(arrays.pack(columns, b"more"), [np.float64, np.int32, np.int8])
    assert more == b"more" and all((a == b).all() for a, b in zip(columns, got))
    flags = [rng.random(9) < 0.5 for _ in range(70)]
    words = arrays.bits_of(flags, 9)
    assert all((arrays.bit(words, k) == f).all() for k, f in enumerate(flags))


def test_factors_take_few_windows_of_spark(spark, small):
    """hundreds of windows as generated code took most of the time."""
    plan = registry.queries()["feat_combined"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 6


@pytest.mark.parametrize("name", ["feat_price_volume", "feat_combined"])
def test_ranks_go_as_messages(spark, small, name):
    """rows with all raw columns and what is ranked were shuffled twice."""
    assert max(exchanges(registry.queries()[name](spark, small))) <= 11


def test_entities_and_dates_may_be_missing(spark):
    days = [date(2020, 1, 6) + timedelta(days=k) for k in range(3)]
    rows = [(e, d, float(k + (e or 0))) for e in (None, 1, 2) for k, d in enumerate([None, *days])]
    some = catalog.FactorCatalog([catalog.Factor("M", 1, 2, lambda r: r.mean("x", 2)), catalog.Factor("RANK_M", 3, 2, lambda r: r.mean("x", 2), "M", 6), catalog.Factor("TILE_M", 3, 2, lambda r: r.mean("x", 2), "M", 6)])
    got = {(r["entity"], r["trade_date"]): (r["M"], r["RANK_M"], r["TILE_M"]) for r in some.compute(spark.createDataFrame(rows, "entity long, trade_date date, x double")).collect()}
    assert len(got) == 12
    for (e, d), found in got.items():
        k = [None, *days].index(d)
        assert found == ((e or 0) + k - (0.5 if k else 0), 1 + (e or 0), 1 + (e or 0))


def test_rows_left_out_still_count(spark):
    rows = [(e, date(2020, 1, d), float(10 * e + d), e == 1 and d > 2) for e in (1, 2) for d in range(1, 6)]
    some = catalog.FactorCatalog([catalog.Factor("M", 1, 3, lambda r: r.mean("x", 3)), catalog.Factor("RANK_M", 3, 3, lambda r: r.mean("x", 3), "M", 6)])
    got = some.compute(spark.createDataFrame(rows, "entity long, trade_date date, x double, inside boolean"), where="inside", keep=("x",), digits={"M": 1, "RANK_M": 1}).collect()
    assert sorted((r["trade_date"].day, r["x"], r["M"], r["RANK_M"]) for r in got) == [(d, 10.0 + d, 9.0 + d, 1.0) for d in (3, 4, 5)]


def test_ranked_vectors_equal_ranks_of_rows(spark, small):
    """F3, F4, F5, F8, F9: rows of factors were put together before they went to their dates."""
    from pyspark.sql import functions as F

    from panelkit.functions import xs
    from panelkit.operators import dataset
    from panelkit.sources import bars as source

    panel = source.with_fundamentals(source.bars(spark, small)).where("trade_date < '1997-01-01'").withColumn("y", F.col("close") * 2)
    some = catalog.FactorCatalog([catalog.combined().factors[n] for n in ("REF_close_2", "STD_close_20", "RANK_STD_close_20", "QUANTILE_STD_close_20", "MACD", "EMA12C", "EMA26C", "ROE", *(f"MEAN_volume_{k}" for k in catalog.WINDOWS), *(f"MAX_high_{k}" for k in catalog.WINDOWS))])
    got = dataset.ranked_vectors(some, panel, ("y",), "v")
    want = xs.pct_rank_long(some.compute(panel, keep=("y",)), some.names, ("y",), into="v")
    rows = lambda df: sorted((r["entity"], r["trade_date"], r["y"], r["v"]) for r in df.collect())
    assert rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "v#" in plan and max(exchanges(got)) <= 11


def test_rows_without_a_factor_stay_behind(spark):
    rows = [(e, date(2020, 1, d), float(10 * e + d)) for e in (1, 2) for d in range(1, 6)]
    some = catalog.FactorCatalog([catalog.Factor("R", 1, 3, lambda r: r.ref("x", 2)), catalog.Factor("M", 1, 2, lambda r: r.mean("x", 2))])
    df = spark.createDataFrame(rows, "entity long, trade_date date, x double")
    schema = some.compute(df).schema

    def finish(day):
        return pa.table([*day.rows.columns, *[pa.array(v, mask=m) for _, v, m in day.factors()]], names=["entity", "trade_date", "R", "M"])

    got = some.by_date(df, finish, schema, complete=True, digits={"R": 0, "M": 1}).collect()
    assert sorted((r["entity"], r["trade_date"].day, r["R"], r["M"]) for r in got) == [(e, d, 10.0 * e + d - 2, 10 * e + d - 0.5) for e in (1, 2) for d in (3, 4, 5)]
    assert some.by_date(df, finish, schema).count() == 10


def test_training_rows_go_as_messages(spark, small):
    """rows of all factors were shuffled to their dates, stored and read twice."""
    df = registry.queries()["ds_tabular"](spark, small)
    assert max(exchanges(df)) <= 24
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "STD_close_5" not in plan[: plan.rindex("FlatMapGroupsInArrow")].split("FlatMapGroupsInArrow")[-1] and "training-" not in plan


def test_median_of_an_industry():
    import statistics

    from panelkit.operators import dataset

    rng = np.random.default_rng(2)
    value, null, industry = rng.normal(size=60), rng.random(60) < 0.2, rng.integers(0, 8, 60)
    null |= industry == 3
    middle, none = dataset._industry_median(value, null, industry)
    for k in range(60):
        of = [v for v, m, i in zip(value, null, industry) if i == industry[k] and not m]
        assert none[k] == (not of) and (none[k] or middle[k] == pytest.approx(statistics.median(of), rel=1e-15))
    assert all(len(x) == 0 for x in dataset._industry_median(*(np.zeros(0, t) for t in (float, bool, np.int64))))


def test_factors_by_date(spark, small, tmp_path):
    """rows of factors were shuffled to the date they are written by."""
    import glob

    from pyspark.sql import functions as F

    from panelkit.sources import bars as source
    from panelkit.sources.atomic import Change

    panel = source.bars(spark, small).withColumn("inside", F.col("trade_date").between("1996-01-01", "1996-06-30"))
    some = catalog.FactorCatalog([catalog.combined().factors[n] for n in ("REF_close_2", "STD_close_20", "RANK_STD_close_20", "MAX_high_10")])
    digits = {n: 6 for n in some.names}
    got = some.compute_by_date(panel, where="inside", digits=digits)
    assert max(exchanges(got)) <= 11
    rows = lambda df: sorted(tuple("" if v is None else str(v) for v in r) for r in df.select("entity", "trade_date", *some.names).collect())
    want = rows(some.compute(panel, where="inside", digits=digits))
    assert rows(got) == want and want
    change = Change(spark, str(tmp_path))
    change.replace(got, "f", dealt=True)
    change.commit()
    assert rows(spark.read.parquet(f"{tmp_path}/f")) == want
    assert all(len(glob.glob(f"{d}/*.parquet")) == 1 for d in glob.glob(f"{tmp_path}/f/trade_date=*"))


def test_flat_panel_makes_its_factors_once_rows_are_chosen(spark, small):
    """factors of rows that the joins drop were made and joined with the levels."""
    df = registry.queries()["panel_rank_flat"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    factors = plan.index("FlatMapGroupsInArrow")
    assert "Join" in plan[factors:] and "Join" not in plan[plan.index("\n") : factors]
    assert df.count() < registry.queries()["scan_bars"](spark, small).count()
