"""Windows by running sums, block extremes and affine scans against plain Python."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelkit.functions import ts
from panelkit.functions.rolling import Rolling, select_rolling

NAN = float("nan")


def panel(spark, rows):
    return spark.createDataFrame(rows, "entity int, trade_date int, x double, y double")


def made(seed):
    rng = random.Random(seed)
    rows = []
    for entity, size in enumerate((1, 2, 7, 150)):
        level = 10.0 ** rng.randint(-3, 6)
        for day in range(size):
            x = level * (1 if 40 < day < 80 else rng.uniform(0.9, 1.1))  # constant for a while
            y = rng.choice([rng.gauss(0, 3), None]) if entity != 3 or day % 9 else NAN
            rows.append((entity, day, None if rng.random() < 0.05 else x, y))
    return rows


def by_entity(rows):
    out = {}
    for entity, day, x, y in rows:
        out.setdefault(entity, []).append((day, x, y))
    return out


def plain(values):
    return [v for v in values if v is not None and not math.isnan(v)]


@pytest.mark.parametrize("n", [2, 5, 20, 60])
def test_sums_against_frames_in_python(spark, n):
    rows = made(n)
    got = select_rolling(panel(spark, rows), ["entity", "trade_date"], {
        "total": lambda r: r.total("x", n), "mean": lambda r: r.mean("y", n), "std": lambda r: r.std("x", n), "sdy": lambda r: r.std("y", n),
        "corr": lambda r: r.corr("x", "y", n), "slope": lambda r: r.slope("x", n)})
    got = {(r["entity"], r["trade_date"]): r for r in got.collect()}
    for entity, series in by_entity(rows).items():
        for k in range(len(series)):
            row, frame = got[entity, k], series[max(0, k - n + 1) : k + 1]
            xs, ys = plain([x for _, x, _ in frame]), plain([y for _, _, y in frame])
            assert row["total"] == (pytest.approx(math.fsum(xs), rel=1e-14) if xs else None)
            assert row["mean"] == (pytest.approx(math.fsum(ys) / len(ys), rel=1e-12, abs=1e-13) if ys else None)
            for name, values in (("std", xs), ("sdy", ys)):
                want = statistics.stdev(values) if len(values) > 1 else None
                assert row[name] == (pytest.approx(want, rel=1e-9, abs=1e-12 * max(map(abs, values))) if want is not None else None)
                if want == 0:
                    assert row[name] == 0
            both = [(x, y) for _, x, y in frame if x is not None and y is not None and not math.isnan(y)]
            if len(both) > 1 and statistics.stdev(xs) > 0 and statistics.stdev(ys) > 0:
                mx, my = (math.fsum(v) / len(both) for v in zip(*both))
                want = math.fsum((x - mx) * (y - my) for x, y in both) / (len(both) - 1) / statistics.stdev(xs) / statistics.stdev(ys)
                assert row["corr"] == pytest.approx(want, rel=1e-8, abs=1e-9)
            else:
                assert row["corr"] is None
            numbered = [(d, x) for d, x, _ in frame if x is not None]
            if len(numbered) > 1:
                md, mx = (math.fsum(v) / len(numbered) for v in zip(*numbered))
                want = math.fsum((d - md) * (x - mx) for d, x in numbered) / math.fsum((d - md) ** 2 for d, _ in numbered)
                assert row["slope"] == pytest.approx(want, rel=1e-8, abs=1e-12 * max(map(abs, xs)))
            else:
                assert row["slope"] is None


def test_long_history_loses_nothing(spark):
    # running sums of squares are far larger than a window's spread
    rows = [(1, d, 1e6 + (d % 7) * 1e-3, None) for d in range(20_000)]
    row = select_rolling(panel(spark, rows), ["trade_date"], {"std": lambda r: r.std("x", 7)}).where("trade_date = 19999").first()
    assert row["std"] == pytest.approx(statistics.stdev([k * 1e-3 for k in range(7)]), rel=1e-6)


@pytest.mark.parametrize("first,last", [(-4, 0), (-29, 0), (0, 5), (-3, 3), (1, 3), (-10, -2), (-749, 0)])
def test_extremes_against_frames_in_python(spark, first, last):
    rows = made(first * 31 + last)
    got = select_rolling(panel(spark, rows), ["entity", "trade_date"], {"most": lambda r: r.extreme("x", first, last, 1), "least": lambda r: r.extreme("x", first, last, -1)})
    got = {(r["entity"], r["trade_date"]): r for r in got.collect()}
    for entity, series in by_entity(rows).items():
        for k in range(len(series)):
            frame = [x for _, x, _ in series[max(0, k + first) : max(0, k + last + 1)] if x is not None]
            row = got[entity, k]
            if k + first < len(series) and k + last >= 0:
                assert (row["most"], row["least"]) == ((max(frame), min(frame)) if frame else (None, None))


def test_two_sorts_and_one_shuffle(spark):
    rolling = Rolling()
    columns = [c for n in (5, 20, 60) for c in (rolling.mean("x", n), rolling.std("x", n), rolling.corr("x", "y", n), rolling.high("x", n), rolling.low("y", n))]
    plan = rolling.prepare(panel(spark, made(1))).select(*columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2


@pytest.mark.parametrize("span", [1, 2, 20, 200, 5000])
def test_ewm_of_any_span(spark, span):
    rng = random.Random(span)
    rows = [(e, d, None if d < 3 or rng.random() < 0.1 else rng.gauss(100, 50), None) for e in range(2) for d in range(1500)]
    got = {(r["entity"], r["trade_date"]): r["ema"] for r in ts.with_ewm(panel(spark, rows), "x", span, "ema").collect()}
    a = 2 / (span + 1)
    for entity, series in by_entity(rows).items():
        y = None
        for day, x, _ in series:
            if x is not None:
                y = x if y is None else y * (1 - a) + x * a
            assert got[entity, day] == (pytest.approx(y, rel=1e-11) if y is not None else None)


def test_empty_panel(spark):
    none = panel(spark, [])
    assert select_rolling(none, ["entity"], {"m": lambda r: r.mean("x", 5), "h": lambda r: r.high("x", 5)}).count() == 0
    assert ts.with_ewm(none, "x", 20, "ema").where(F.col("ema").isNull()).count() == 0
