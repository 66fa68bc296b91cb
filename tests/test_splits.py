"""Splits, exact class sizes, fitted scales, peak statistics and boosting that stops early, against plain Python."""

import math
import random
import statistics
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelkit.operators import dataset, metrics, ml, sequences

FIRST = date(2020, 1, 1)


@pytest.mark.parametrize("days,n", [(25, 5), (6, 5), (17, 3)])
def test_time_splits(spark, days, n):
    rows = [(e, FIRST + timedelta(days=d)) for e in range(2) for d in range(days)]
    got = dataset.time_splits(spark.createDataFrame(rows, "entity int, trade_date date"), n).collect()
    each, want = days // (n + 1), set()
    for k in range(n):
        start = days - (n - k) * each
        want |= {(k, "train" if d < start else "test", e, FIRST + timedelta(days=d)) for e in range(2) for d in range(start + each)}
    assert {(r["split"], r["side"], r["entity"], r["trade_date"]) for r in got} == want and len(got) == len(want)


def test_downsample_majority_is_exact_and_steady(spark):
    rng = random.Random(1)
    rows = [(e, FIRST + timedelta(days=d), rng.choice([0] * 8 + [1, 1, 2, None])) for e in range(20) for d in range(40)]
    df = spark.createDataFrame(rows, "entity int, trade_date date, c int")
    least = min(Counter(c for *_, c in rows if c is not None).values())
    runs = [sorted(map(tuple, dataset.downsample_majority(df.repartition(p), "c", 1.0).collect())) for p in (2, 9)]
    assert runs[0] == runs[1] and Counter(c for *_, c in runs[0]) == {0: least, 1: least, 2: least}
    assert set(runs[0]) <= set(rows)
    assert dataset.downsample_majority(df.limit(0), "c").count() == 0


def test_fitted_volume(spark):
    volumes = [1.0, 10.0, 200.0, None, 0.0]
    mean, std = sequences.fit_volume(spark.createDataFrame([(v,) for v in volumes], "volume double"))
    logs = [math.log1p(v) for v in volumes if v is not None]
    assert (mean, std) == (pytest.approx(statistics.fmean(logs)), pytest.approx(statistics.pstdev(logs) + 1e-8))
    assert sequences.fit_volume(spark.createDataFrame([], "volume double")) == (0.0, 1e-8)


def test_peak_hits(spark):
    rows = [([0.5, 0.3, 0.15, 0.05], 0), ([0.1, 0.2, 0.3, 0.4], 3), ([0.1, 0.2, 0.3, 0.4], 0), ([0.4, 0.3, 0.2, 0.1], 3)]
    got = metrics.peak_hits(spark.createDataFrame(rows, "p array<double>, t int").withColumn("last", F.lit(3)), "p", "t", "last").first()
    assert (got["n"], got["peaks"], got["hit"], got["peak_found"], got["hit_given_peak"]) == (4, 2, 0.5, 0.5, 0.5)


def test_boosting_stops_early(spark):
    rng = random.Random(2)
    rows = [(e, FIRST + timedelta(days=d), float(x), (2.0 if x > 0.5 else -2.0), rng.random()) for e in range(30) for d in range(20) for x in [rng.random()]]
    df = spark.createDataFrame(rows, "entity int, trade_date date, x double, y double, noise double")
    model, used = ml.fit_early_stop(df, ["x", "noise"], "y", depth=1, rounds=30)
    assert 1 <= used < 30
    # a step is learnt by one split, but for rows between its borders of bins
    scored = ml.score_panel(df, ["x", "noise"], [model])
    assert scored.agg(F.avg((F.abs(F.col("y") - F.col("pred_y")) < 1).cast("double"))).first()[0] > 0.95
    assert ml.importance(model, ["x", "noise"])[0][0] == "x"
