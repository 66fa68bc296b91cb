"""Rank sequences: arrays against plain Python, their digest, and how often the lines are read."""

import math
import random
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelkit.operators import sequences
from panelkit.plans import registry

FIRST = date(2020, 1, 1)


def panel(spark):
    rng = random.Random(4)
    names = [*sequences.RAW, "pe_ttm", "pb"]
    rows = [(e, FIRST + timedelta(days=d), "ab"[e % 2], *[None if rng.random() < 0.01 else rng.uniform(-1 if n == "close" else 0, 9) for n in names]) for e in range(5) for d in range(rng.choice([3, 25, 40]))]
    df = spark.createDataFrame(rows, "entity long, trade_date date, industry string, " + ", ".join(f"{n} double" for n in names))
    return df.orderBy(F.rand(1)).repartition(3), [dict(zip(["entity", "trade_date", "industry", *names], r)) for r in rows]


def wanted(rows, length, ahead):
    found = {}
    for r in rows:
        own = [x for x in rows if x["entity"] == r["entity"]]
        at = own.index(r)
        before = own[at - length : at] if at >= length else []
        peers = [x for x in rows if (x["trade_date"], x["industry"]) == (r["trade_date"], r["industry"])]
        if not before or at + ahead >= len(own) or own[at + ahead]["close"] is None or any(x[n] is None for x in before for n in sequences.RAW) or any(r[c] is None for c in ("pe_ttm", "pb", "ret_5d")):
            continue
        last = before[-1]["close"] if before[-1]["close"] > 0 else 1.0
        seq = {n: [x[n] / last - 1 if n in sequences.PRICES else x[n] for x in before] for n in sequences.RAW}
        volumes = seq["volume"]
        seq["volume"] = [math.log1p(max(v, 0)) for v in volumes]
        ends = {"vol_spike_3d": statistics.fmean(volumes[-3:]) / max(statistics.fmean(volumes), 1e-8)}
        for n, c in (("pe_rel", "pe_ttm"), ("pb_rel", "pb"), ("ind_momentum", "ret_5d")):
            ends[n] = r[c] - statistics.median([x[c] for x in peers if x[c] is not None])
        seq |= {n: [0.0] * (length - 1) + [v] for n, v in ends.items()}
        seq["year_sin"] = [math.sin(x["trade_date"].timetuple().tm_yday * 2 * math.pi / 365.0) for x in before]
        seq["fwd_2"] = own[at + 2]["close"] / r["close"] - 1 if r["close"] and own[at + 2]["close"] is not None else 0.0
        found[r["entity"], r["trade_date"]] = seq
    return found


@pytest.mark.parametrize("chunk", [1024, 2])
def test_rank_sequences(spark, chunk, monkeypatch):
    monkeypatch.setattr(sequences, "CHUNK", chunk)
    df, rows = panel(spark)
    want = wanted(rows, 4, 6)
    got = {(r["entity"], r["trade_date"]): r for r in sequences.rank_cache(df, 4, (2, 6)).collect()}
    assert len(want) > 20 and set(got) == set(want)
    for k, seq in want.items():
        for n, v in seq.items():
            assert got[k][n] == pytest.approx(v, abs=1e-9), n
    names = sequences.RANK_FEATURES
    sums = sequences.rank_cache(df, 4, (2, 6), digest=sequences.sums_by_place, into=(*names, *[f"{n}_placed" for n in names])).collect()
    assert len(sums) == len(got)
    for r in sums:
        whole = got[r["entity"], r["trade_date"]]
        assert r["fwd_6"] == whole["fwd_6"]
        for n in names:
            assert (r[n], r[f"{n}_placed"]) == (pytest.approx(sum(whole[n])), pytest.approx(sum(v * (k + 1) for k, v in enumerate(whole[n]))))


def test_lines_are_read_for_medians_and_for_rows_alone(spark, small):
    plan = registry.queries()["seq_rank_cache"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_") == 2
