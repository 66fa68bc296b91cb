"""That queries do the whole job: every factor, fold and row."""

from datetime import date

from panelkit.operators import catalog
from panelkit.plans import registry


def test_feature_rows_have_every_factor_and_bar(spark, small):
    bars = registry.queries()["scan_bars"](spark, small).count()
    for name, names in (("feat_price_volume", catalog.price_volume().names), ("feat_combined", catalog.combined().names)):
        df = registry.queries()[name](spark, small)
        assert df.columns == ["entity", "trade_date", *names]
        assert df.count() == bars
    assert (len(catalog.price_volume().names), len(catalog.combined().names)) == (191, 212)


def test_ranks_of_means_tie_in_spite_of_the_last_bit(spark):
    """0.1 + 0.2 and 0.3 are a tie once summed in another order."""
    days = [date(2020, 1, k) for k in range(1, 7)]
    rows = [(e, d, c, c, c, c, 1.0, c, c) for e, closes in ((1, [0.1, 0.2, 0.3] * 2), (2, [0.3, 0.2, 0.1] * 2), (3, [0.1, 0.1, 0.7] * 2)) for d, c in zip(days, closes)]
    panel = spark.createDataFrame(rows, "entity long, trade_date date, open double, high double, low double, close double, volume double, amount double, vwap double")
    from pyspark.sql import functions as F

    panel = panel.withColumn("pb", F.lit(1.0)).withColumn("pe_ttm", F.lit(1.0))
    pv = catalog.price_volume()
    out = {(r["entity"], r["trade_date"]): r for r in pv.compute(panel).collect()}
    for day in days:
        for n in pv.names:
            if n.startswith("RANK_") and n != "RANK_REF_close_1":
                base = {e: out[e, day][n[5:]] for e in (1, 2, 3)}
                for e in base:
                    less = [x for k, x in base.items() if base[e] is None and x is not None or None not in (x, base[e]) and x < base[e] - 1e-9]
                    assert out[e, day][n] == 1 + len(less), (n, day, base)


def narrow(b):
    """Two features and the labels, in place of all features."""
    from panelkit.functions import ts

    return b.select("entity", "trade_date", ts.ref("close", 1).alias("x"), ts.ref("volume", 1).alias("z"), *[ts.forward_return("close", h).alias(f"y{h}") for h in (5, 20, 60)])


def labelled_dates(rows):
    """Rows with a label by date."""
    n = {}
    for r in rows.where("y5 is not null").select("trade_date").collect():
        n[r[0]] = n.get(r[0], 0) + 1
    return n


def test_walkforward_runs_every_window(spark, small, monkeypatch):
    from panelkit.plans import composite_queries
    from panelkit.sources import bars as source

    monkeypatch.setattr(composite_queries, "_ranked", narrow)
    monkeypatch.setattr(composite_queries, "FEATURES", ["x", "z"])
    n = labelled_dates(narrow(source.bars(spark, small)))
    want = {r["fold"]: sum(n.get(d, 0) >= 3 for d in n if r["test_start"] <= d <= r["test_end"]) for r in registry.queries()["ds_walkforward_windows"](spark, small).collect()}
    got = {r["fold"]: r["n_dates"] for r in registry.queries()["ml_walkforward"](spark, small).collect()}
    assert len(want) > 2 and set(got) == set(want)
    assert all(0 < got[k] <= want[k] and got[k] >= 0.9 * want[k] for k in want)


def test_tuning_scores_every_year_after_the_first(spark, small, monkeypatch):
    from panelkit.plans import composite_queries
    from panelkit.sources import bars as source

    monkeypatch.setattr(composite_queries, "_ranked", narrow)
    monkeypatch.setattr(composite_queries, "FEATURES", ["x", "z"])
    years = {d.year for d in labelled_dates(narrow(source.bars(spark, small)))}
    got = registry.queries()["ml_tune_timesplit"](spark, small).collect()
    assert len(years) > 3
    assert sorted((r["depth"], r["fold"]) for r in got) == [(d, k) for d in (2, 3) for k in range(1, len(years))]
    assert all(r["mse"] > 0 for r in got)


def test_models_read_all_ranked_features(spark, small):
    rows = registry.queries()["ml_importance"](spark, small).collect()
    assert sorted(r["feature"] for r in rows) == sorted(catalog.combined().names)


def test_no_entity_or_session_is_left_out(spark, small):
    from pyspark.sql import functions as F

    run = lambda name: registry.queries()[name](spark, small)
    bars = run("scan_bars")
    rows, entities = bars.count(), bars.select("entity").distinct().count()
    assert run("write_partition").count() == run("export_dataset").count() == run("fill_price_triggered").count() == rows
    assert run("join_holdings_rank").count() == entities
    assert run("agg_rank_corr_argsort").count() == 1
    assert run("pending_dates").agg(F.max("trade_date")).first()[0].year > 1996


def test_sinks_write_all_sessions(spark, small, monkeypatch):
    from panelkit.sources import io

    written, write = [], io.write_partition
    monkeypatch.setattr(io, "write_partition", lambda panel, path: (written.append(panel.select("trade_date").distinct().count()), write(panel, path)))
    for name in ("write_partition", "scan_features", "scan_levels"):
        registry.queries()[name](spark, small)
    sessions = registry.queries()["scan_bars"](spark, small).select("trade_date").distinct().count()
    assert written == [sessions] * 3


def test_flat_panel_has_all_factors_and_levels(spark, small):
    from panelkit.operators import levels

    got = registry.queries()["panel_rank_flat"](spark, small).columns
    sides = [f"{s}_{h}{d}" for s in ("resistance", "support") for h in levels.HORIZONS for d in ("", "_dist")]
    assert sorted(got) == sorted(["entity", "trade_date", "industry", *catalog.combined().names, *levels.FEATURES, *sides])


def test_extended_factors_come_as_rows(spark, small):
    df = registry.queries()["feat_extended"](spark, small)
    assert df.columns == ["entity", "trade_date", *catalog.extended().names]
    assert df.count() == registry.queries()["scan_bars"](spark, small).count()
