"""Queries of scans, filters, joins, aggregates, sets, sorts and the lineage registry."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelkit.functions import ts, xs
from panelkit.operators import dataset, metrics, order_stats, universe
from panelkit.plans.base import add, rounded, rounded_sql, with_views
from panelkit.sources import bars as source
from panelkit.sources import io

KEYS = ["entity", "trade_date"]
A, B = date(1995, 1, 2), date(1996, 1, 1)
W = "(PARTITION BY entity ORDER BY trade_date)"
B_FUND = "SELECT bars.* EXCLUDE (pe_ttm, pb, circ_mv), fund.* EXCLUDE (entity, trade_date) FROM bars JOIN fund USING (entity, trade_date)"
RET = "close / NULLIF(lag(close) OVER (PARTITION BY entity ORDER BY trade_date), 0) - 1"


def on_bars(f):
    return lambda spark, sf_dir: f(source.bars(spark, sf_dir))


def on_both(f):
    return lambda spark, sf_dir: f(source.bars(spark, sf_dir), source.securities(spark, sf_dir))


def full(panel):
    return source.with_fundamentals(panel)


def keys(df, *more):
    return df.select(*KEYS, *more)


K = "SELECT entity, trade_date FROM"


def _stored(df, name):
    spark = df.sparkSession
    return spark, io.new_path(spark, name)

# scans and sinks: the tables go through the sink and are read back


def _scan_bars(b):
    """Bars written as a tree by date under the source's own names, scanned back."""
    spark, path = _stored(b, "bars")
    raw = b.select(F.col("entity").cast("string").alias("ts_code"), F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), "open", "high", "low", "close", F.col("volume").cast("double").alias("vol"), F.col("amount").cast("double").alias("amount"))
    io.write_partition(raw, path)
    found = io.scan_bars(spark, path, A, date(2001, 12, 31))
    return found.select(F.col("entity").cast("long").alias("entity"), "trade_date", *[rounded(F.col(c), 7).alias(c) for c in ("open", "high", "low", "close", "vwap")], F.col("volume").cast("double").alias("volume"))


add("scan_bars", on_bars(_scan_bars), with_views("SELECT entity, trade_date, " + ", ".join(f"{rounded_sql(c, 7)} AS {c}" for c in ("open", "high", "low", "close", "vwap")) + ", volume FROM bars", "bars"))
add("scan_window_prune", on_bars(lambda b: keys(io.prune(b, A, B, 20))), with_views(f"{K} bars WHERE trade_date BETWEEN DATE '{A}' - {io.margin_days(20)} AND DATE '{B}'", "bars"))
add("scan_fundamentals", on_bars(lambda b: io.with_fundamentals(keys(b, "close"), source.fundamentals(b).where("pe_ttm < 30"), ["pe_ttm", "pb"]).select(*KEYS, rounded(F.col("pe_ttm")).alias("pe_ttm"), rounded(F.col("pb")).alias("pb"))), with_views(f"SELECT entity, trade_date, {rounded_sql('f.pe_ttm')} AS pe_ttm, {rounded_sql('f.pb')} AS pb FROM bars b LEFT JOIN (SELECT * FROM fund WHERE pe_ttm < 30) f USING (entity, trade_date)", "fund"))


def _features(b):
    """A narrow feature panel of all sessions, written by date."""
    spark, path = _stored(b, "features")
    io.write_partition(b.select(*KEYS, rounded(F.col("close")).alias("close")), path)
    return spark, path


FEAT = "SELECT entity, trade_date, floor(close * 1e6 + 0.50001) / 1e6 AS close FROM bars WHERE trade_date < DATE '1995-07-01'"


def _write_all(b):
    spark, path = _features(b)
    return io.scan_dated(spark, path).select(*KEYS, "close")


def _scan_features(b):
    spark, path = _features(b)
    return io.scan_dated(spark, path, date(1995, 2, 1), date(1995, 5, 1)).select(*KEYS, "close")


def _snapshot(b):
    spark, path = _stored(b, "snapshot")
    io.write_snapshot(b.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.parquet(path)


def _export_all(b):
    spark, path = _stored(b, "export")
    io.export(b.select(*KEYS, "volume"), path)
    return spark.read.parquet(path)


add("write_partition", on_bars(_write_all), with_views(f"SELECT entity, trade_date, {rounded_sql('close')} AS close FROM bars", "bars"))
add("export_dataset", on_bars(_export_all), with_views("SELECT entity, trade_date, volume FROM bars", "bars"))
add("scan_features", on_bars(_scan_features), with_views(f"SELECT * FROM ({FEAT}) WHERE trade_date BETWEEN DATE '1995-02-01' AND DATE '1995-05-01'", "bars"))
add("write_snapshot", on_bars(_snapshot), with_views("SELECT entity, count(*) AS n FROM bars GROUP BY entity", "bars"))
add("scan_recent_n_dates", on_bars(lambda b: keys(io.recent_dates(b, B, 5))), with_views(f"{K} bars WHERE trade_date IN (SELECT trade_date FROM d) AND entity IN (SELECT entity FROM bars WHERE trade_date IN (SELECT trade_date FROM d) GROUP BY entity HAVING count(*) = 5)", "bars", "cal", d=f"SELECT trade_date FROM cal WHERE trade_date <= DATE '{B}' ORDER BY trade_date DESC LIMIT 5"))
add("latest_partition", on_bars(lambda b: keys(io.latest_partition(b))), with_views(f"{K} bars WHERE trade_date = (SELECT max(trade_date) FROM bars)", "bars"))


def _merge_stored(b):
    """Columns merged into the stored table's dates, then read back."""
    spark, root = _stored(b, "merge")
    io.merge_into(b.where("volume > 20").select(*KEYS, "volume"), root, "panel", KEYS)
    io.merge_into(b.where("volume < 60").select(*KEYS, (F.col("volume") * 2).alias("volume"), "flag_share"), root, "panel", KEYS)
    return io.scan_stored(spark, root, "panel").select(*KEYS, "volume", rounded(F.col("flag_share")).alias("flag_share"))


add("write_merge_columns", on_bars(_merge_stored), with_views(f"SELECT entity, trade_date, coalesce(n.volume, s.volume) AS volume, {rounded_sql('flag_share')} AS flag_share FROM (SELECT entity, trade_date, volume FROM bars WHERE volume > 20) s FULL JOIN (SELECT entity, trade_date, volume * 2 AS volume, flag_share FROM bars WHERE volume < 60) n USING (entity, trade_date)", "bars"))
add("join_full_outer", on_bars(lambda b: b.where("volume > 30").select(*KEYS, F.col("volume").alias("v1")).join(b.where("volume < 40").select(*KEYS, F.col("volume").alias("v2")), KEYS, "full")), with_views("SELECT entity, trade_date, v1, v2 FROM (SELECT entity, trade_date, volume AS v1 FROM bars WHERE volume > 30) a FULL JOIN (SELECT entity, trade_date, volume AS v2 FROM bars WHERE volume < 40) c USING (entity, trade_date)", "bars"))


def _log(spark, sf_dir):
    """A lineage log from orders: source is the priority, a day's last order is the current row."""
    o = source.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("api_name"), F.col("o_orderdate").cast("date").alias("trade_date"), F.col("o_orderkey").cast("long").alias("row_count"), F.timestamp_seconds(F.col("o_orderkey")).alias("pull_time"))


REG = "SELECT api_name, trade_date, max(row_count) AS row_count FROM (SELECT o_orderpriority AS api_name, CAST(o_orderdate AS DATE) AS trade_date, o_orderkey AS row_count FROM orders) GROUP BY api_name, trade_date"
add("registry_upsert", lambda s, d: io.registry_current(_log(s, d)).select("api_name", "trade_date", "row_count"), REG)
add("registry_last_date", lambda s, d: io.registry_last_date(_log(s, d)), f"SELECT api_name, max(trade_date) AS last_date FROM ({REG}) GROUP BY api_name")
add("registry_delete_since", lambda s, d: io.registry_current(io.registry_delete_since(_log(s, d), "1-URGENT", date(1995, 1, 1), "2030-01-01 00:00:00")).select("api_name", "trade_date", "row_count"), f"SELECT * FROM ({REG}) WHERE NOT (api_name = '1-URGENT' AND trade_date >= DATE '1995-01-01')")
add("registry_summary", lambda s, d: io.registry_summary(_log(s, d)), f"SELECT api_name, count(*) AS n, max(trade_date) AS last_date FROM ({REG}) GROUP BY api_name")
# done is every session of the first four weeks of a quarter
DONE = "month(trade_date) % 3 = 1 and day(trade_date) <= 28"
add("pending_dates", on_bars(lambda b: io.pending_dates(source.calendar(b), b.where(DONE).select("trade_date").distinct(), date(1992, 1, 1), date(2001, 12, 31), 20)), with_views(f"SELECT trade_date FROM nth WHERE nth > 20 AND trade_date BETWEEN DATE '1992-01-01' AND DATE '2001-12-31' AND trade_date NOT IN (SELECT trade_date FROM bars WHERE {DONE})", "bars", "nth"))
add("dedupe_keep_last", lambda s, d: io.dedupe_last(source.table(s, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderkey"), ["o_custkey", "day"], [F.desc("o_orderkey")]), "SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")

# filters and universes
add("filter_complete_rows", on_bars(lambda b: keys(b.select("*", ts.ref("close", 60).alias("c60")).dropna(subset=["pe_ttm", "pb", "c60"]))), with_views(f"{K} (SELECT *, lag(close, 60) OVER {W} AS c60 FROM bars) WHERE pe_ttm IS NOT NULL AND pb IS NOT NULL AND c60 IS NOT NULL", "bars"))
LAB = f"SELECT *, lead(close, 5) OVER {W} AS c5, lead(close, 20) OVER {W} AS c20, lead(close, 60) OVER {W} AS c60, " + ", ".join(f"{f}({c}) OVER (PARTITION BY entity ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) AS {n}{k}" for k in (5, 20) for f, c, n in (("min", "low", "lo"), ("max", "high", "hi"))) + " FROM bars"
VALID = "c60 IS NOT NULL AND hi5 <> lo5 AND hi20 <> lo20"
add("filter_label_valid", on_bars(lambda b: keys(dataset.label_valid(dataset.label_path(b)))), with_views(f"{K} lab WHERE {VALID}", "bars", lab=LAB))
add("select_features", on_bars(lambda b: b.select([c for c in b.columns if c not in ("open", "high", "low", "close", "vwap", "amount", "pe_ttm", "pb", "circ_mv", "flag_share")])), with_views("SELECT entity, trade_date, volume FROM bars", "bars"))
add("split_train_val", on_bars(lambda b: keys(b.withColumn("split", dataset.split_dates(A, date(1995, 3, 1), B)), "split")), with_views(f"SELECT entity, trade_date, CASE WHEN trade_date <= DATE '{A}' THEN 'train' WHEN trade_date BETWEEN DATE '1995-03-01' AND DATE '{B}' THEN 'val' END AS split FROM bars", "bars"))
PURGE = f"""SELECT coalesce((SELECT trade_date FROM nth WHERE nth = greatest((SELECT nth FROM nth WHERE trade_date = DATE '{A}') - 60, 1)), DATE '{A}') AS train_end,
 coalesce((SELECT trade_date FROM nth WHERE nth = least((SELECT nth FROM nth WHERE trade_date = DATE '{B}') + 5, (SELECT max(nth) FROM nth))), DATE '{B}') AS val_start"""
add("split_purge_embargo", on_bars(lambda b: dataset.purge_embargo(source.calendar(b), A, B)), with_views(PURGE, "nth"))
add("universe_main_board", on_both(lambda b, s: keys(universe.in_market(b, s, without=["AFRICA"]))), with_views(f"{K} bars WHERE entity IN (SELECT entity FROM sec WHERE market <> 'AFRICA')", "bars", "sec"))
unflagged = on_bars(lambda b: keys(universe.exclude_flagged(b, source.flags(b))))
UNFLAGGED = with_views(f"{K} bars ANTI JOIN flags USING (entity, trade_date)", "flags")
add("universe_exclude_flagged", unflagged, UNFLAGGED)
add("join_anti_flags", unflagged, UNFLAGGED)
add("set_minus_flags", on_bars(lambda b: keys(b).exceptAll(source.flags(b))), with_views(f"{K} bars EXCEPT {K} flags", "flags"))
add("universe_min_price", on_bars(lambda b: keys(universe.min_price(b, b, 1500.0))), with_views(f"{K} bars WHERE high >= 1500.0", "bars"))
MEDS = "SELECT *, median(pe_ttm) OVER (PARTITION BY trade_date, industry) AS mpe, median(pb) OVER (PARTITION BY trade_date, industry) AS mpb FROM b_fund JOIN sec USING (entity) WHERE pe_ttm IS NOT NULL AND pb IS NOT NULL AND circ_mv IS NOT NULL AND turnover_rate IS NOT NULL"
GOOD = "circ_mv >= 10000 AND turnover_rate >= 0.1 AND pe_ttm > 0 AND pe_ttm < mpe * 1.5 AND pe_ttm >= mpe * 0.1 AND pb > 0 AND pb < mpb * 1.5"
qual = lambda b, s: full(b).join(s, "entity")
add("universe_quality", on_both(lambda b, s: keys(universe.quality(qual(b, s), 10_000))), with_views(f"{K} m WHERE {GOOD} AND pb >= mpb * 0.1", "fund", "sec", b_fund=B_FUND, m=MEDS))
add("universe_quality_lite", on_both(lambda b, s: keys(universe.quality_lite(qual(b, s), source.flags(b), 10_000))), with_views(f"{K} m ANTI JOIN flags USING (entity, trade_date) WHERE {GOOD}", "fund", "sec", "flags", b_fund=B_FUND, m=MEDS))
# the test tables' pb lies above 12, so a fifth of it is asked for
# the ratio of a lone tax or discount lies on a bound, so ratios and amounts are rounded before they are compared
add("universe_absolute_quality", on_bars(lambda b: keys(universe.absolute_quality(full(b).withColumns({"pe_ttm": rounded(F.col("pe_ttm")), "pb": rounded(F.col("pb")) / 5, "circ_mv": rounded(F.col("circ_mv"))}).withColumn("listed", F.min("trade_date").over(Window.partitionBy("entity"))), "listed", 1000.0))), with_views(f"{K} (SELECT *, min(trade_date) OVER (PARTITION BY entity) AS listed FROM b_fund) WHERE trade_date - listed >= 365 AND {rounded_sql('circ_mv')} >= 1000 AND {rounded_sql('pe_ttm')} > 5 AND {rounded_sql('pe_ttm')} < 40 AND {rounded_sql('pb')} / 5 > 0 AND {rounded_sql('pb')} / 5 < 10 AND turnover_rate > 0.1", "fund", b_fund=B_FUND))
add("universe_cap_percentile", on_bars(lambda b: universe.cap_percentile(b, 0.7).select("entity").distinct()), with_views("SELECT entity FROM c WHERE cap >= (SELECT cap FROM (SELECT cap, row_number() OVER (ORDER BY cap, entity) - 1 AS i, count(*) OVER () AS n FROM c) WHERE i = floor(n * 0.7))", "bars", c="SELECT entity, max(circ_mv) AS cap FROM bars GROUP BY entity"))
add("filter_min_history", on_bars(lambda b: universe.min_history(b, 285, 40).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))), with_views("SELECT entity, n FROM (SELECT entity, count(*) AS n FROM bars GROUP BY entity HAVING count(*) >= 285) ORDER BY md5(CAST(entity AS VARCHAR)), entity LIMIT 40", "bars"))

# joins
add("join_left_panel", on_bars(lambda b: keys(b.select(*KEYS, "close").join(source.fundamentals(b).where("volume_ratio > 1").select(*KEYS, "volume_ratio"), KEYS, "left").withColumn("r", rounded(F.col("volume_ratio"))), "r")), with_views(f"SELECT entity, trade_date, {rounded_sql('volume_ratio')} AS r FROM bars LEFT JOIN (SELECT entity, trade_date, volume_ratio FROM fund WHERE volume_ratio > 1) f USING (entity, trade_date)", "fund"))
add("join_inner_universe", on_bars(lambda b: keys(b.join(b.where("volume > 50").select(*KEYS), KEYS))), with_views(f"{K} bars JOIN (SELECT entity, trade_date FROM bars WHERE volume > 50) USING (entity, trade_date)", "bars"))
add("join_inner_dim", on_both(lambda b, s: keys(b.join(s.where("market <> 'AFRICA'"), "entity"), "industry")), with_views("SELECT entity, trade_date, industry FROM bars JOIN sec USING (entity) WHERE market <> 'AFRICA'", "bars", "sec"))
paths = lambda b: dataset.label_valid(dataset.label_path(b)).select(*KEYS, *[rounded(F.col(f"label_{k}")).alias(f"label_{k}") for k in (5, 20, 60)])
PATHS = f"SELECT entity, trade_date, {rounded_sql('(c5 - lo5) / NULLIF(hi5 - lo5, 0)')} AS label_5, {rounded_sql('(c20 - lo20) / NULLIF(hi20 - lo20, 0)')} AS label_20, {rounded_sql('c60 / NULLIF(close, 0) - 1')} AS label_60 FROM lab WHERE {VALID}"
add("ds_label_path", on_bars(paths), with_views(PATHS, "bars", lab=LAB))
add("join_left_labels", on_bars(lambda b: b.where("volume > 40").select(*KEYS).join(paths(b), KEYS)), with_views(f"SELECT p.* FROM bars JOIN ({PATHS}) p USING (entity, trade_date) WHERE volume > 40", "bars", lab=LAB))
add("join_two_panels", on_bars(lambda b: b.select(*KEYS, "volume").join(source.fundamentals(b).drop("pe_ttm", "pb", "circ_mv").select(*KEYS, rounded(F.col("turnover_rate")).alias("turnover")), KEYS)), with_views(f"SELECT entity, trade_date, volume, {rounded_sql('turnover_rate')} AS turnover FROM bars JOIN fund USING (entity, trade_date)", "fund"))
add("join_map_lookup", on_both(lambda b, s: keys(b.join(s.where("market <> 'ASIA'").select("entity", "industry"), "entity", "left").withColumn("industry", F.coalesce("industry", F.lit("Unknown"))), "industry")), with_views("SELECT entity, trade_date, coalesce(s.industry, 'Unknown') AS industry FROM bars LEFT JOIN (SELECT * FROM sec WHERE market <> 'ASIA') s USING (entity)", "bars", "sec"))
TOP = f"SELECT entity, row_number() OVER (ORDER BY {rounded_sql('pred')} DESC NULLS LAST, entity) AS nth FROM pred WHERE trade_date = (SELECT max(trade_date) FROM pred)"


def _scores(b):
    """Scores of the latest session; one row for each entity."""
    return io.latest_partition(source.predictions(b)).select("entity", rounded(F.col("pred")).alias("score"))


def _best(b, k):
    """The first k of the ranking; only they are numbered."""
    order = [F.desc_nulls_last("score"), F.col("entity")]
    return _scores(b).orderBy(*order).limit(k).select("entity", F.row_number().over(Window.orderBy(*order)).alias("nth"))


def _worst(b, k):
    """The last k of the ranking, by their place from its end; only they are numbered."""
    scores, order = _scores(b), [F.asc_nulls_first("score"), F.desc("entity")]
    last = scores.orderBy(*order).limit(k).withColumn("from_end", F.row_number().over(Window.orderBy(*order)))
    return last.crossJoin(scores.agg(F.count(F.lit(1)).alias("total"))).select("entity", (F.col("total") - F.col("from_end") + 1).cast("int").alias("nth"))


def _ranking(b):
    """Scores of the latest session with their places, numbered range by range."""
    return order_stats.numbered(_scores(b), [F.col("score").desc_nulls_last(), F.col("entity").asc()], out="nth")


add("join_holdings_rank", on_both(lambda b, s: s.select("entity", "name").join(_ranking(b), "entity", "left").select("entity", "name", F.coalesce(F.col("nth").cast("string"), F.lit("not in scope")).alias("place"))), with_views(f"SELECT entity, name, coalesce(CAST(nth AS VARCHAR), 'not in scope') AS place FROM sec LEFT JOIN ({TOP}) t USING (entity)", "pred", "sec"))
prev = f"SELECT *, lag(above) OVER {W} AS was, lag(nth) OVER {W} AS before FROM (SELECT entity, trade_date, coalesce(s > l, false) AS above, nth FROM (SELECT *, avg(close) OVER (PARTITION BY entity ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s, avg(close) OVER (PARTITION BY entity ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM bars) JOIN nth USING (trade_date))"


def _prev_session(b):
    nth = dataset.session_ordinals(source.calendar(b))
    rows = b.select(*KEYS, F.coalesce(ts.mean("close", 5) > ts.mean("close", 20), F.lit(False)).alias("above")).join(F.broadcast(nth), "trade_date")
    rows = rows.select(*KEYS, "above", "nth", F.lag("above").over(ts.over()).alias("was"), F.lag("nth").over(ts.over()).alias("before"))
    return rows.where("before = nth - 1").select(*KEYS, "above", "was")


add("join_prev_session", on_bars(_prev_session), with_views(f"SELECT entity, trade_date, above, was FROM ({prev}) WHERE before = nth - 1", "bars", "nth"))

# aggregates
preds = lambda b: source.predictions(b).select(*KEYS, rounded(F.col("pred")).alias("pred"), rounded(F.col("actual")).alias("actual"))
PREDS = f"SELECT entity, trade_date, {rounded_sql('pred')} AS pred, {rounded_sql('actual')} AS actual FROM pred"
add("agg_distinct_flags", on_bars(lambda b: source.flags(b).distinct()), with_views("SELECT DISTINCT entity, trade_date FROM flags", "flags"))
add("agg_group_sizes", on_bars(lambda b: b.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))), with_views("SELECT trade_date, count(*) AS n FROM bars GROUP BY trade_date", "bars"))
add("agg_logvol_stats", on_bars(lambda b: b.agg(rounded(F.avg(F.log1p("volume"))).alias("mean"), rounded(F.stddev_pop(F.log1p("volume")) + 1e-8).alias("std"))), with_views(f"SELECT {rounded_sql('avg(ln(1 + volume))')} AS mean, {rounded_sql('stddev_pop(ln(1 + volume)) + 1e-8')} AS std FROM bars", "bars"))
SPEAR = "SELECT trade_date, count(*) AS n, covar_samp(a, b) / NULLIF(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM (SELECT trade_date, " + ", ".join(f"rank() OVER (PARTITION BY trade_date ORDER BY {c}) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0 AS {n}" for c, n in (("pred", "a"), ("actual", "b"))) + " FROM p WHERE pred IS NOT NULL AND actual IS NOT NULL) GROUP BY trade_date HAVING count(*) >= 3"
IC = f"SELECT count(ic) AS n_dates, {rounded_sql('avg(ic)')} AS ic_mean, {rounded_sql('stddev_samp(ic)')} AS ic_std, {rounded_sql('avg(ic) / stddev_samp(ic)')} AS icir FROM ({SPEAR})"
rank_ic = on_bars(lambda b: metrics.rank_ic(preds(b)).select("n_dates", *[rounded(F.col(c)).alias(c) for c in ("ic_mean", "ic_std", "icir")]))
add("agg_rank_ic", rank_ic, with_views(IC, "pred", p=PREDS))
add("agg_rank_corr_argsort", on_bars(lambda b: metrics.rank_ic(preds(b)).select("n_dates", rounded(F.col("ic_mean")).alias("ic_mean"))), with_views(f"SELECT count(ic) AS n_dates, {rounded_sql('avg(ic)')} AS ic_mean FROM ({SPEAR})", "pred", p=PREDS))
add("agg_mse_mae", on_bars(lambda b: preds(b).dropna().agg(rounded(F.avg(F.pow(F.col("actual") - F.col("pred"), 2.0))).alias("mse"), rounded(F.avg(F.abs(F.col("actual") - F.col("pred")))).alias("mae"))), with_views(f"SELECT {rounded_sql('avg(pow(actual - pred, 2.0))')} AS mse, {rounded_sql('avg(abs(actual - pred))')} AS mae FROM p WHERE actual IS NOT NULL AND pred IS NOT NULL", "pred", p=PREDS))
add("agg_pinball", on_bars(lambda b: preds(b).dropna().agg(*[rounded(metrics.pinball("actual", "pred", a)).alias(f"loss_{int(a * 100)}") for a in (0.1, 0.5, 0.9)])), with_views("SELECT " + ", ".join(f"{rounded_sql(f'avg(greatest({a} * (actual - pred), ({a} - 1) * (actual - pred)))')} AS loss_{int(a * 100)}" for a in (0.1, 0.5, 0.9)) + " FROM p WHERE actual IS NOT NULL AND pred IS NOT NULL", "pred", p=PREDS))
bins = lambda b: preds(b).dropna().select(*KEYS, *[F.when(F.col(c) < -0.2, 0).when(F.col(c) < -0.05, 1).when(F.col(c) < 0.05, 2).when(F.col(c) < 0.2, 3).otherwise(4).alias(n) for c, n in (("actual", "t"), ("pred", "p"))])
BINS = "SELECT entity, trade_date, " + ", ".join(f"CASE WHEN {c} < -0.2 THEN 0 WHEN {c} < -0.05 THEN 1 WHEN {c} < 0.05 THEN 2 WHEN {c} < 0.2 THEN 3 ELSE 4 END AS {n}" for c, n in (("actual", "t"), ("pred", "p"))) + " FROM pr WHERE actual IS NOT NULL AND pred IS NOT NULL"
add("agg_confusion", on_bars(lambda b: metrics.confusion(bins(b), "t", "p", 5).select("t", *[F.col(str(k)).alias(f"p{k}") for k in range(5)])), with_views("SELECT t, " + ", ".join(f"count(*) FILTER (p = {k}) AS p{k}" for k in range(5)) + " FROM bn GROUP BY t", "pred", pr=PREDS, bn=BINS))
F1 = "SELECT c, sum(CASE WHEN t = c AND p = c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN t = c THEN 1 ELSE 0 END) AS re, sum(CASE WHEN p = c THEN 1 ELSE 0 END) AS pr FROM bn, (SELECT DISTINCT t AS c FROM bn UNION SELECT DISTINCT p FROM bn) GROUP BY c"
add("agg_macro_f1", on_bars(lambda b: metrics.macro_f1(bins(b), "t", "p").select(rounded(F.col("accuracy")).alias("accuracy"), rounded(F.col("macro_f1")).alias("macro_f1"))), with_views(f"SELECT {rounded_sql('sum(tp) / sum(re)')} AS accuracy, {rounded_sql('avg(CASE WHEN tp > 0 THEN 2.0 * tp / (re + pr) ELSE 0 END)')} AS macro_f1 FROM ({F1})", "pred", pr=PREDS, bn=BINS))
add("agg_class_counts", on_bars(lambda b: bins(b).groupBy(F.col("t").alias("label")).agg(F.count(F.lit(1)).alias("n"))), with_views("SELECT t AS label, count(*) AS n FROM bn GROUP BY t", "pred", pr=PREDS, bn=BINS))
SCORES = "SELECT * FROM pred WHERE pred IS NOT NULL"
add("agg_score_stats", on_bars(lambda b: source.predictions(b).groupBy("trade_date").agg(F.count("pred").alias("n"), *[rounded(f("pred")).alias(n) for f, n in ((F.avg, "mean"), (F.median, "median"), (F.min, "least"), (F.max, "most"))])), with_views("SELECT trade_date, count(pred) AS n, " + ", ".join(f"{rounded_sql(f'{f}(pred)')} AS {n}" for f, n in (("avg", "mean"), ("median", "median"), ("min", "least"), ("max", "most"))) + " FROM pred GROUP BY trade_date", "pred"))
REWARD = "SELECT entity, avg(r) AS m, stddev_samp(r) AS sd, product(1 + r) - 1 AS total FROM (SELECT entity, actual * 0.01 AS r FROM pred WHERE actual IS NOT NULL) GROUP BY entity"
add("agg_entity_reward_stats", on_bars(lambda b: (lambda m: m.select("entities", *[rounded(F.col(c), 5).alias(c) for c in m.columns if c != "entities"]))(metrics.reward_stats(source.predictions(b).where("actual is not null").select("entity", (F.col("actual") * 0.01).alias("reward"))))), with_views(f"SELECT count(*) AS entities, {rounded_sql('avg(m)', 5)} AS mean_reward, {rounded_sql('avg(total)', 5)} AS mean_total, {rounded_sql('median(total)', 5)} AS median_total, {rounded_sql('avg(coalesce(m / NULLIF(sd, 0), 0) * sqrt(252.0))', 5)} AS mean_sharpe, {rounded_sql('avg(CASE WHEN total > 0 THEN 1.0 ELSE 0.0 END)', 5)} AS win_rate FROM ({REWARD})", "pred"))
NAV = "SELECT trade_date, sum(amount) AS total_value, CASE WHEN extract('month' FROM trade_date) = 1 THEN 100.0 ELSE 0.0 END AS added FROM bars GROUP BY trade_date"
nav = lambda b: b.groupBy("trade_date").agg(F.sum("amount").alias("total_value")).withColumn("added", F.when(F.month("trade_date") == 1, 100.0).otherwise(0.0))
EQ = f"""SELECT {rounded_sql('fv', 2)} AS final_value, {rounded_sql('ti', 2)} AS total_invested, {rounded_sql('fv / ti - 1')} AS cumulative_return, {rounded_sql('pow(fv / ti, 252.0 / n) - 1')} AS annualized_return,
 {rounded_sql('coalesce((m * 252 - 0.025) / NULLIF(sd * sqrt(252.0), 0), 0)')} AS sharpe, {rounded_sql('mdd')} AS max_drawdown, CASE WHEN mdd < 0 THEN ddd END AS max_drawdown_date FROM
 (SELECT arg_max(total_value, trade_date) AS fv, sum(added) + 1000000.0 AS ti, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, min(dd) AS mdd, arg_min(trade_date, (dd, trade_date)) AS ddd FROM
 (SELECT *, (total_value - added) / lag(total_value) OVER (ORDER BY trade_date) - 1 AS ret, total_value / max(total_value) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM nv))"""
add("agg_equity_metrics", on_bars(lambda b: (lambda m: m.select(*[rounded(F.col(c), 2 if c in ("final_value", "total_invested") else 6).alias(c) for c in m.columns if c != "max_drawdown_date"], "max_drawdown_date"))(metrics.equity_metrics(nav(b), 1_000_000.0))), with_views(EQ, "bars", nv=NAV))
sells = lambda b: b.select("entity", F.trunc("trade_date", "month").alias("buy_date"), (F.col("close") - F.col("open")).alias("pnl"))
add("agg_position_win_rate", on_bars(lambda b: metrics.position_win_rate(sells(b)).select("positions", rounded(F.col("win_rate")).alias("win_rate"))), with_views(f"SELECT count(*) AS positions, {rounded_sql('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate FROM (SELECT entity, date_trunc('month', trade_date) AS m, sum(close - open) AS pnl FROM bars GROUP BY ALL)", "bars"))
add("agg_fold_summary", on_bars(lambda b: preds(b).dropna().groupBy(F.year("trade_date").alias("fold")).agg(F.avg("actual").alias("ret"), F.min("actual").alias("dd"), F.count(F.lit(1)).alias("n")).agg(rounded(F.avg("ret")).alias("mean_return"), rounded(F.min("dd")).alias("worst"), F.sum("n").alias("trades"))), with_views(f"SELECT {rounded_sql('avg(ret)')} AS mean_return, {rounded_sql('min(dd)')} AS worst, CAST(sum(n) AS BIGINT) AS trades FROM (SELECT year(trade_date) AS fold, avg(actual) AS ret, min(actual) AS dd, count(*) AS n FROM p WHERE actual IS NOT NULL AND pred IS NOT NULL GROUP BY fold)", "pred", p=PREDS))


def _probs(spark, sf_dir):
    """Distributions from embeddings: absolute values over their sum; the true bin is the label."""
    e = source.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("a"))
    e = e.withColumn("s", F.aggregate("a", F.lit(0.0), lambda x, v: x + v))
    return e.select("vec_id", "label", F.transform("a", lambda v: v / F.col("s")).alias("probs"), (F.size("a") - 1).alias("last"))


PROBS = "SELECT vec_id, label, list_transform(a, lambda v: v / s) AS probs, len(a) - 1 AS last FROM (SELECT *, list_sum(a) AS s FROM (SELECT vec_id, label, list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))) AS a FROM embeddings))"
add("agg_topn_hit", lambda s, d: _probs(s, d).agg(F.sum(metrics.in_top(F.col("probs"), F.col("label")).cast("int")).alias("hits"), F.sum((F.array_position("probs", F.array_max("probs")) - 1 == F.col("last")).cast("int")).alias("no_peak")), f"SELECT CAST(sum(CASE WHEN list_contains(list_transform(list_sort(list_transform(probs, lambda p, i: {{'p': -p, 'i': i - 1}}))[1:3], lambda x: x.i), label) THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN list_position(probs, list_max(probs)) - 1 = last THEN 1 ELSE 0 END) AS BIGINT) AS no_peak FROM ({PROBS})")
# labels from 8 on stand for no peak
TRUTH = "CASE WHEN label >= 8 THEN last ELSE label END"
HIT = "list_contains(list_transform(list_sort(list_transform(probs, lambda p, i: {'p': -p, 'i': i - 1}))[1:3], lambda x: x.i), t)"
add("agg_peak_hits", lambda s, d: metrics.peak_hits(_probs(s, d).withColumn("t", F.expr(TRUTH)), "probs", "t", "last").select("n", "peaks", *[rounded(F.col(c)).alias(c) for c in ("hit", "peak_found", "hit_given_peak")]), f"SELECT count(*) AS n, CAST(sum(CASE WHEN t <> last THEN 1 ELSE 0 END) AS BIGINT) AS peaks, {rounded_sql(f'avg(CASE WHEN {HIT} THEN 1.0 ELSE 0.0 END)')} AS hit, {rounded_sql('avg(CASE WHEN (list_position(probs, list_max(probs)) - 1 <> last) = (t <> last) THEN 1.0 ELSE 0.0 END)')} AS peak_found, {rounded_sql(f'avg(CASE WHEN t <> last THEN CASE WHEN {HIT} THEN 1.0 ELSE 0.0 END END)')} AS hit_given_peak FROM (SELECT *, {TRUTH} AS t FROM ({PROBS}))")
add("agg_entropy_xent", lambda s, d: _probs(s, d).agg(rounded(F.avg(metrics.entropy(F.col("probs")))).alias("entropy"), rounded(F.avg(metrics.cross_entropy(F.col("probs"), F.col("label")))).alias("xent")), f"SELECT {rounded_sql('avg(list_sum(list_transform(probs, lambda p: -p * ln(p + 1e-8))))')} AS entropy, {rounded_sql('avg(-ln(probs[label + 1] + 1e-8))')} AS xent FROM ({PROBS})")

# sorts, top-k, sets
add("sort_output", on_bars(lambda b: b.select(*KEYS, "volume").orderBy(*KEYS)), with_views("SELECT entity, trade_date, volume FROM bars ORDER BY entity, trade_date", "bars"))
add("topk_scores", on_both(lambda b, s: _best(b, 10).join(s.select("entity", "name"), "entity").select("nth", "entity", "name")), with_views(f"SELECT nth, entity, name FROM ({TOP}) JOIN sec USING (entity) WHERE nth <= 10", "pred", "sec"))
add("bottomk_scores", on_bars(lambda b: _worst(b, 10)), with_views(f"SELECT entity, nth FROM ({TOP}) ORDER BY nth DESC LIMIT 10", "pred"))


def _open_slots(b):
    rows = source.predictions(b).withColumn("score", rounded(F.col("pred"))).withColumn("held", (F.col("entity") % 11 == 0) & F.col("pred").isNotNull())
    held = F.sum(F.col("held").cast("int")).over(xs.by_date())
    nth = F.row_number().over(xs.by_date("held").orderBy(F.desc_nulls_last("score"), "entity"))
    return rows.select(*KEYS, "held", held.alias("n"), nth.alias("nth")).where("not held and nth <= 15 - n").select(*KEYS)


add("topk_open_slots", on_bars(_open_slots), with_views(f"{K} (SELECT *, sum(CASE WHEN held THEN 1 ELSE 0 END) OVER (PARTITION BY trade_date) AS n, row_number() OVER (PARTITION BY trade_date, held ORDER BY s DESC NULLS LAST, entity) AS nth FROM (SELECT *, {rounded_sql('pred')} AS s, entity % 11 = 0 AND pred IS NOT NULL AS held FROM pred)) WHERE NOT held AND nth <= 15 - n", "pred"))
add("latest_per_entity", on_bars(lambda b: b.select(*KEYS, "volume", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("trade_date"))).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("entity")).alias("n")).where("k = 1 and n >= 60").select(*KEYS, "volume")), with_views("SELECT entity, max(trade_date) AS trade_date, arg_max(volume, trade_date) AS volume FROM bars GROUP BY entity HAVING count(*) >= 60", "bars"))
add("set_intersect_quality", on_bars(lambda b: b.where("volume > 40").select(*KEYS).intersect(b.where("high > 1500").select(*KEYS))), with_views(f"{K} bars WHERE volume > 40 INTERSECT {K} bars WHERE high > 1500", "bars"))
add("set_union_rows", on_bars(lambda b: b.select(*KEYS, "volume").unionByName(b.groupBy("trade_date").agg(F.sum("volume").alias("volume")), allowMissingColumns=True)), with_views("SELECT entity, trade_date, volume FROM bars UNION ALL SELECT NULL, trade_date, sum(volume) FROM bars GROUP BY trade_date", "bars"))


def _enter_exit(b):
    """Membership of the top 10 of each session against that of the session before."""
    top = xs.top_k(source.predictions(b).withColumn("score", rounded(F.col("pred"))), "score", 10).select(*KEYS)
    nth = F.broadcast(dataset.session_ordinals(source.calendar(b)))
    now = top.join(nth, "trade_date").select("entity", "nth", F.lit(True).alias("now"))
    before = top.join(nth, "trade_date").select("entity", (F.col("nth") + 1).alias("nth"), F.lit(True).alias("before"))
    both = now.join(before, ["entity", "nth"], "full").where("now is null or before is null")
    return both.select("entity", "nth", F.when(F.col("now"), "enter").otherwise("exit").alias("change"))


TOP10 = f"SELECT entity, nth FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY {rounded_sql('pred')} DESC NULLS LAST, entity) AS k FROM pred) JOIN nth USING (trade_date) WHERE k <= 10"
add("set_enter_exit", on_bars(_enter_exit), with_views("SELECT entity, nth, CASE WHEN n THEN 'enter' ELSE 'exit' END AS change FROM (SELECT *, true AS n FROM t) FULL JOIN (SELECT entity, nth + 1 AS nth, true AS b FROM t) USING (entity, nth) WHERE n IS NULL OR b IS NULL", "pred", "nth", t=TOP10))
add("fn_nearest_session", on_bars(lambda b: source.calendar(b).agg(dataset.nearest_session(b, date(1995, 1, 4)).alias("after"), dataset.nearest_session(b, date(1995, 1, 4), False).alias("before"))), with_views("SELECT min(trade_date) FILTER (trade_date >= DATE '1995-01-04') AS after, max(trade_date) FILTER (trade_date <= DATE '1995-01-04') AS before FROM cal", "cal"))
