"""Queries of time-series and cross-sectional windows and of scalar functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelkit.functions import scalar, ts, xs
from panelkit.operators import catalog
from panelkit.plans.base import Stored, add, add_columns, rounded, rounded_sql, with_views
from panelkit.sources import bars as source


def tr(n: int) -> str:
    return f"(w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def fw(a: int, b: int) -> str:
    side = lambda k: "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"
    return f"(w ROWS BETWEEN {side(a)} AND {side(b)})"


def q(a: str, b: str) -> str:
    return f"({a}) / NULLIF({b}, 0)"


def corr_sql(x: str, y: str, n: int) -> str:
    return q(f"covar_samp({x}, {y}) OVER {tr(n)}", f"(stddev_samp({x}) OVER {tr(n)}) * (stddev_samp({y}) OVER {tr(n)})")


RN = {"rn": (ts.row_number, "row_number() OVER w")}
DIFF = {"diff": (lambda: F.col("close") - ts.ref("close", 1), "close - lag(close) OVER w")}
TRUE = {"trng": (ts.true_range, "greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))")}

add_columns("ts_ref", {f"ref_{n}": (lambda n=n: ts.ref("close", n), f"lag(close, {n}) OVER w", 6) for n in (1, 2)})
add_columns("ts_delta", {f"delta_{n}": (lambda n=n: ts.delta("close", n), f"close - lag(close, {n}) OVER w", 6) for n in (5, 60)})
add_columns("ts_mean", {f"mean_{n}": (lambda r, n=n: r.mean("close", n), f"avg(close) OVER {tr(n)}", 4) for n in (5, 20, 60)})
add_columns("ts_std", {f"std_{n}": (lambda r, n=n: r.std("close", n), f"stddev_samp(close) OVER {tr(n)}", 4) for n in (5, 20, 60)})
add_columns("ts_sum", {f"sum_{n}": (lambda r, n=n: r.total("close", n), f"sum(close) OVER {tr(n)}", 4) for n in (5, 60)})
add_columns("ts_max", {f"max_{n}": (lambda r, n=n: r.high("high", n), f"max(high) OVER {tr(n)}", 6) for n in (5, 60)})
add_columns("ts_min", {f"min_{n}": (lambda r, n=n: r.low("low", n), f"min(low) OVER {tr(n)}", 6) for n in (5, 60)})
add_columns("ts_corr", {f"corr_{n}": (lambda r, n=n: r.corr("close", "volume", n), corr_sql("close", "volume", n), 5) for n in (5, 20, 60)})
add_columns("ts_row_number", {"nth": (ts.row_number, "row_number() OVER w", None)})
add_columns("ts_window_pos", {f"pos_{n}": (lambda n=n: ts.window_position(n), f"rn - min(rn) OVER {tr(n)}", None) for n in (5, 10, 12, 14, 20, 26, 30, 60)}, stage=RN)
add_columns(
    "ts_ema_weighted",
    {f"ema_{n}": (lambda n=n: ts.ema_weighted("close", n, f"p{n}"), f"sum(close * pow({(n - 1) / (n + 1)!r}, p{n})) OVER {tr(n)} / sum(pow({(n - 1) / (n + 1)!r}, p{n})) OVER {tr(n)}", 4) for n in (12, 26)},
    stage={f"p{n}": (lambda n=n: ts.window_position(n), f"least(row_number() OVER w - 1, {n - 1})") for n in (12, 26)},
)
add_columns("ts_reg_slope", {f"slope_{n}": (lambda r, n=n: r.slope("close", n), f"CASE WHEN rn > 1 THEN regr_slope(close, CAST(rn AS DOUBLE)) OVER {tr(n)} END", 5) for n in (5, 20)}, stage=RN)
gain, loss = (f"avg(CASE WHEN diff {s} 0 THEN {m}diff ELSE 0.0 END) OVER {tr(14)}" for s, m in ((">", ""), ("<", "-")))
add_columns("ts_rsi", {"rsi_14": (lambda: ts.rsi(F.col("diff"), 14), f"100.0 - 100.0 / (1.0 + {gain} / NULLIF({loss}, 0.0))", 4)}, stage=DIFF)
channel = lambda n: q(f"avg(close) OVER {tr(n)} - min(close) OVER {tr(n)}", f"max(close) OVER {tr(n)} - min(close) OVER {tr(n)}")
ext = catalog.extended().factors
add_columns("ts_channel_pos", {
    "chp30": (ext["CHP30"].build, q(f"close - min(low) OVER {tr(30)}", f"max(high) OVER {tr(30)} - min(low) OVER {tr(30)}"), 6),
    "skewp10": (ext["SKEWP10"].build, channel(10), 5), "skewp20": (ext["SKEWP20"].build, channel(20), 5)})
ema = lambda n: f"(sum(close * pow({(n - 1) / (n + 1)!r}, p{n})) OVER {tr(n)} / sum(pow({(n - 1) / (n + 1)!r}, p{n})) OVER {tr(n)})"
add_columns("ts_macd", {"macd": (lambda: F.col("ema12") - F.col("ema26"), "ema12 - ema26", 4)}, stage={
    **{f"p{n}": (lambda n=n: ts.window_position(n), f"least(row_number() OVER w - 1, {n - 1})") for n in (12, 26)},
    **{f"ema{n}": (lambda n=n: ts.ema_weighted("close", n, f"p{n}"), ema(n)) for n in (12, 26)}})
# whether a range is one of the last bit alone hangs on the order of adding; the SQL has no use for first and last lines here and adds in the order of the file
add_columns("ts_minmax_750", {f"{c}_mm": (lambda r, c=c: r.minmax(c, 750), q(f"{c} - min({c}) OVER {tr(750)}", f"max({c}) OVER {tr(750)} - min({c}) OVER {tr(750)}"), 6) for c in ("pe_ttm", "pb", "roe", "total_mv")}, views=("bars", "fund"), stage={"roe": (lambda: ts.div("pb", "pe_ttm"), "pb / NULLIF(pe_ttm, 0)")}, file_order=True)
add_columns("ts_lead", {f"lead_{n}": (lambda n=n: ts.lead("close", n), f"lead(close, {n}) OVER w", 6) for n in (5, 20, 60)})
add_columns("ts_fwd_extremes", {k: v for n in (5, 20) for k, v in {f"low_{n}": (lambda r, n=n: r.extreme("low", 0, n, -1), f"min(low) OVER {fw(0, n)}", 6), f"high_{n}": (lambda r, n=n: r.extreme("high", 0, n, 1), f"max(high) OVER {fw(0, n)}", 6)}.items()})
add_columns("ts_back_return", {f"back_{n}": (lambda n=n: ts.back_return("close", n), f"close / NULLIF(lag(close, {n}) OVER w, 0) - 1", 6) for n in (5, 20)})
add_columns("ts_vol_ratio", {"vol_ratio": (lambda: F.coalesce(ts.div("volume", ts.mean("volume", 20)), F.lit(1.0)), f"coalesce({q('volume', f'avg(volume) OVER {tr(20)}')}, 1.0)", 6)})
add_columns("ts_hl_ratio", {"hl_ratio": (lambda: ts.div(F.col("high") - F.col("low"), "close"), "(high - low) / NULLIF(close, 0)", 6)})
add_columns("ts_ret_5d", {"ret_5d": (lambda: F.coalesce(ts.back_return("close", 5), F.lit(0.0)), "coalesce(close / NULLIF(lag(close, 5) OVER w, 0) - 1, 0.0)", 6)})
add_columns("ts_close_ma20", {"close_ma20": (lambda: ts.div("close", ts.mean("close", 20)) - 1, q("close", f"avg(close) OVER {tr(20)}") + " - 1", 6)})
add_columns("ts_true_range", {"true_range": (ts.true_range, TRUE["trng"][1], 6)})
add_columns("ts_atr_ratio", {"atr_ratio": (lambda: ts.div(ts.mean("trng", 14), "close"), q(f"avg(trng) OVER {tr(14)}", "close"), 6)}, stage=TRUE)
add_columns("ts_log_change", {f"{c}_change": (lambda c=c: ts.log_change(c), f"ln({c} / NULLIF(lag({c}) OVER w, 0))", 6) for c in ("volume", "amount")})
EWM = "list_reduce(list_prepend(NULL, list(close) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), lambda a, z: coalesce(a * (19.0 / 21.0) + z * (2.0 / 21.0), z))"
EMA20 = Stored(lambda panel, name: ts.with_ewm(panel, "close", 20, name))
add_columns("ts_ewm", {"ewm": (lambda: F.col("ema"), "ema", 4)}, stage={**RN, "ema": (EMA20, EWM)})
KELT = {**RN, **TRUE, "ema": (EMA20, EWM), "atr": (lambda: ts.mean("trng", 20), f"avg(trng) OVER {tr(20)}")}
add_columns("ts_keltner", {
    "pos": (lambda: ts.div(F.col("close") - F.col("ema"), F.col("atr") * 2), q("close - ema", "atr * 2"), 6),
    "width": (lambda: ts.div("atr", "ema"), q("atr", "ema"), 6), "above": (lambda: ts.div("close", "ema") - 1, q("close", "ema") + " - 1", 6)}, stage=KELT)
add_columns("ts_ema_slope", {"slope": (lambda: (F.col("above") - ts.ref("above", 5)) / 5, "(above - lag(above, 5) OVER w) / 5", 6)}, stage={**RN, "ema": (EMA20, EWM), "above": (lambda: ts.div("close", "ema") - 1, q("close", "ema") + " - 1")})
PEAKS = (2, 10, 30)
add_columns("ts_local_peak", {f"peak_{n}": (lambda r, n=n: F.col("high") == r.extreme("high", -n, n, 1), f"high = max(high) OVER {fw(-n, n)}", None) for n in PEAKS})
add_columns("ts_local_trough", {f"trough_{n}": (lambda r, n=n: F.col("low") == r.extreme("low", -n, n, -1), f"low = min(low) OVER {fw(-n, n)}", None) for n in PEAKS})
FLAG = {"peak": (lambda: ts.local_peak("high", 2), f"high = max(high) OVER {fw(-2, 2)}"), "trough": (lambda: ts.local_trough("low", 2), f"low = min(low) OVER {fw(-2, 2)}")}
vp = f"peak AND coalesce((high - min(high) OVER {fw(1, 3)}) / high >= 0.005, true)"
vt = f"trough AND coalesce((max(low) OVER {fw(1, 3)} - low) / low >= 0.005, true)"
add_columns("ts_verify_extreme", {"vpeak": (lambda: ts.verified_peak("peak", "high"), vp, None), "vtrough": (lambda: ts.verified_trough("trough", "low"), vt, None)}, stage=FLAG)
near_sql = lambda field: f"min(CASE WHEN vpeak THEN {{'n': rn, 'p': high}} END) OVER {fw(1, 20)}.{field}"
add_columns("ts_nearest_future_extreme", {
    "price": (lambda: F.col("near")["price"], "near.p", 6), "dist": (lambda: F.col("near")["number"] - F.col("rn"), "near.n - rn", None)},
    stage={**RN, **FLAG, "vpeak": (lambda: ts.verified_peak("peak", "high"), vp), "near": (lambda: ts.nearest_future("vpeak", "high", "rn", 20), f"min(CASE WHEN vpeak THEN {{'n': rn, 'p': high}} END) OVER {fw(1, 20)}")})
add_columns("ts_fwd_return", {f"fwd_{n}": (lambda n=n: ts.forward_return("close", n), f"lead(close, {n}) OVER w / NULLIF(close, 0) - 1", 6) for n in (5, 20, 60)})
add_columns("ts_fwd_direction", {f"up_{n}": (lambda n=n: F.when(ts.lead("close", n).isNotNull(), (ts.lead("close", n) >= F.col("close")).cast("int")), f"CASE WHEN lead(close, {n}) OVER w >= close THEN 1 WHEN lead(close, {n}) OVER w < close THEN 0 END", None) for n in (5, 20)})
POS = {**KELT, "pos": (lambda: ts.div(F.col("close") - F.col("ema"), F.col("atr") * 2), q("close - ema", "atr * 2"))}
REG = "CASE WHEN pos > 1.0 THEN 3 WHEN pos < -1.0 THEN 4 WHEN pos >= 0.5 THEN 2 WHEN pos <= -0.5 THEN 1 ELSE 0 END"
add_columns("fn_keltner_regime", {"regime": (lambda: scalar.keltner_regime("pos"), REG, None)}, stage=POS)
add_columns("ts_fwd_regime", {f"regime_{n}": (lambda n=n: ts.lead("regime", n), f"lead(regime, {n}) OVER w", None) for n in (5, 20, 60)}, stage={**POS, "regime": (lambda: scalar.keltner_regime("pos"), REG)})
add_columns("fn_scenario_label", {"label": (lambda: scalar.scenario_label("pos", "vr", "close", "open", "slope"), """CASE WHEN pos > 1.0 AND vr > 1.3 THEN 4 WHEN pos > 1.0 THEN 3 WHEN pos < -1.0 AND vr > 1.3 AND NOT close >= open THEN 2
 WHEN pos < -1.0 AND close >= open THEN 1 WHEN pos > 0.3 AND pos < 0.8 AND slope > 0.005 AND vr > 1.0 THEN 5 ELSE 0 END""", None)}, stage={
    **POS, "vr": (lambda: ts.div("volume", ts.mean("volume", 20)), q("volume", f"avg(volume) OVER {tr(20)}")), "above": (lambda: ts.div("close", "ema") - 1, q("close", "ema") + " - 1"), "slope": (lambda: (F.col("above") - ts.ref("above", 5)) / 5, "(above - lag(above, 5) OVER w) / 5")})
add_columns("ts_vol_spike", {"spike": (ts.vol_spike, q(f"avg(volume) OVER {fw(-3, -1)}", f"avg(volume) OVER {fw(-60, -1)}"), 6)})
add_columns("ts_realized_vol", {"vol": (lambda: ts.realized_vol("ret", F.col("rn"), 0.1), f"CASE WHEN rn < 6 THEN 0.2 ELSE greatest(stddev_samp(ret) OVER {tr(20)} * sqrt(252.0), 0.1) END", 6)}, stage={**RN, "ret": (lambda: ts.back_return("close", 1), "close / NULLIF(lag(close) OVER w, 0) - 1")})
add_columns("ts_running_peak", {"peak": (lambda: ts.running_peak("close"), "max(close) OVER (w ROWS UNBOUNDED PRECEDING)", 6)})
add_columns("ts_drawdown", {"drawdown": (lambda: ts.drawdown("close"), "close / NULLIF(max(close) OVER (w ROWS UNBOUNDED PRECEDING), 0) - 1", 6)})
add_columns("ts_period_return", {"ret": (lambda: ts.period_return("amount", "volume"), "(amount - volume) / NULLIF(lag(amount) OVER w, 0) - 1", 6)})

add_columns("proj_vwap", {"vwap": (lambda: ts.div("amount", "volume"), "amount / NULLIF(volume, 0)", 6)})
add_columns("proj_gap", {"gap": (ext["GAP"].build, "open / NULLIF(lag(close) OVER w, 0) - 1", 6)})
add_columns("proj_drp", {"drp": (ext["DRP"].build, "(close - low) / NULLIF(high - low, 0)", 6)})
add_columns("proj_o2c", {"o2c": (ext["O2C"].build, "close / NULLIF(open, 0) - 1", 6)})
add_columns("proj_hlc", {"hlc": (ext["HLC"].build, "(high - close) / NULLIF(high - low, 0)", 6)})
add_columns("proj_roe_raw", {"roe_raw": (lambda: ts.div("pb", "pe_ttm"), "pb / NULLIF(pe_ttm, 0)", 6)})
add_columns("proj_turn", {"turn": (lambda: F.col("turnover_rate"), "turnover_rate", 6)}, views=("bars", "fund"))
add_columns("proj_volratio", {"volratio": (lambda: F.col("volume_ratio"), "volume_ratio", 6)}, views=("bars", "fund"))

MA5 = {"s": (lambda: ts.div("close", ts.mean("close", 5)), q("close", f"avg(close) OVER {tr(5)}")), "r1": (lambda: rounded(F.col("s")), rounded_sql("s"))}
add_columns("xs_rank", {"rank": (lambda: xs.rank("r1"), "rank() OVER (x ORDER BY r1 NULLS LAST)", None)}, stage=MA5)
add_columns("xs_quantile", {"tile": (lambda: xs.ntile("r1", 5), "ntile(5) OVER (x ORDER BY r1 NULLS LAST, entity)", None)}, stage=MA5)
PCT = "CASE WHEN {v} IS NOT NULL THEN (rank() OVER (x ORDER BY {v} NULLS LAST) + rank() OVER (x ORDER BY {v} NULLS LAST) + count(*) OVER (PARTITION BY trade_date, {v}) - 1) / 2.0 / count({v}) OVER x END"
BACK = {"v5": (lambda: F.round(ts.back_return("close", 5), 1), "round(close / NULLIF(lag(close, 5) OVER w, 0) - 1, 1)"), "v20": (lambda: rounded(ts.back_return("close", 20)), rounded_sql("close / NULLIF(lag(close, 20) OVER w, 0) - 1"))}
add_columns("xs_pct_rank", {v: (lambda v=v: xs.pct_rank(v), PCT.format(v=v), 6) for v in ("v5", "v20")}, stage={"v5": (lambda: rounded(ts.back_return("close", 5), 1), rounded_sql("close / NULLIF(lag(close, 5) OVER w, 0) - 1", 1)), "v20": BACK["v20"]})
add_columns("xs_label_ntile", {f"tile_{n}": (lambda n=n: xs.ntile(f"f{n}", 10) - 1, f"ntile(10) OVER (x ORDER BY f{n} NULLS LAST, entity) - 1", None) for n in (5, 20)}, stage={f"f{n}": (lambda n=n: rounded(ts.forward_return("close", n)), rounded_sql(f"lead(close, {n}) OVER w / NULLIF(close, 0) - 1")) for n in (5, 20)})
med = lambda c: f"median({c}) OVER (PARTITION BY trade_date, industry)"
add_columns("xs_industry_ratio", {"pe_ratio": (lambda: xs.industry_ratio("pe_ttm"), f"pe_ttm / ({med('pe_ttm')} + 1e-8)", 6), "pb_ratio": (lambda: xs.industry_ratio("pb"), f"pb / ({med('pb')} + 1e-8)", 6)}, views=("bars", "sec"))
add_columns("xs_industry_momentum", {f"mom_{n}": (lambda n=n: xs.median(f"b{n}", "industry"), med(f"b{n}"), 6) for n in (5, 20)}, views=("bars", "sec"), stage={f"b{n}": (lambda n=n: ts.back_return("close", n), f"close / NULLIF(lag(close, {n}) OVER w, 0) - 1") for n in (5, 20)})
add_columns("xs_industry_diff", {"pe_diff": (lambda: xs.industry_diff("pe_ttm"), f"pe_ttm - {med('pe_ttm')}", 4), "pb_diff": (lambda: xs.industry_diff("pb"), f"pb - {med('pb')}", 4)}, views=("bars", "sec"))
add_columns("agg_industry_median", {"median_pe": (lambda: xs.median("pe_ttm", "industry"), med("pe_ttm"), 6)}, views=("bars", "sec"))
add_columns("xs_percentile_cut", {"below": (lambda: F.col("s") < xs.percentile("s", 0.2), "s < quantile_cont(s, 0.2) OVER x", None)}, stage={"s": (lambda: F.col("volume"), "volume")})
add_columns("xs_confidence", {"confidence": (lambda: xs.confidence("flag_share"), "1 - flag_share / greatest(max(flag_share) OVER x, 1e-8)", 6)})
add_columns("xs_normalize_weights", {"weight": (lambda: xs.normalize("volume"), "volume / NULLIF(sum(volume) OVER x, 0)", 6)})

add_columns("fn_nullif", {"v": (lambda: F.nullif(F.col("flag_share"), F.lit(0.0)), "nullif(flag_share, 0)", 6)})
add_columns("fn_coalesce", {"v": (lambda: F.coalesce(ts.ref("close", 1), F.lit(0.0)), "coalesce(lag(close) OVER w, 0.0)", 6)})
add_columns("fn_cast", {"v": (lambda: F.floor("volume").cast("int"), "CAST(floor(volume) AS INTEGER)", None), "d": (lambda: F.col("trade_date").cast("string"), "CAST(trade_date AS VARCHAR)", None)})
add_columns("fn_case", {"v": (lambda: F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1).otherwise(0), "CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END", None)})
add_columns("fn_arith", {"v": (lambda: ts.div((F.col("high") + F.col("low")) * 2 - F.col("open"), "close"), "((high + low) * 2 - open) / NULLIF(close, 0)", 6)})
add_columns("fn_pow", {"v": (lambda: F.pow(F.col("flag_share"), F.lit(2.0)), "pow(flag_share, 2.0)", 6)})
add_columns("fn_log", {"v": (lambda: F.ln("amount"), "ln(amount)", 6)})
add_columns("fn_log1p", {"v": (lambda: F.log1p("volume"), "ln(1 + volume)", 6)})
add_columns("fn_abs", {"v": (lambda: F.abs(F.col("close") - F.col("open")), "abs(close - open)", 6)})
add_columns("fn_round", {"v": (lambda: rounded(F.col("vwap"), 2), rounded_sql("vwap", 2), None)})
# a price at a whole number would go to either side of it by the order of its sum
add_columns("fn_floor", {"v": (lambda: F.floor(rounded(F.col("vwap"))).cast("long"), f"CAST(floor({rounded_sql('vwap')}) AS BIGINT)", None)})
add_columns("fn_sqrt", {"v": (lambda: F.sqrt("volume"), "sqrt(volume)", 6)})
add_columns("fn_clip", {"v": (lambda: scalar.clip(F.col("close") - F.col("open"), -5.0, 5.0), "greatest(least(close - open, 5.0), -5.0)", 6)})
add_columns("fn_greatest_nullskip", {"v": (lambda: F.greatest(F.col("close"), ts.ref("close", 1), ts.ref("close", 9)), "greatest(close, lag(close) OVER w, lag(close, 9) OVER w)", 6)})
add_columns("fn_date_format", {"d": (lambda: scalar.format_date("trade_date"), "strftime(trade_date, '%Y%m%d')", None)})
add_columns("fn_date_parse", {"d": (lambda: scalar.parse_date("t"), "CAST(strptime(t, '%Y%m%d') AS DATE)", None)}, stage={"t": (lambda: scalar.format_date("trade_date"), "strftime(trade_date, '%Y%m%d')")})
add_columns("fn_date_path", {"d": (lambda: scalar.date_path("trade_date"), "strftime(trade_date, '%Y_%m_%d') || '.parquet'", None)})
add_columns("fn_add_months", {"d": (lambda: F.add_months("trade_date", 1), "CAST(trade_date + INTERVAL 1 MONTH AS DATE)", None)})
add_columns("fn_month_key", {"d": (lambda: scalar.month_key("trade_date"), "strftime(trade_date, '%Y%m')", None)})
turn = "dayofyear(trade_date) / {p} * 2 * pi()"
add_columns("fn_cyclical_date", {n: (lambda k=k: scalar.cyclical_date("trade_date")[k], e, 5) for k, (n, e) in enumerate([("year_sin", f"sin({turn.format(p='365.0')})"), ("year_cos", f"cos({turn.format(p='365.0')})"), ("season_sin", f"sin({turn.format(p='90.0')})"), ("season_cos", f"cos({turn.format(p='90.0')})"), ("quarter_part", "quarter(trade_date) / 4.0")])})
add_columns("fn_sr_bin", {"bin": (lambda: scalar.sr_bin(ts.lead("high", 5), "close", 0.2, 41), """CASE WHEN lead(high, 5) OVER w IS NULL THEN 40 ELSE greatest(least(CAST(trunc((((lead(high, 5) OVER w - close) / close) / 0.2 + 1) * 40 / 2) AS INTEGER), 39), 0) END""", None)})
add_columns("fn_sr_weight", {"weight": (lambda: scalar.sr_weight(F.when(F.col("volume") > 30, F.col("volume"))), "coalesce(1 / (1 + (CASE WHEN volume > 30 THEN volume END) / 5.0), 1.0)", 6)})
add_columns("fn_trend_signal", {"signal": (lambda: scalar.trend_signal(F.col("flag_share") - 0.5), "CASE WHEN flag_share - 0.5 > 0.3 THEN 'long' WHEN flag_share - 0.5 < -0.3 THEN 'short' ELSE 'neutral' END", None)})


def _topk(spark, sf_dir):
    return xs.top_k(source.predictions(source.bars(spark, sf_dir)).withColumn("score", rounded(F.col("pred"))), "score", 5).select("entity", "trade_date", "nth")


add("xs_topk", _topk, with_views(f"SELECT entity, trade_date, nth FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY {rounded_sql('pred')} DESC NULLS LAST, entity) AS nth FROM pred) WHERE nth <= 5", "pred"))


def _panel(spark, sf_dir):
    return source.with_fundamentals(source.bars(spark, sf_dir), all_rows=True)


def _long(df, names):
    """(entity, trade_date, factor, value) with missing values left out, values at six significant digits."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")
    return df.select("entity", "trade_date", pairs).select("entity", "trade_date", "x.*").where("value is not null")


def _feature_query(make, names=None, steady=()):
    """Yearly means of a catalog's factors; the columns ``steady`` are rounded first."""

    def query(spark, sf_dir):
        cat, panel = make(), _panel(spark, sf_dir)
        out = cat.compute(panel.withColumns({c: rounded(F.col(c)) for c in steady}) if steady else panel, source.tasks(spark, sf_dir))
        return _summary(_long(out, names or cat.names))

    return query


def _summary(long):
    """Rows, and the mean value, of each factor and year."""
    scale = F.col("value")
    return long.groupBy("factor", F.year("trade_date").alias("year")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(scale), 2).alias("mean_value"))


def factor_sql(name: str) -> str:
    """SQL of a price/volume factor, from its name."""
    kind, _, rest = name.partition("_")
    if kind in ("RANK", "QUANTILE"):
        order = f"OVER (PARTITION BY trade_date ORDER BY {rest} NULLS LAST" + (")" if kind == "RANK" else ", entity)")
        return ("rank() " if kind == "RANK" else "ntile(5) ") + order
    x, n = rest.rsplit("_", 1)
    n = int(n)
    return {
        "REF": lambda: q(f"lag({x}, {n}) OVER w", x) + " - 1", "MEAN": lambda: q(f"avg({x}) OVER {tr(n)}", x), "STD": lambda: f"stddev_samp({x}) OVER {tr(n)}",
        "MAX": lambda: f"max({x}) OVER {tr(n)}", "MIN": lambda: f"min({x}) OVER {tr(n)}", "CORR": lambda: corr_sql("close", x, n),
        "DELTA": lambda: f"{x} - lag({x}, {n}) OVER w", "SUM": lambda: f"sum({x}) OVER {tr(n)}",
    }[kind]()


EXT_SQL = {
    "CHP30": q(f"close - min(low) OVER {tr(30)}", f"max(high) OVER {tr(30)} - min(low) OVER {tr(30)}"), "SKEWP10": channel(10), "SKEWP20": channel(20),
    "GAP": "open / NULLIF(lag(close) OVER w, 0) - 1", "DRP": "(close - low) / NULLIF(high - low, 0)", "O2C": "close / NULLIF(open, 0) - 1", "HLC": "(high - close) / NULLIF(high - low, 0)",
    "EMA12C": ema(12), "EMA26C": ema(26), "MACD": f"{ema(12)} - {ema(26)}", "RSI14": f"100.0 - 100.0 / (1.0 + {gain} / NULLIF({loss}, 0.0))",
    "SLOPE5": f"CASE WHEN rn > 1 THEN regr_slope(close, CAST(rn AS DOUBLE)) OVER {tr(5)} END", "SLOPE20": f"CASE WHEN rn > 1 THEN regr_slope(close, CAST(rn AS DOUBLE)) OVER {tr(20)} END",
}
mm = lambda c: q(f"{c} - min({c}) OVER {tr(750)}", f"max({c}) OVER {tr(750)} - min({c}) OVER {tr(750)}")
FUND_SQL = {"PE_TTM_MINMAX_750": mm("pe_ttm"), "PB_MINMAX_750": mm("pb"), "ROE_RAW": "roe0", "ROE": mm("roe0"), "MV": mm("total_mv"), "TURN": "turnover_rate", "TURN_RANK": "rank() OVER (PARTITION BY trade_date ORDER BY turnover_rate NULLS LAST)", "VOLRATIO": "volume_ratio"}


def feature_sql(staged: dict[str, str], ranked: dict[str, str], steady: tuple[str, ...] = ()) -> str:
    names = [*staged, *ranked]
    replaced = f" REPLACE ({', '.join(f'{rounded_sql(c)} AS {c}' for c in steady)})" if steady else ""
    pairs = ", ".join(f"{{'factor': '{n}', 'value': CAST({n} AS DOUBLE)}}" for n in names)
    return with_views(
        f"SELECT factor, year, count(*) AS n, {rounded_sql('avg(value)', 2)} AS mean_value FROM (SELECT trade_date, year(trade_date) AS year, unnest([{pairs}], recursive := true) FROM f3) WHERE value IS NOT NULL GROUP BY factor, year",
        "bars", "fund",
        f0=f"SELECT *{replaced} FROM (SELECT bars.* EXCLUDE (pe_ttm, pb, circ_mv), fund.* EXCLUDE (entity, trade_date) FROM bars LEFT JOIN fund USING (entity, trade_date))",
        f1="SELECT *, row_number() OVER w AS rn, close - lag(close) OVER w AS diff, pb / NULLIF(pe_ttm, 0) AS roe0, least(row_number() OVER w - 1, 11) AS p12, least(row_number() OVER w - 1, 25) AS p26 FROM f0 WINDOW w AS (PARTITION BY entity ORDER BY trade_date)",
        f2="SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in staged.items()) + " FROM f1 WINDOW w AS (PARTITION BY entity ORDER BY trade_date)",
        f3="SELECT *" + "".join(f", {e} AS {n}" for n, e in ranked.items()) + " FROM f2",
    )


PV = {n: factor_sql(n) for n in catalog.price_volume().names}
PV_STAGED, PV_RANKED = ({n: e for n, e in PV.items() if (n.split("_")[0] in ("RANK", "QUANTILE")) == r} for r in (False, True))
FUND_STAGED = {n: e for n, e in FUND_SQL.items() if n != "TURN_RANK"}
# ratios and amounts that differ in the last bit of a sum would make a range of nothing a range
STEADY = ("pe_ttm", "pb", "total_mv")
add("feat_fundamental", _feature_query(catalog.fundamental, steady=STEADY), feature_sql(FUND_STAGED, {"TURN_RANK": FUND_SQL["TURN_RANK"]}, STEADY))


# the same factors as rows, with all ranks
COARSE = {"STD_amount": 3, "EMA12C": 4, "EMA26C": 4, "MACD": 4, "RSI14": 4, "SLOPE5": 5, "SLOPE20": 5}


def _digits(name):
    """Digits at which both engines agree: amounts and recursive sums carry more noise."""
    return next((d for k, d in COARSE.items() if name.startswith(k)), 6)


def _row_query(make):
    def query(spark, sf_dir):
        cat = make()
        return cat.compute(_panel(spark, sf_dir), source.tasks(spark, sf_dir), digits=digits_of(cat.names))

    return query


def digits_of(names):
    return {n: _digits(n) for n in names}


def row_sql(staged: dict[str, str], ranked: dict[str, str], names: list[str]) -> str:
    """One row for each bar with a column for each name; means, deviations and correlations are rounded before they are ranked."""
    noisy = sorted({n.partition("_")[2] for n in ranked if n in PV_RANKED and not n.endswith("REF_close_1")})
    steady = {n: re.sub(r"ORDER BY (\w+)", lambda m: f"ORDER BY r_{m[1]}" if m[1] in noisy else m[0], e) for n, e in ranked.items()}
    return with_views(
        "SELECT entity, trade_date, " + ", ".join(f"{rounded_sql(f'CAST({n} AS DOUBLE)', _digits(n))} AS {n}" for n in names) + " FROM f4",
        "bars", "fund",
        f0="SELECT bars.* EXCLUDE (pe_ttm, pb, circ_mv), fund.* EXCLUDE (entity, trade_date) FROM bars LEFT JOIN fund USING (entity, trade_date)",
        f1="SELECT *, row_number() OVER w AS rn, close - lag(close) OVER w AS diff, pb / NULLIF(pe_ttm, 0) AS roe0, least(row_number() OVER w - 1, 11) AS p12, least(row_number() OVER w - 1, 25) AS p26 FROM f0 WINDOW w AS (PARTITION BY entity ORDER BY trade_date)",
        f2="SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in staged.items()) + " FROM f1 WINDOW w AS (PARTITION BY entity ORDER BY trade_date)",
        f3="SELECT *" + "".join(f", {rounded_sql(n, catalog.RANK_DIGITS)} AS r_{n}" for n in noisy) + " FROM f2",
        f4="SELECT *" + "".join(f", {e} AS {n}" for n, e in steady.items()) + " FROM f3",
    )


add("feat_price_volume", _row_query(catalog.price_volume), row_sql(PV_STAGED, PV_RANKED, catalog.price_volume().names))
add("feat_combined", _row_query(catalog.combined), row_sql(PV_STAGED | EXT_SQL | FUND_STAGED, PV_RANKED | {"TURN_RANK": FUND_SQL["TURN_RANK"]}, catalog.combined().names))
add("feat_extended", _row_query(catalog.extended), row_sql(EXT_SQL, {}, catalog.extended().names))
