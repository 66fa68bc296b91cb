"""Registration of queries with their SQL, and the views both sides start from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.rolling import select_rolling
from panelkit.sources import bars as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINES = """SELECT l_suppkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date,
  l_extendedprice / l_quantity AS p, l_quantity AS q, l_extendedprice AS a, l_extendedprice * l_discount AS disc,
  l_extendedprice * l_tax AS tax, l_returnflag, l_linestatus,
  row_number() OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rf,
  row_number() OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rl
  FROM lineitem"""
VIEWS = {
    "li": LINES,
    "bars": """SELECT entity, trade_date, max(CASE WHEN rf = 1 THEN p END) AS open, max(p) AS high, min(p) AS low,
  max(CASE WHEN rl = 1 THEN p END) AS close, sum(q) AS volume, sum(a) AS amount, sum(a) / sum(q) AS vwap,
  sum(a) / NULLIF(sum(disc), 0) AS pe_ttm, sum(a) / NULLIF(sum(tax), 0) AS pb,
  sum(CASE WHEN l_linestatus = 'O' THEN a ELSE 0 END) AS circ_mv,
  sum(CASE WHEN l_returnflag = 'R' THEN q ELSE 0 END) / sum(q) AS flag_share FROM li GROUP BY entity, trade_date""",
    "fund": """SELECT entity, trade_date, pe_ttm, pb, circ_mv, amount AS total_mv,
  100 * volume / sum(volume) OVER (PARTITION BY entity) AS turnover_rate,
  volume / NULLIF(avg(volume) OVER (PARTITION BY entity ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS volume_ratio FROM bars""",
    "sec": """SELECT s_suppkey AS entity, s_name AS name, n_name AS industry, r_name AS market FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "flags": "SELECT entity, trade_date FROM bars WHERE flag_share > 0.6",
    "cal": "SELECT DISTINCT trade_date, 1 AS is_open FROM bars",
    "nth": "SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS nth FROM cal",
    "pred": """SELECT entity, trade_date, close,
  -(close / NULLIF(avg(close) OVER (PARTITION BY entity ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) - 1) AS pred,
  lead(close, 5) OVER (PARTITION BY entity ORDER BY trade_date) / NULLIF(close, 0) - 1 AS actual FROM bars""",
}
#: Views each view needs.
NEEDS = {"bars": ["li"], "fund": ["bars"], "flags": ["bars"], "cal": ["bars"], "nth": ["cal"], "pred": ["bars"]}


def with_views(body: str, *views: str, **more: str) -> str:
    """``body`` after the CTEs of the named views, of what they need, and of ``more``."""
    order: list[str] = []

    def need(v: str) -> None:
        for x in NEEDS.get(v, []):
            need(x)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    ctes = [f"{v} AS ({VIEWS[v]})" for v in order] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounding that both engines compute alike; halves lie off the border, so noise can't part them."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.50001) / scale


def rounded_sql(e: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"floor(({e}) * {scale} + 0.50001) / {scale}"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered already")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


@dataclass(frozen=True)
class Stored:
    """A staged column that takes more than a Column: ``add(panel, name)`` gives the panel with it."""

    add: Callable[[DataFrame, str], DataFrame]


def add_columns(name: str, columns: dict[str, tuple], views: tuple[str, ...] = ("bars",), stage: dict[str, tuple] | None = None, file_order: bool = False) -> None:
    """A query of Columns over bars: {column: (Column maker, SQL, digits or None)}.

    ``stage`` holds columns that are stored first, {column: (Column maker, SQL)}.  A maker whose
    parameter is ``r`` gets a Rolling.  ``file_order`` is that of ``bars``.  In SQL
    ``w`` is the entity's window in date order, ``x`` the date's.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = source.bars(spark, sf_dir, file_order)
        if "fund" in views:
            panel = source.with_fundamentals(panel)
        if "sec" in views:
            panel = panel.join(source.securities(spark, sf_dir), "entity")
        for c, (make, _) in (stage or {}).items():
            panel = select_rolling(panel, [*panel.columns], {c: make}) if not isinstance(make, Stored) else make.add(panel, c)
        out = select_rolling(panel, ["entity", "trade_date"], {c: make for c, (make, _, _) in columns.items()})
        return out.select("entity", "trade_date", *[(F.col(c) if digits is None else rounded(F.col(c), digits)).alias(c) for c, (_, _, digits) in columns.items()])

    base = "bars"
    more: dict[str, str] = {}
    if "fund" in views:
        more["b_fund"] = "SELECT bars.* EXCLUDE (pe_ttm, pb, circ_mv), fund.* EXCLUDE (entity, trade_date) FROM bars JOIN fund USING (entity, trade_date)"
        base = "b_fund"
    if "sec" in views:
        more["b_sec"] = f"SELECT * FROM {base} JOIN sec USING (entity)"
        base = "b_sec"
    for k, (c, (_, e)) in enumerate((stage or {}).items()):
        more[f"st{k}"] = f"SELECT *, {e} AS {c} FROM {base} WINDOW w AS (PARTITION BY entity ORDER BY trade_date)"
        base = f"st{k}"
    chosen = ", ".join(f"{e if digits is None else rounded_sql(e, digits)} AS {c}" for c, (_, e, digits) in columns.items())
    body = f"SELECT entity, trade_date, {chosen} FROM {base} WINDOW w AS (PARTITION BY entity ORDER BY trade_date), x AS (PARTITION BY trade_date)"
    add(name, query, with_views(body, *views, **more))
