"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions import ts, xs
from panelkit.operators import universe
from panelkit.plans import base, composite_queries, relational_queries, window_queries  # noqa: F401
from panelkit.sources import bars as source


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best entities of each session by close over its five-session mean, in the universe."""
    panel = source.bars(spark, sf_dir)
    scored = panel.select("entity", "trade_date", "flag_share", ts.div("close", ts.mean("close", 5)).alias("score"))
    chosen = universe.in_market(scored.where(F.col("flag_share") <= source.FLAG_SHARE), source.securities(spark, sf_dir), without=["AFRICA"])
    return xs.top_k(chosen.withColumn("score", base.rounded(F.col("score"))), "score", 10).select("entity", "trade_date", "score", "nth")


FLAGSHIP_SQL = base.with_views(
    f"""SELECT entity, trade_date, score, nth FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC NULLS LAST, entity) AS nth FROM s
 WHERE flag_share <= 0.6 AND entity IN (SELECT entity FROM sec WHERE market <> 'AFRICA')) WHERE nth <= 10""",
    "bars", "sec", s=f"SELECT entity, trade_date, flag_share, {base.rounded_sql('close / NULLIF(avg(close) OVER (PARTITION BY entity ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0)')} AS score FROM bars")
base.add("flagship", flagship, FLAGSHIP_SQL)


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.ORACLES)
