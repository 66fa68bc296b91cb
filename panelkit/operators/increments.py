"""Factors of the dates that the lineage registry doesn't have yet."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.operators.catalog import FactorCatalog
from panelkit.sources import io
from panelkit.sources.atomic import Change, Files, recover

LOG = "api_name string, trade_date date, row_count long, pull_time timestamp"


def registry(spark: SparkSession, root: str, table: str = "registry") -> DataFrame:
    """The log of what was written, empty before the first run."""
    recover(spark, root)
    found = Files(spark, root).exists(root, table)
    return spark.read.schema(LOG).parquet(f"{root}/{table}") if found else spark.createDataFrame([], LOG)


def margin_start(calendar: DataFrame, first: date, lookback: int, slack: float = 1.5):
    """The session so far before ``first`` that an entity that trades in two of three sessions has ``lookback`` rows between."""
    sessions = calendar.where("is_open = 1").select("trade_date").distinct().where(F.col("trade_date") < F.lit(first))
    back = sessions.orderBy(F.desc("trade_date")).limit(int(lookback * slack)).agg(F.min("trade_date")).first()[0]
    return back or first


def update(panel: DataFrame, calendar: DataFrame, catalog: FactorCatalog, root: str, start: date, today: date, api: str = "features", digits: dict[str, int] | None = None, tasks: int | None = None) -> int:
    """Computes and stores the factors of pending dates; returns how many dates were written.

    Pending are the open sessions from ``start`` to ``today`` without a registry row.  The panel
    is read from as many sessions before the first of them as the catalog's longest lookback
    asks for.  The factors' dates and their registry rows are one change: both show or neither.
    """
    spark = panel.sparkSession
    done = io.registry_current(registry(spark, root)).where(F.col("api_name") == api).select("trade_date")
    pending = io.store(io.pending_dates(calendar, done, start, today), "pending")
    first, n = pending.agg(F.min("trade_date"), F.count(F.lit(1))).first()
    if not n:
        return 0
    since = margin_start(calendar, first, catalog.lookback)
    rows = panel.where(F.col("trade_date").between(F.lit(since), F.lit(today)))
    rows = rows.join(F.broadcast(pending.withColumn("__pending", F.lit(True))), "trade_date", "left")
    factors = catalog.compute_by_date(rows, tasks, "__pending", digits)
    change = Change(spark, root)
    change.replace(factors, "features", dealt=True)
    # counted from what is staged, so nothing is computed again; sessions without rows are done too
    staged = spark.read.parquet(f"{root}/{change.tables[0]['staged']}").groupBy(F.col("trade_date").cast("date").alias("trade_date")).agg(F.count(F.lit(1)).alias("row_count"))
    rows = pending.join(staged, "trade_date", "left").select(F.lit(api).alias("api_name"), "trade_date", F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"), F.current_timestamp().alias("pull_time"))
    change.append(rows, "registry")
    change.commit()
    return n
