"""Scans, sinks and the lineage registry."""

from __future__ import annotations

import re
import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.sources.atomic import Change, Files, recover

BAR_SCHEMA = "ts_code string, trade_date string, open double, high double, low double, close double, vol double, amount double"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder where driver and executors both write: below ``spark.checkpoint.dir``, or the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_bars(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """A Parquet tree of bars by trade_date=YYYYMMDD: ``vol`` becomes ``volume``, vwap is derived, dates become dates.

    A range of dates is compared with the folders' names, so other folders aren't read.
    """
    d = spark.read.schema(BAR_SCHEMA).parquet(path)
    if first is not None:
        d = d.where(F.col("trade_date") >= f"{first:%Y%m%d}")
    if last is not None:
        d = d.where(F.col("trade_date") <= f"{last:%Y%m%d}")
    return d.select(F.col("ts_code").alias("entity"), F.to_date(F.col("trade_date").cast("string"), "yyyyMMdd").alias("trade_date"), "open", "high", "low", "close", F.col("vol").alias("volume"), "amount", F.try_divide("amount", "vol").alias("vwap"))


def margin_days(lookback: int) -> int:
    """Calendar days that hold ``lookback`` sessions."""
    return int((lookback + 5) * 365 / 252)


def prune(panel: DataFrame, first, last, lookback: int) -> DataFrame:
    """Rows from ``lookback`` sessions before ``first`` to ``last``; a filter that reaches the scan."""
    return panel.where(F.col("trade_date").between(F.date_sub(F.lit(first), margin_days(lookback)), F.lit(last)))


def with_fundamentals(bars: DataFrame, fundamentals: DataFrame | None, columns: list[str]) -> DataFrame:
    """Left join on the keys; without the data set, typed null columns."""
    if fundamentals is None:
        return bars.select("*", *[F.lit(None).cast("double").alias(c) for c in columns])
    return bars.join(fundamentals.select("entity", "trade_date", *columns), ["entity", "trade_date"], "left")


def scan_dated(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """A tree partitioned by trade_date, drifting schemas merged by name; dates prune partitions."""
    d = spark.read.option("mergeSchema", "true").parquet(path)
    d = d.withColumn("trade_date", F.col("trade_date").cast("date"))
    return d.where(F.col("trade_date").between(first, last)) if first is not None else d


NAMED = re.compile(r"(\d{4})_(\d{2})_(\d{2})\.parquet")


def named_files(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> dict[date, str]:
    """Files YYYY_MM_DD.parquet of a folder by date, in a range of dates; no file is opened."""
    found = {}
    for name in Files(spark, path).names(path):
        m = NAMED.fullmatch(name)
        day = date(*map(int, m.groups())) if m else None
        if day and (first is None or day >= first) and (last is None or day <= last):
            found[day] = f"{path}/{name}"
    return found


def scan_named_files(spark: SparkSession, path: str, first: date | None = None, last: date | None = None, schema: str | None = None) -> DataFrame:
    """Files named YYYY_MM_DD.parquet; the date comes from the name, and files outside the range aren't opened.

    Drifting schemas are merged by name.  ``schema`` is what an empty range gives.
    """
    files = named_files(spark, path, first, last)
    if not files:
        return spark.createDataFrame([], f"{schema + ', ' if schema else ''}trade_date date")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}_\d{2}_\d{2})\.parquet", 1)
    d = spark.read.option("mergeSchema", "true").parquet(*files.values())
    return d.drop("trade_date").withColumn("trade_date", F.to_date(name, "yyyy_MM_dd"))


def write_named_files(df: DataFrame, path: str) -> None:
    """One file YYYY_MM_DD.parquet for each date; a date that is written again replaces its file."""
    spark, staged = df.sparkSession, f"{path}/_staged-{uuid.uuid4().hex}"
    named = df.withColumn("__name", F.date_format("trade_date", "yyyy_MM_dd"))
    named.repartition("__name").sortWithinPartitions("__name").write.partitionBy("__name").parquet(staged)
    files = Files(spark, path)
    for folder in files.names(staged):
        parts = [n for n in files.names(staged, folder) if n.startswith("part-")] if folder.startswith("__name=") else []
        if len(parts) > 1:
            raise ValueError(f"{folder} has more than one file; lift spark.sql.files.maxRecordsPerFile")
        for part in parts:
            name = folder.removeprefix("__name=") + ".parquet"
            files.delete(path, name)
            files.move(files.path(staged, folder, part), files.path(path, name))
    files.delete(staged)


def recent_dates(panel: DataFrame, at, n: int) -> DataFrame:
    """Rows of the last n dates up to ``at``, for entities that have all of them."""
    dates = panel.where(F.col("trade_date") <= F.lit(at)).select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(n)
    rows = panel.join(F.broadcast(dates), "trade_date", "left_semi")
    full = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("entity")
    return rows.join(full, "entity", "left_semi")


def latest_partition(panel: DataFrame) -> DataFrame:
    """Rows of the latest date."""
    last = panel.agg(F.max("trade_date").alias("trade_date"))
    return panel.join(F.broadcast(last), "trade_date", "left_semi")


def write_partition(panel: DataFrame, path: str) -> None:
    """One folder for each date; dates that are written again are replaced, others stay."""
    (panel.repartition("trade_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(path))


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def merge_columns(stored: DataFrame, new: DataFrame, keys: list[str], how: str = "full") -> DataFrame:
    """Columns of ``new`` joined to ``stored``; where both have one, new values win."""
    both = [c for c in new.columns if c in stored.columns and c not in keys]
    renamed = new.withColumnsRenamed({c: f"__new_{c}" for c in both})
    out = stored.join(renamed, keys, how)
    merged = [F.coalesce(f"__new_{c}", c).alias(c) if c in both else F.col(c) for c in stored.columns if c not in keys]
    return out.select(*keys, *merged, *[c for c in new.columns if c not in stored.columns])


def merge_into(new: DataFrame, root: str, table: str, keys: list[str], how: str = "full") -> None:
    """:func:`merge_columns` into the stored table ``root/table`` by date; only dates of ``new`` are written again.

    ``new`` may be read from the table itself.  The merged dates are staged and swapped as one
    change, so a run that dies leaves the old state or one that the next run finishes, and a
    second run gives the same table.  Columns that are new to the table are null on the other
    dates, if it is read with its schemas merged.
    """
    spark = new.sparkSession
    change = Change(spark, root)
    if Files(spark, root).exists(root, table):
        stored = scan_dated(spark, f"{root}/{table}")
        dates = new.select("trade_date").distinct()
        new = merge_columns(stored.join(F.broadcast(dates), "trade_date", "left_semi"), new, keys, how)
    change.replace(new, table)
    change.commit()


def scan_stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table below ``root`` by date, after changes that were left half done are finished."""
    recover(spark, root)
    return scan_dated(spark, f"{root}/{table}")


def export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def dedupe_last(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def registry_current(log: DataFrame) -> DataFrame:
    """Latest row of each (api_name, trade_date), null dates included; tombstones (row_count null) go."""
    return dedupe_last(log, ["api_name", "trade_date"], [F.desc("pull_time"), F.desc_nulls_last("row_count")]).where("row_count is not null")


def registry_last_date(log: DataFrame) -> DataFrame:
    return registry_current(log).groupBy("api_name").agg(F.max("trade_date").alias("last_date"))


def registry_delete_since(log: DataFrame, api: str, since, at) -> DataFrame:
    """``log`` with tombstones for the rows of one source from a date on."""
    gone = registry_current(log).where((F.col("api_name") == api) & (F.col("trade_date") >= F.lit(since)))
    return log.unionByName(gone.withColumn("row_count", F.lit(None).cast("long")).withColumn("pull_time", F.lit(at).cast("timestamp")))


def registry_summary(log: DataFrame) -> DataFrame:
    return registry_current(log).groupBy("api_name").agg(F.count(F.lit(1)).alias("n"), F.max("trade_date").alias("last_date"))


def pending_dates(calendar: DataFrame, done: DataFrame, start, today, lookback: int = 0) -> DataFrame:
    """Open dates from ``start`` to ``today`` that aren't done, without the calendar's first ``lookback``."""
    open_days = calendar.where("is_open = 1").select("trade_date").distinct()
    nth = open_days.withColumn("nth", F.row_number().over(Window.orderBy("trade_date")))
    return nth.where((F.col("nth") > lookback) & F.col("trade_date").between(F.lit(start), F.lit(today))).select("trade_date").join(done.select("trade_date"), "trade_date", "left_anti")


def default_start(today: date, years: int) -> date:
    return today - timedelta(days=365 * years)
