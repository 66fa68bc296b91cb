"""Sums of a week's lines can be added in the order of the file, so results that hang on the last bit agree with SQL."""

import glob
import random
from datetime import datetime, timedelta

import oracle
import pyarrow.parquet as pq
from panelkit.plans import registry
from panelkit.sources import bars as source

COLUMNS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


def lines(seed):
    """Weeks of three lines with one discount, so that ratios of a few weeks differ by the order of adding alone."""
    rng, rows = random.Random(seed), []
    for entity in range(60):
        for week in range(4):
            for _ in range(3):
                day = datetime(2000, 1, 3) + timedelta(days=7 * week + rng.randrange(7))
                rows.append((len(rows), rng.randrange(99), entity, 1, 1.0 + rng.randrange(50), round(rng.uniform(900, 99000), 2), 0.07, 0.03, "R", "O", day))
    rng.shuffle(rows)
    return rows


def test_sums_are_added_in_the_order_of_the_file(spark, tmp_path):
    spark.createDataFrame(lines(1), COLUMNS).repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    weeks = {}
    for path in sorted(glob.glob(f"{tmp_path}/lineitem.parquet/*.parquet")):
        for r in pq.read_table(path).to_pylist():
            day = r["l_shipdate"]
            weeks.setdefault((r["l_suppkey"], (day - timedelta(days=day.weekday())).date()), []).append(r)
    got = source.bars(spark, str(tmp_path), file_order=True).collect()
    assert len(got) == len(weeks)
    for bar in got:
        amount = discount = 0.0
        for r in weeks[bar["entity"], bar["trade_date"]]:
            amount, discount = amount + r["l_extendedprice"], discount + r["l_extendedprice"] * r["l_discount"]
        assert (bar["amount"], bar["pe_ttm"]) == (amount, amount / discount)


def test_ranges_of_the_last_bit_equal_sql(spark, tmp_path):
    """whether such a range is 0, and its quotient NULL, hung on the order of adding."""
    spark.createDataFrame(lines(2), COLUMNS).repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = registry.queries()["ts_minmax_750"](spark, str(tmp_path))
    con = oracle.connection(str(tmp_path))
    con.execute("SET threads = 1")
    assert oracle.differences(df, registry.oracle_sql()["ts_minmax_750"], con) == ""
