"""Values that only the last bit of a sum puts on one side of a bound."""

import random
from datetime import datetime, timedelta

from panelkit.plans import registry
from panelkit.sources import bars as source

SCHEMA = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def table(spark, path, weeks):
    """Weeks of (tax, amounts) of one entity, 40 weeks apart."""
    rows = [(w, 1, 7, k, 1.0, a, 0.1, tax, "N", "O", datetime(1995, 1, 3) + timedelta(weeks=40 * w)) for w, (tax, amounts) in enumerate(weeks) for k, a in enumerate(amounts)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def pair(wanted):
    """Two amounts; their sum doesn't depend on their order."""
    rng = random.Random(5)
    while True:
        a, b = rng.randrange(90_000, 9_000_000) / 100, rng.randrange(90_000, 9_000_000) / 100
        if wanted(a, b):
            return [a, b]


below = pair(lambda a, b: (a + b) / (a * 0.02 + b * 0.02) < 50)
at = pair(lambda a, b: (a + b) / (a * 0.02 + b * 0.02) == 50)


def test_ratio_on_a_bound(spark, tmp_path):
    path = table(spark, tmp_path, [(0.03, [1000.0]), (0.03, [1000.0]), (0.02, below), (0.03, [2000.0])])
    got = registry.queries()["universe_absolute_quality"](spark, path).collect()
    assert [r["trade_date"].isoformat() for r in got] == ["1997-04-21"]


def test_price_at_a_whole_number(spark, tmp_path):
    # three amounts whose sum in this order is 9, less the last bit
    rng = random.Random(5)
    three = next(x for x in ([rng.randrange(1, 500) / 100 for _ in range(3)] for _ in range(10**7)) if 0 < 9 - (x[0] + x[1] + x[2]) < 1e-9)
    path = table(spark, tmp_path, [(0.03, three)])
    assert [r["v"] for r in registry.queries()["fn_floor"](spark, path).collect()] == [3]


def test_range_of_nothing(spark, tmp_path):
    path = table(spark, tmp_path, [(0.02, at), (0.02, below), (0.02, at)])
    got = registry.queries()["feat_fundamental"](spark, path).collect()
    assert not [r for r in got if r["factor"] == "PB_MINMAX_750"]


def test_tasks_grow_with_the_lines(spark, small, monkeypatch):
    monkeypatch.setattr(source, "LINES_PER_TASK", 500)
    n = source.table(spark, small, "lineitem").count() // 500
    assert n > 4 and "hashpartitioning(entity#" in (plan := registry.queries()["panel_levels"](spark, small)._jdf.queryExecution().executedPlan().toString())
    assert f", {n}), REPARTITION_BY_NUM" in plan
