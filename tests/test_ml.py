"""Model jobs take features as one stored vector."""

import random
from datetime import date, timedelta

from pyspark.ml.functions import array_to_vector

from panelkit.functions import xs
from panelkit.operators import ml


def test_ranks_as_one_vector(spark):
    rng = random.Random(4)
    value = lambda: rng.choice([None, float("nan"), *range(6)])
    rows = [(e, date(2020, 1, 6) + timedelta(days=d), *[None if (v := value()) is None else float(v) for _ in "ab"], rng.random()) for e in range(25) for d in range(8)]
    df = spark.createDataFrame(rows, "entity long, trade_date date, a double, b double, y double")
    wide = xs.pct_rank_long(df, ["a", "b"], ("y",))
    one = xs.pct_rank_long(df, ["a", "b"], ("y",), into=ml.VECTOR)
    assert one.columns == ["entity", "trade_date", "y", ml.VECTOR]
    key = lambda r: (r["entity"], r["trade_date"])
    assert [[r["a"] or 0.0, r["b"] or 0.0] for r in sorted(wide.collect(), key=key)] == [r[ml.VECTOR] for r in sorted(one.collect(), key=key)]
    stored = one.withColumn(ml.VECTOR, array_to_vector(ml.VECTOR)).orderBy("entity", "trade_date").coalesce(1)
    wide = wide.orderBy("entity", "trade_date").coalesce(1)
    models = [ml.fit_regression(d, ["a", "b"], "y", rounds=3) for d in (wide, stored)]
    assert ml.importance(models[0], ["a", "b"]) == ml.importance(models[1], ["a", "b"])
    scored = [ml.score_panel(d, ["a", "b"], [m]) for d, m in zip((wide, stored), models)]
    assert ml.VECTOR not in scored[1].columns
    assert [r["pred_y"] for r in sorted(scored[0].collect(), key=key)] == [r["pred_y"] for r in sorted(scored[1].collect(), key=key)]
