"""Headline queries, timed; prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from panelkit import session
from panelkit.plans import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["flagship", "feat_price_volume", "feat_combined", "xs_pct_rank", "ds_tabular", "seq_rank_cache", "panel_levels", "seq_normalize", "universe_quality", "agg_rank_ic", "reb_membership"]


def main() -> None:
    spark = session.build("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    queries["flagship"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # starts the JVM's code
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR)}))
    spark.stop()


if __name__ == "__main__":
    main()
