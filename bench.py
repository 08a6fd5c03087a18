"""Headline queries, timed. Prints one JSON line.

Every figure is taken with phases computed anew: nothing a former query wrote is reused,
except that `workflows` goes on from the table of `trigger_edges`, as the stages do.
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from loomgraph.catalog import QUERIES  # noqa: E402
from loomgraph.operators.flow import Flow  # noqa: E402
from loomgraph.operators.graph import Graph  # noqa: E402
from loomgraph.sources.views import Tables  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
PLAIN = ["flagship_page_verdicts", "X2_widget_kinds", "E3_attempt_fold", "E8_request_attribution", "E11_coverage_tiers",
         "E15_residual_families", "M1_structural_issues", "X20_canonical_routes"]


def consume(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times = {}

    def timed(name, fn):
        start = time.time()
        fn()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    timed("warm_up", lambda: consume(spark.read.parquet(f"{FOLDER}/lineitem.parquet")))
    for name in PLAIN:
        timed(name, lambda: consume(QUERIES[name](spark, FOLDER)))
    tables = Tables(spark, FOLDER)
    flow = Flow(Graph(tables))
    timed("trigger_edges", lambda: consume(flow.triggers))
    timed("workflows", lambda: consume(flow.workflows))
    times.pop("warm_up")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
