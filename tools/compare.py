"""Run queries next to their check SQL: python tools/compare.py [sf] [name prefix ...]"""

import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from loomgraph.catalog import ORACLE, QUERIES  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def main(sf, prefixes):
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = []
    for name, run in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            t0 = time.time()
            df = run(spark, folder)
            cols = sorted(df.columns)
            got = sorted(tuple(r) for r in df.select(*cols).collect())
            t1 = time.time()
            if name not in ORACLE:
                print(f"rows {name} {len(got)} spark={t1 - t0:.1f}s", flush=True)
                continue
            want = sorted(con.execute(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall())
            t2 = time.time()
            ok = got == want
            print(f"{'ok  ' if ok else 'DIFF'} {name} {len(got)} {len(want)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                a, b = set(got), set(want)
                print("  cols", cols, "\n  spark only", len(a - b), sorted(a - b)[:2], "\n  sql only", len(b - a), sorted(b - a)[:2], flush=True)
        except Exception as ex:  # keep going, all failures are listed
            bad.append(name)
            print("FAIL", name, type(ex).__name__, str(ex)[:700].replace("\n", " | "), flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:])
