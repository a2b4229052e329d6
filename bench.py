"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: warm, the median of several runs.

Prints one line of JSON. Each query is run to the end, into a sink that discards its rows. At that size a job's fixed
cost weighs most; so four of them also run over tables that are repeated ``FACTOR`` times, reported as rows a second.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

HEADLINE = ("flagship", "subset", "merge_inner", "aggregate_mean", "count", "rollingmerge_backward", "rangemerge", "duplicated_keys", "freq_prop", "summarise", "filldown", "transform", "unite", "rollmean")
RUNS = 5
#: Queries over repeated tables, with the table whose rows are counted.
LARGER = {"subset": "lineitem", "merge_inner": "orders", "aggregate_mean": "lineitem", "count": "orders"}
FACTOR = 20


def timed(query, spark: SparkSession, sf_dir: str, runs: int) -> float:
    """The median of warm runs."""
    times = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return median(times[1:])


def larger(queries, spark: SparkSession, sf_dir: str) -> dict:
    with tempfile.TemporaryDirectory() as folder:
        rows = {}
        for table in ("lineitem", "orders", "customer"):
            times = FACTOR if table in LARGER.values() else 1
            path = f"file://{folder}/{table}.parquet"
            spark.range(times).select().crossJoin(spark.read.parquet(f"{sf_dir}/{table}.parquet")).write.parquet(path)
            rows[table] = spark.read.parquet(path).count()
        speed = {name: round(rows[table] / timed(queries[name], spark, f"file://{folder}", 3)) for name, table in LARGER.items()}
    return {"factor": FACTOR, "rows": {t: rows[t] for t in LARGER.values()}, "rows_a_second": speed}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from lattica.plans.catalogue import QUERIES

    took = {name: round(timed(QUERIES[name], spark, sf_dir, RUNS), 4) for name in HEADLINE}
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({"metric": "headline queries, median of warm runs", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "shuffle_partitions": int(cpus), "lineitem_rows": rows, "runs": RUNS, "larger": larger(QUERIES, spark, sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
