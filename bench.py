"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom import queries as core

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    line, orders = (core.table(spark, SF, t) for t in ("lineitem", "orders"))
    rows = lambda s: s.df.write.format("noop").mode("overwrite").save()
    runs = {
        "filter_count": lambda: line.Count(lambda r: r.l_quantity > 25),
        "filter_sum": lambda: line.Where(lambda r: r.l_quantity > 25).Sum("l_extendedprice"),
        "filter_average": lambda: line.Where(lambda r: r.l_quantity > 25).Average("l_extendedprice"),
        "filter_map_slice": lambda: rows(orders.Where(lambda r: r.o_totalprice > 1000).Select(lambda r: r.o_totalprice * 2).Take(50_000)),
        "top_100": lambda: rows(orders.OrderByDescending("o_totalprice").Take(100)),
        "top_1000_two_keys": lambda: rows(orders.OrderBy("o_orderpriority").ThenByDescending("o_totalprice").Take(1000)),
        "distinct_by": lambda: rows(orders.DistinctBy(lambda r: r.o_custkey % 10_000)),
        "group_by": lambda: line.GroupBy("l_suppkey").Agg(n=F.count("*"), q=F.sum("l_quantity")).df.collect(),
        "join": lambda: orders.Join(core.table(spark, SF, "customer"), "o_custkey", "c_custkey", lambda o, c: {"v": o.o_totalprice, "b": c.c_acctbal}).Sum(lambda r: r.v + r.b),
        "all": lambda: line.All(lambda r: r.l_quantity > 0),
        "find": lambda: orders.First(lambda r: r.o_orderkey == 140_000),
        "pricing_summary": lambda: core.pricing_summary(spark, SF).collect(),
    }
    times = {}
    for name, run in runs.items():
        run()
        took = []
        for _ in range(3):
            t = time.perf_counter()
            run()
            took.append(time.perf_counter() - t)
        times[name] = round(sorted(took)[1], 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
