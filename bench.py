"""Time the headline queries: ``BENCH_SF_DIR``, ``BENCH_CPUS``, ``BENCH_RUNS``; prints one JSON line.

Every query is run to a full count of its result columns through a no-op sink, so
no work is skipped and no rows travel to the driver. The best of the runs counts.

The test tables are single files of one row group, which one task reads however many
cores there are; before the clock starts they are laid out as one file per core, as tables of any size are.
"""

from __future__ import annotations

import json
import os
import time

from firstpast import session
from firstpast.plans.written import QUERIES

HEADLINE = (
    "per_source_stats", "source_percentiles", "head_to_head", "leader_split", "own_vs_other", "daily_trend",
    "signature_panel", "first_provider_share", "set_rows", "invalid_split", "anchored_set_stats",
    "contested_scoreboard", "txn_race", "txn_percentiles", "completed_ranges", "txn_readable_at",
    "packet_parse", "rule_match", "stream_set_rows",
)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def laid_out(spark, sf_dir: str, files: int) -> str:
    """A folder with the same tables in so many files each."""
    folder = session.working_path(spark, "tables")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = session.build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    tables = laid_out(spark, sf_dir, int(cpus))
    seconds: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(1 if name.startswith("stream") else runs):
            begin = time.perf_counter()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - begin
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    arrivals = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    spark.stop()
    rates = {name: round(arrivals / seconds[name]) for name in ("per_source_stats", "set_rows") if name in seconds}
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "runs": runs,
        "arrivals": arrivals, "arrivals_per_sec": rates}))


if __name__ == "__main__":
    main()
