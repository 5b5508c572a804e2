"""Headline queries at one scale, timed: one warm-up, then the median of three.

Prints one JSON line. ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of cores.
Results are computed completely (into Spark's ``noop`` sink) and not brought to the driver.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from pyspark.sql import Window, functions as F

from tablewright.operators.export import export_parquet, summarize
from tablewright.plans.catalogue import QUERIES
from tablewright.session import build_session
from tablewright.sources.folders import clean_up, fresh_folder
from tablewright.sources.tables import table

DIRECTORY = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = 3

HEADLINE = (
    "b01_execute_statement",
    "b03_preview",
    "b04_rows_as_json",
    "b05_rows_as_text",
    "b06_profile",
    "b07_export_parquet",
    "b08_export_manifest",
    "b10_update",
    "b10_update_versioned",
    "b11_delete",
    "b13_as_of_changes",
    "b16_column_mask",
    "p09_inner_join",
    "p10_left_outer_join",
    "p14_interval_join",
    "p15_as_of_join",
    "p22_count_distinct",
    "p24_cube",
    "p25_percentiles",
    "p29_ranking",
    "p31_rows_frame",
    "p33_top_k",
    "p42_explode",
    "p49_session_window",
)


def seconds(action) -> float:
    action()
    taken = []
    for _ in range(RUNS):
        start = time.perf_counter()
        action()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken), 3)


def finish(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def export_in_two_passes(spark, path: str) -> None:
    """The plain way to export with a row count: keep, count, write, let go."""
    lines = table(spark, DIRECTORY, "lineitem").cache()
    lines.count()
    lines.write.mode("overwrite").parquet(path)
    lines.unpersist(blocking=True)


def export_in_one_pass(spark, path: str) -> None:
    summarize(export_parquet(table(spark, DIRECTORY, "lineitem"), path)).first()


def plain_running_sums(spark):
    """What ``p31_rows_frame`` computes, without the look for hot keys."""
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    events = table(spark, DIRECTORY, "events").select("event_id", "user_id", "ts", "value")
    return events.withColumns(
        {
            "n_so_far": F.count(F.lit(1)).over(upto),
            "spent_so_far": F.sum(F.col("value").cast("decimal(12,2)")).over(upto),
        }
    )


def main() -> None:
    spark = build_session(
        "bench",
        {
            "spark.sql.shuffle.partitions": str(CPUS),
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            # Do not record a call site for every column expression that is built.
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
        master=f"local[{CPUS}]",
    )
    spark.sparkContext.setLogLevel("OFF")
    taken = {
        name: seconds(lambda name=name: finish(QUERIES[name](spark, DIRECTORY)))
        for name in HEADLINE
    }
    plain = {"p31_plain_window": seconds(lambda: finish(plain_running_sums(spark)))}
    exports = {
        "export_keep_count_write": seconds(
            lambda: export_in_two_passes(spark, fresh_folder(spark, "bench"))
        ),
        "export_one_pass_with_manifest": seconds(
            lambda: export_in_one_pass(spark, fresh_folder(spark, "bench"))
        ),
    }
    scale = re.search(r"sf([0-9.]+)$", DIRECTORY.rstrip("/"))
    print(
        json.dumps(
            {
                "metric": "sum of median seconds per headline query",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "exports": exports,
                "plain": plain,
                "sf": float(scale.group(1)) if scale else DIRECTORY,
                "cpus": CPUS,
                "spark": spark.version,
            }
        )
    )
    clean_up(spark)
    spark.stop()


if __name__ == "__main__":
    main()
