"""Own scale numbers on a generated fleet (not a registered query).

    python tools/fleet_scale.py [--targets 100000] [--versions 100] [--rows 3000000]

The log is generated with ``spark.range``: ``--rows`` attempts spread over
``--targets`` targets x ``--versions`` versions, with skew on purpose: target 0
holds a third of all attempts (a hot tenant), and versions 1..3 of every target
are attempted over and over.  Each operator runs fully into the ``noop`` sink;
the times are printed as one JSON line.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--targets", type=int, default=100_000)
    ap.add_argument("--versions", type=int, default=100)
    ap.add_argument("--rows", type=int, default=3_000_000)
    args = ap.parse_args()

    from pyspark.sql import functions as F

    from evolve.operators import checks, history as hist
    from evolve.plans import planning as pl
    from evolve.plans.effects import effective_steps
    from evolve.session import get_spark
    from evolve.sources.tables import read_history, write_history

    warehouse = tempfile.mkdtemp(prefix="evolve-fleet-wh-")
    spark = get_spark(extra={"spark.sql.warehouse.dir": warehouse})
    n, v = args.targets, args.versions

    ids = spark.range(args.rows)
    hot = F.col("id") % 3 == 0
    target = F.when(hot, F.lit(0)).otherwise(F.xxhash64("id") % n).cast("long")
    version = (F.when(F.col("id") % 7 < 3, F.col("id") % 3 + 1)
               .otherwise(F.abs(F.xxhash64(F.col("id") * 31)) % v + 1)).cast("int")
    log = ids.select(
        F.col("id").alias("event_id"), F.abs(target).alias("target_id"), version.alias("version"),
        F.when(F.col("id") % 11 == 0, "DOWN").otherwise("UP").alias("direction"),
        F.concat(F.lit("d"), version.cast("string")).alias("description"),
        F.md5(version.cast("string")).alias("md5_checksum"),
        (F.col("id") % 13 != 0).alias("success"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(secs=(F.col("id") * 17 % 2_592_000).cast("decimal(18,6)"))).alias("executed_at"))
    scripts = spark.range(1, v + 1).select(
        F.when(F.col("id") >= 0, "app").alias("project"), F.lit("UP").alias("direction"),
        F.col("id").cast("int").alias("version"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("description"),
        F.format_string("V%03d_x.sql", F.col("id")).alias("file_name"), F.md5(F.col("id").cast("string")).alias("md5_checksum"))
    scripts = scripts.unionByName(scripts.withColumn("direction", F.lit("DOWN")).withColumn("md5_checksum", F.lit(None)))
    targets = spark.range(n).select(F.col("id").alias("target_id"), F.when(F.col("id") >= 0, "app").alias("project"),
                                    (F.col("id") % 2 == 1).alias("down"), F.lit(None).cast("int").alias("destination"))
    hooks = spark.range(3).select(F.when(F.col("id") >= 0, "app").alias("project"),
                                  F.element_at(F.array(F.lit("BEFORE"), F.lit("BEFORE_EACH"), F.lit("AFTER")),
                                               F.col("id").cast("int") + 1).alias("hook_type"),
                                  F.lit(1).alias("hook_order"), F.lit(None).cast("int").alias("hook_version"),
                                  F.concat(F.lit("h"), F.col("id").cast("string")).alias("file_name"))

    def run(df):
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t0, 2)

    times = {}
    times["fold_history"] = run(hist.fold_history(log))
    t0 = time.perf_counter()
    write_history(spark, hist.fold_history(log), "fleet_history", buckets=16)
    times["write_history_bucketed"] = round(time.perf_counter() - t0, 2)
    h = read_history(spark, "fleet_history")
    times["status"] = run(checks.status(h, scripts, targets))
    times["gate"] = run(checks.gate(h, scripts, targets))
    times["history_gaps"] = run(checks.history_gaps(h, scripts, targets))
    times["drift"] = run(checks.drift(h, scripts, targets))
    acts = pl.run_action(targets, h, scripts)
    times["run_action"] = run(acts)
    times["plan_up"] = run(pl.plan_up(acts, scripts, hooks))
    times["plan_down"] = run(pl.plan_down(acts, scripts, hooks))
    times["effective_failfast"] = run(effective_steps(log))
    times["effective_atomic"] = run(effective_steps(log, in_transaction=True))
    times["repair"] = run(hist.repair(h, scripts, targets, dt.datetime(2024, 2, 1)))
    print(json.dumps({"targets": n, "versions": v, "log_rows": args.rows,
                      "history_rows": h.count(), "hot_target_rows": args.rows // 3, "seconds": times}))
    spark.stop()


if __name__ == "__main__":
    main()
