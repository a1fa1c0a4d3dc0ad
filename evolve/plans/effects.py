"""Which attempted steps of a run remain in force.

A run is a group of log rows (by default: one target, one day) ordered by
(executed_at, event_id).

* no force, no transaction: the run stops at its first failure, so the steps
  up to and including it remain;
* force, no transaction: every attempted step remains;
* in a transaction: a run with any failure is rolled back completely, force
  or not.

Plan: one hash aggregate per run (first failure, or "has a failure"), then a
join back to the log on the run key.  No window over a run: a run may be a
large share of the log (one busy target on one day), and an aggregate with a
map-side combine plus a skew-split join handles that, a window would not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_key() -> Column:
    """(executed_at, event_id) packed into one DECIMAL(38,0) with the same
    order: microseconds since 1970 (wall clock, no time zone involved) times
    10^20 plus event_id shifted to be non-negative.  A fixed-width key keeps
    the first-failure aggregate a hash aggregate."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                              F.col("executed_at").cast("timestamp_ntz"))
    shifted_id = F.col("event_id").cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)")
    return (micros.cast("decimal(18,0)") * F.lit(str(10 ** 20)).cast("decimal(21,0)")
            + shifted_id).cast("decimal(38,0)")


def default_run_key() -> list[Column]:
    return [F.col("target_id"), F.to_date("executed_at").alias("run_day")]


def _keyed(log: DataFrame, run_key: list[Column] | None):
    key = run_key or default_run_key()
    names = []
    for i, c in enumerate(key):
        name = f"_run{i}"
        log = log.withColumn(name, c)
        names.append(name)
    return log, names


def effective_steps(log: DataFrame, force: bool = False, in_transaction: bool = False,
                    run_key: list[Column] | None = None) -> DataFrame:
    """Log rows whose effect remains after the run ended."""
    if force and not in_transaction:
        return log
    keyed, names = _keyed(log, run_key)
    failed = keyed.where(~F.col("success"))
    if in_transaction:
        bad_runs = failed.select(*names).distinct()
        return keyed.join(bad_runs, names, "left_anti").drop(*names)
    first = failed.groupBy(*names).agg(F.min(order_key()).alias("_first_fail"))
    return (keyed.join(first, names, "left")
            .where(F.col("_first_fail").isNull() | (order_key() <= F.col("_first_fail")))
            .drop(*names, "_first_fail"))
