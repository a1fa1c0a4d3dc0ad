"""Versioned table chains."""

import datetime

import pytest
from pyspark.sql import functions as F

from evolve import fixtures as fx
from evolve.plans.effects import effective_steps
from evolve.plans.migrate import Change, Hook, log_as_history_events, migrate_table
from evolve.operators.history import fold_history
from conftest import SF_SMALL


def test_up_then_down_restores_columns(spark):
    orders = fx.table(spark, SF_SMALL, "orders")
    changes = [c for c in fx.orders_changes() if c.version < 3]
    up = migrate_table(spark, orders, changes, 0, 2).table
    back = migrate_table(spark, up, changes, 2, 0).table
    assert sorted(back.columns) == sorted(orders.columns)
    assert back.exceptAll(orders).count() == 0 and orders.exceptAll(back).count() == 0


def test_chain_is_one_scan(spark):
    changes, hooks = fx.lineitem_changes()
    out = migrate_table(spark, fx.table(spark, SF_SMALL, "lineitem"), changes, 0, 3, hooks=hooks).table
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan


def test_force_skips_failing_step_and_logs_it(spark):
    df = spark.range(5).withColumnRenamed("id", "a")
    changes = [Change(1, "SELECT a, a * 2 AS b FROM {t}"), Change(2, "SELECT nope FROM {t}"),
               Change(3, "SELECT *, b + 1 AS c FROM {t}")]
    stopped = migrate_table(spark, df, changes, 0, 3)
    assert stopped.table.columns == ["a", "b"] and [s[4] for s in stopped.log] == [True, False]
    forced = migrate_table(spark, df, changes, 0, 3, force=True)
    assert forced.table.columns == ["a", "b", "c"] and [s[4] for s in forced.log] == [True, False, True]
    events = log_as_history_events(forced, 42, datetime.datetime(2024, 1, 1), spark)
    h = fold_history(events.withColumn("md5_checksum", F.lit("x")))
    assert sorted((r.version, r.success) for r in h.collect()) == [(1, True), (2, False), (3, True)]


def test_hooks_in_plan_order_and_checkpointing(spark):
    df = spark.range(3).withColumn("trail", F.lit(""))
    add = lambda tag: (lambda d: d.withColumn("trail", F.concat("trail", F.lit(tag))))
    changes = [Change(v, add(f"V{v}")) for v in (1, 2)]
    hooks = [Hook("BEFORE", 1, add("B")), Hook("REPEATABLE", 1, add("R")), Hook("AFTER_EACH", 1, add("E")),
             Hook("BEFORE_VERSION", 1, add("X"), version=2), Hook("AFTER", 1, add("A"))]
    out = migrate_table(spark, df, changes, 0, 2, hooks=hooks, checkpoint_every=2).table
    assert out.first().trail == "BV1ERXV2EA"


def test_publish_once_and_after_each_version(spark):
    from evolve.sources.tables import publish_table, publisher
    orders = fx.table(spark, SF_SMALL, "orders")
    out = migrate_table(spark, orders, fx.orders_changes(), 0, 3, publish=publisher(spark, "orders_each")).table
    assert "priority" in spark.table("orders_each").columns
    assert spark.table("orders_each").count() == out.count()
    publish_table(spark, out, "orders_once")
    assert spark.table("orders_once").exceptAll(out).count() == 0


BROKEN_AT_RUN_TIME = "SELECT *, CAST(word AS INT) AS n FROM {t}"


def _words(spark):
    return spark.createDataFrame([("one",), ("two",)], "word string")


def _with_broken_second():
    return [Change(1, "SELECT *, 1 AS a FROM {t}", description="a"), Change(2, BROKEN_AT_RUN_TIME, description="n"),
            Change(3, "SELECT *, 3 AS c FROM {t}", description="c")]


@pytest.mark.parametrize("every", [1, 2, 3, 100])
def test_run_time_failures_are_named_wherever_the_cuts_lie(spark, every):
    stopped = migrate_table(spark, _words(spark), _with_broken_second(), 0, 3, checkpoint_every=every)
    assert [s[4] for s in stopped.log] == [True, False] and not stopped.success and stopped.table.columns == ["word", "a"]
    forced = migrate_table(spark, _words(spark), _with_broken_second(), 0, 3, force=True, checkpoint_every=every)
    assert [s[4] for s in forced.log] == [True, False, True]
    assert forced.table.columns == ["word", "a", "c"] and forced.table.count() == 2


@pytest.mark.parametrize("force", [False, True])
def test_a_transaction_with_a_failure_is_rolled_back(spark, force):
    seen = []
    out = migrate_table(spark, _words(spark), _with_broken_second(), 0, 3, force=force, checkpoint_every=1,
                        in_transaction=True, publish=lambda t, v: seen.append(v))
    assert out.rolled_back and not out.success and out.table.columns == ["word"] and seen == []
    fine = migrate_table(spark, _words(spark), _with_broken_second()[:1], 0, 1, in_transaction=True,
                         publish=lambda t, v: seen.append(v))
    assert fine.success and not fine.rolled_back and seen == [1]


def test_publishing_stops_or_goes_on_at_a_run_time_failure(spark):
    def store(seen):
        def publish(t, v):
            seen.append((v, sorted(t.columns), t.collect() and t.count()))
        return publish

    stopped, forced = [], []
    migrate_table(spark, _words(spark), _with_broken_second(), 0, 3, publish=store(stopped))
    assert stopped == [(1, ["a", "word"], 2)]
    out = migrate_table(spark, _words(spark), _with_broken_second(), 0, 3, force=True, publish=store(forced))
    assert forced == [(1, ["a", "word"], 2), (3, ["a", "c", "word"], 2)] and [s[4] for s in out.log] == [True, False, True]


def test_a_failing_hook_before_the_first_publish_is_named(spark):
    hooks = [Hook("BEFORE", 1, BROKEN_AT_RUN_TIME, name="b")]
    out = migrate_table(spark, _words(spark), _with_broken_second()[:1], 0, 1, hooks=hooks, force=True,
                        publish=lambda t, v: t.collect() and None)
    assert [(s[1], s[4]) for s in out.log] == [("BEFORE", False), ("UP", True)] and out.table.columns == ["word", "a"]


def test_failing_hooks_and_rollbacks_have_their_texts_and_reach_the_log(spark):
    at = datetime.datetime(2024, 1, 1)
    bad = "SELECT nope FROM {t}"
    changes = [Change(1, "SELECT *, 1 AS a FROM {t}", bad, "a")]
    hooks = [Hook("BEFORE_VERSION", 4, bad, version=1, name="v"), Hook("AFTER", 2, bad, name="z")]
    out = migrate_table(spark, _words(spark), changes, 0, 1, hooks=hooks, force=True)
    assert out.errors[0].startswith("error executing versioned hook 4_1_BEFORE_VERSION: ")
    assert out.errors[1].startswith("error executing hook 2_AFTER: ")
    down = migrate_table(spark, _words(spark), changes, 1, 0)
    assert down.errors[0].startswith("error rolling back migration 1: ")
    events = log_as_history_events(out, 7, at, spark)
    assert {r.direction for r in events.collect()} == {"BEFORE_VERSION", "UP", "AFTER"}
    assert effective_steps(events, in_transaction=True).count() == 0           # a failed hook rolls the run back
    assert [r.direction for r in effective_steps(events).collect()] == ["BEFORE_VERSION"]
    rows = fold_history(effective_steps(events, force=True)).collect()
    assert [(r.version, r.success) for r in rows] == [(1, True)] and rows[0].md5_checksum == out.checksums[1]


def test_rows_written_are_counted_by_the_write(spark):
    """One job writes and counts each version; the log carries the numbers."""
    from evolve.sources.tables import publisher
    df = spark.range(100).withColumnRenamed("id", "a")
    changes = [Change(1, "SELECT a, a % 7 AS b FROM {t}"), Change(2, "SELECT * FROM {t} WHERE b < 3"),
               Change(3, "SELECT nope FROM {t}"), Change(4, "SELECT * FROM {t} WHERE a < 10")]
    out = migrate_table(spark, df, changes, 0, 4, force=True, publish=publisher(spark, "counted_each"))
    want = {1: 100, 2: sum(a % 7 < 3 for a in range(100)), 4: sum(a % 7 < 3 for a in range(10))}
    assert out.rows == want
    assert [(r.version, r.success, r.rows) for r in out.log_frame(spark).collect()] == [
        (1, True, want[1]), (2, True, want[2]), (3, False, None), (4, True, want[4])]
    assert spark.table("counted_each").count() == want[4]
    # without a publisher that counts there are no numbers
    plain = migrate_table(spark, df, changes[:2], 0, 2)
    assert plain.rows == {} and [r.rows for r in plain.log_frame(spark).collect()] == [None, None]
