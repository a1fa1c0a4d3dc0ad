"""The reference's own small test cases, written as DataFrames."""

import datetime as dt

from pyspark.sql import functions as F

from evolve.operators import checks, history as hist
from evolve.plans import planning as pl
from evolve.plans.effects import effective_steps

T0 = dt.datetime(2024, 1, 1)
HIST = "target_id long, version int, description string, md5_checksum string, success boolean, " \
       "executed_at timestamp_ntz, repaired_at timestamp_ntz"
SCRIPTS = "project string, direction string, version int, description string, file_name string, " \
          "md5_checksum string"
LOG = "event_id long, target_id long, version int, direction string, description string, md5_checksum string, " \
      "success boolean, executed_at timestamp_ntz"


def hist_df(spark, rows):
    return spark.createDataFrame([(1, v, d, m, ok, T0, None) for v, d, m, ok in rows], HIST)


def targets_df(spark, ids=(1,), project="p", down=False, destination=None):
    return spark.createDataFrame([(i, project, down, destination) for i in ids],
                                 "target_id long, project string, down boolean, destination int")


def scripts_df(spark, rows, project="p"):
    return spark.createDataFrame(
        [(project, d, v, desc, f"V{v:03d}_{desc}.{'down.' if d == 'DOWN' else ''}sql", m) for d, v, desc, m in rows],
        SCRIPTS)


def test_latest_ignores_failed_and_gaps(spark):
    h = hist_df(spark, [(1, "a", "x", True), (5, "b", "x", True), (7, "c", "x", False)])
    t = targets_df(spark, ids=(1, 2))
    got = {r.target_id: r.latest_version for r in hist.latest_version(h, t).collect()}
    assert got == {1: 5, 2: 0}


def test_failing_rows(spark):
    h = hist_df(spark, [(1, "a", "x", False), (2, "b", "x", True), (3, "c", "x", False)])
    assert sorted(r.version for r in hist.failing(h).collect()) == [1, 3]


def test_validate_history_against_local(spark):
    s = scripts_df(spark, [("UP", 1, "one", "m1"), ("UP", 2, "two", "m2")])
    t = targets_df(spark)
    gap = hist_df(spark, [(2, "two", "m2", True)])
    assert [r.missing_version for r in checks.history_gaps(gap, s, t).collect()] == [1]
    ok = hist_df(spark, [(1, "one", "m1", True), (2, "two", "m2", True)])
    assert checks.problems(ok, s, t).count() == 0
    changed = hist_df(spark, [(1, "one", "m1", True), (2, "two", "m1", True)])
    d = checks.drift_detail(changed, s, t).collect()
    assert [(r.version, r.reason) for r in d] == [(2, "checksum")]
    empty = hist_df(spark, [])
    assert checks.problems(empty, s, t).count() == 0


def test_no_local_scripts_skips_history_checks(spark):
    s = scripts_df(spark, [])
    h = hist_df(spark, [(3, "x", "m", True)])
    assert checks.history_gaps(h, s, targets_df(spark)).count() == 0
    assert checks.drift(h, s, targets_df(spark)).count() == 0


def test_local_gap_and_duplicates(spark):
    s = scripts_df(spark, [("UP", 1, "a", "m"), ("UP", 3, "c", "m")])
    assert [(r.expected, r.got) for r in checks.local_gaps(s).collect()] == [(2, 3)]
    dup = scripts_df(spark, [("UP", 1, "a", "m"), ("UP", 1, "b", "m"), ("UP", 2, "c", "m")])
    assert [(r.expected, r.got) for r in checks.local_gaps(dup).collect()] == [(2, 1)]


def test_repair_replaces_and_inserts(spark):
    h = hist_df(spark, [(1, "one", "wrong", True)])
    s = scripts_df(spark, [("UP", 1, "one", "m1"), ("UP", 2, "two", "m2")])
    at = dt.datetime(2024, 2, 1)
    rows = {r.version: r for r in hist.repair(h, s, targets_df(spark), at).collect()}
    assert rows[1].md5_checksum == "m1" and rows[1].repaired_at == at and rows[1].executed_at == T0
    assert rows[2].success and rows[2].repaired_at == at
    # unchanged rows keep repaired_at; failed rows: reset (one driver) or keep (other)
    h2 = hist_df(spark, [(1, "one", "m1", False)])
    keep = hist.repair(h2, s, targets_df(spark), at, reset_success=False).where("version = 1").first()
    reset = hist.repair(h2, s, targets_df(spark), at, reset_success=True).where("version = 1").first()
    assert keep.success is False and reset.success is True and keep.repaired_at is None


def test_rollback_deletes_row(spark):
    h = hist_df(spark, [(1, "one", "m1", True)])
    log = spark.createDataFrame([(1, 1, 1, "DOWN", "one", None, True, T0)], LOG)
    assert hist.apply_rollbacks(h, log).count() == 0
    failed = spark.createDataFrame([(1, 1, 1, "DOWN", "one", None, False, T0)], LOG)
    assert hist.apply_rollbacks(h, failed).count() == 1
    absent = spark.createDataFrame([(1, 1, 9, "DOWN", "x", None, True, T0)], LOG)
    assert hist.apply_rollbacks(h, absent).count() == 1


def test_repaired_at_kept_on_upsert_cleared_by_rollback(spark):
    at = dt.datetime(2024, 2, 1)
    h = spark.createDataFrame([(1, 1, "one", "m1", True, T0, at)], HIST)
    up = spark.createDataFrame([(1, 1, 1, "UP", "one", "m9", True, T0 + dt.timedelta(1))], LOG)
    assert hist.fold_history(up, h).first().repaired_at == at
    down_up = spark.createDataFrame([(1, 1, 1, "DOWN", "one", None, True, T0 + dt.timedelta(1)),
                                     (2, 1, 1, "UP", "one", "m9", True, T0 + dt.timedelta(2))], LOG)
    r = hist.fold_history(down_up, h).first()
    assert r.repaired_at is None and r.md5_checksum == "m9"


def test_transaction_rolls_back_whole_run(spark):
    log = spark.createDataFrame([(1, 1, 1, "UP", "a", "m", True, T0),
                                 (2, 1, 2, "UP", "b", "m", False, T0 + dt.timedelta(seconds=1))], LOG)
    assert effective_steps(log, in_transaction=True).count() == 0
    assert effective_steps(log, in_transaction=True, force=True).count() == 0
    assert effective_steps(log).count() == 2
    log3 = log.unionByName(spark.createDataFrame([(3, 1, 3, "UP", "c", "m", True,
                                                   T0 + dt.timedelta(seconds=2))], LOG))
    assert effective_steps(log3).count() == 2
    assert effective_steps(log3, force=True).count() == 3


def _hooks(spark, rows, project="p"):
    return spark.createDataFrame([(project, t, o, v, n, "") for t, o, v, n in rows],
                                 "project string, hook_type string, hook_order int, hook_version int, "
                                 "file_name string, content string")


def test_up_with_hooks_order(spark):
    s = scripts_df(spark, [("UP", 1, "one", "m1"), ("UP", 2, "two", "m2")])
    hooks = _hooks(spark, [("BEFORE", 1, None, "B001"), ("BEFORE", 2, None, "B002"),
                           ("BEFORE_EACH", 1, None, "BE001"), ("BEFORE_VERSION", 1, 2, "BV001_002"),
                           ("AFTER", 1, None, "A001"), ("AFTER_EACH", 1, None, "AE001"),
                           ("AFTER_VERSION", 1, 2, "AV001_002"), ("REPEATABLE", 1, None, "R001")])
    t = targets_df(spark)
    acts = pl.run_action(t, hist_df(spark, []), s)
    plan = [r.name for r in pl.plan_up(acts, s, hooks).orderBy("step").collect()]
    assert plan == ["B001", "B002", "BE001", "V001_one.sql", "AE001",
                    "R001", "BE001", "BV001_002", "V002_two.sql", "AV001_002", "AE001", "A001"]


def test_down_with_repeatable_down(spark):
    s = scripts_df(spark, [("UP", 1, "one", "m1"), ("UP", 2, "two", "m2"),
                           ("DOWN", 1, "one", None), ("DOWN", 2, "two", None)])
    h = hist_df(spark, [(1, "one", "m1", True), (2, "two", "m2", True)])
    hooks = _hooks(spark, [("REPEATABLE_DOWN", 1, None, "R001.down")])
    acts = pl.run_action(targets_df(spark, down=True), h, s)
    plan = [r.name for r in pl.plan_down(acts, s, hooks).orderBy("step").collect()]
    assert plan == ["V002_two.down.sql", "R001.down", "V001_one.down.sql"]


def test_destinations_that_do_nothing(spark):
    s = scripts_df(spark, [("UP", v, f"v{v}", "m") for v in (1, 2, 3)] + [("DOWN", v, f"v{v}", None) for v in (1, 2, 3)])
    h = hist_df(spark, [(1, "v1", "m", True), (2, "v2", "m", True)])
    up1 = pl.run_action(targets_df(spark, destination=1), h, s).first().action
    down3 = pl.run_action(targets_df(spark, down=True, destination=3), h, s).first().action
    same = pl.run_action(targets_df(spark, destination=2), h, s).first().action
    assert (up1, down3, same) == ("up_below_current", "down_above_current", "up_to_date")


def test_failing_row_blocks_next_run(spark):
    s = scripts_df(spark, [("UP", 1, "one", "m1"), ("UP", 2, "two", "m2")])
    h = hist_df(spark, [(1, "one", "m1", False)])
    t = targets_df(spark)
    g = checks.gate(h, s, t)
    assert g.first().stage == 1
    assert pl.run_action(t, h, s, gate=g).first().action == "blocked"


def test_changed_script_blocks(spark):
    s = scripts_df(spark, [("UP", 1, "one", "m1"), ("UP", 2, "two", "m2-edited")])
    h = hist_df(spark, [(1, "one", "m1", True), (2, "two", "m2", True)])
    assert checks.gate(h, s, targets_df(spark)).first().stage == 3


def test_pipeline_fold_then_checks(spark):
    # forced run: version 1 ok, version 2 fails; history has both, 2 failing
    log = spark.createDataFrame([(1, 1, 1, "UP", "one", "m1", True, T0),
                                 (2, 1, 2, "UP", "two", "m2", False, T0 + dt.timedelta(seconds=1))], LOG)
    h = hist.fold_history(log)
    assert h.count() == 2 and hist.failing(h).count() == 1
    # down to 0 removes everything
    down = spark.createDataFrame([(3, 1, 2, "DOWN", "two", None, True, T0 + dt.timedelta(seconds=2)),
                                  (4, 1, 1, "DOWN", "one", None, True, T0 + dt.timedelta(seconds=3))], LOG)
    assert hist.fold_history(down, h).count() == 0
    assert hist.fold_history(log.unionByName(down)).count() == 0


def test_repair_without_history_table_does_nothing(spark):
    s = scripts_df(spark, [("UP", 1, "one", "m1")])
    t = spark.createDataFrame([(1, "p", False, None, False)],
                              "target_id long, project string, down boolean, destination int, history_exists boolean")
    assert hist.repair(hist_df(spark, []), s, t, dt.datetime(2024, 2, 1)).count() == 0


def test_versions_beyond_the_stored_range_are_not_recorded(spark):
    log = spark.createDataFrame([(1, 1, 32767, "UP", "a", "m", True, T0), (2, 1, 32768, "UP", "b", "m", True, T0),
                                 (3, 1, 65535, "UP", "c", "m", True, T0)], LOG)
    assert sorted(r.version for r in hist.fold_history(log).collect()) == [32767]
    s = scripts_df(spark, [("UP", 32767, "a", "m"), ("UP", 40000, "b", "m")])
    assert sorted(r.version for r in hist.repair(hist_df(spark, []), s, targets_df(spark), T0).collect()) == [32767]
