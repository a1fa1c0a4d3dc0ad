"""Copies of a version, versions out of range, table migrations, script folders."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from evolve.operators import checks
from evolve.operators import history as hist
from evolve.plans import planning as pl
from evolve.plans.migrate import Change, Hook, log_as_history_events, migrate_table, steps_down
from evolve.sources.files import read_script_files

SCRIPT = "project string, direction string, version int, description string, file_name string, path string, md5_checksum string"
COPIES = [("p", "UP", 1, "a", "V001_a.sql", "x/V001_a.sql", "m1"),
          ("p", "UP", 2, "b", "V002_b.sql", "y/V002_b.sql", "m3"),
          ("p", "UP", 2, "b", "V002_b.sql", "x/V002_b.sql", "m2")]
NOW = dt.datetime(2024, 1, 1)


def test_copies_break_the_local_order_and_are_repaired_once(spark):
    s = spark.createDataFrame(COPIES, SCRIPT)
    assert [(r.expected, r.got) for r in checks.local_gaps(s).collect()] == [(3, 2)]
    t = spark.createDataFrame([(7, "p")], "target_id long, project string")
    rows = hist.repair(spark.createDataFrame([], hist.schemas.HISTORY), s, t, NOW).collect()
    assert sorted((r.version, r.md5_checksum) for r in rows) == [(1, "m1"), (2, "m3")]


def test_copies_finish_one_after_the_other(spark):
    s = spark.createDataFrame(COPIES, SCRIPT)
    a = spark.createDataFrame([(7, "p", False, 0, 2, "run")],
                              "target_id long, project string, down boolean, latest_version int, destination int, action string")
    h = spark.createDataFrame([("p", "BEFORE_EACH", 1, None, "be", "")],
                              "project string, hook_type string, hook_order int, hook_version int, file_name string, content string")
    steps = pl.plan_up(a, s, h).orderBy("step").collect()
    assert [r.kind for r in steps] == ["BEFORE_EACH", "UP"] * 3


def test_a_huge_destination_stays_bounded(spark):
    r = spark.createDataFrame([("p", 1, 2_000_000_000)], "project string, lo int, hi int")
    s = spark.createDataFrame([("p", 65535)], "project string, version int")
    assert pl.versions_in_range(r, s, "lo", "hi").count() == 1


def test_unrecorded_and_fold_account_for_the_log(spark):
    log = spark.createDataFrame(
        [(1, 1, 40000, "UP", "d", "m", True, NOW), (2, 1, 5, "UP", "d", "m", True, NOW)], hist.schemas.LOG)
    lost = hist.unrecorded(log).collect()
    assert [r.version for r in lost] == [40000] and "40000" in lost[0].reason
    assert [r.version for r in hist.fold_history(log).collect()] == [5]


def test_apply_ups_refuses_other_directions(spark):
    log = spark.createDataFrame([(1, 1, 5, "DOWN", "d", "m", True, NOW)], hist.schemas.LOG)
    with pytest.raises(Exception, match="UP attempts only"):
        hist.apply_ups(spark.createDataFrame([], hist.schemas.HISTORY), log).collect()


def test_table_migration_rules(spark):
    add = lambda c: f"SELECT *, 1 AS {c} FROM {{t}}"
    changes = [Change(1, add("a"), None, "a"), Change(2, add("b"), "SELECT * EXCEPT (b) FROM {t}", "b")]
    hooks = [Hook("BEFORE", 1, add("x"), name="x"), Hook("AFTER_EACH", 1, "SELECT *, 2 AS ae FROM {t}", version=None, name="ae"),
             Hook("REPEATABLE_DOWN", 1, add("r"), name="r")]
    df = spark.range(2)
    assert migrate_table(spark, df, changes, 1, 1, hooks=hooks).table.columns == ["id"]        # nothing to do
    assert [s.kind for s in steps_down(changes, hooks, 2, 0)] == ["DOWN", "REPEATABLE_DOWN"]    # 1 has no DOWN
    seen = []
    migrate_table(spark, df, changes[:1], 0, 1, hooks=hooks, publish=lambda t, v: seen.append((v, t.columns)))
    assert seen == [(1, ["id", "x", "a", "ae"])]                                              # after its hooks
    out = migrate_table(spark, df, changes, 0, 2)
    rows = log_as_history_events(out, 1, NOW, spark).collect()
    assert all(r.md5_checksum for r in rows) and len(rows) == 2


def test_folder_names_are_normalised_and_stray_files_an_error(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/m1")
    with open(f"{tmpdir_path}/m1/V001_a.sql", "w") as f:
        f.write("select 1")
    for name in ("/m1", "/m1/", "//m1", "/zz/../m1"):
        assert read_script_files(spark, {"p": [tmpdir_path + name]}).count() == 1
    with pytest.raises(Exception, match="no location holds the file|PATH_NOT_FOUND"):
        read_script_files(spark, {"p": [tmpdir_path + "/m*"]}).select(F.max("project")).collect()
