"""One project over its life, end to end: folder -> load -> gate / action /
plan -> outcomes -> effective steps -> stored history -> repair -> renamed and
new scripts -> down as far as there are DOWN scripts -> a failing transaction.

Executing a script is simulated: a step fails when its text says so.
"""

import datetime as dt
import os

from pyspark.sql import functions as F

from evolve.functions.classify import classify_files
from evolve.operators import checks, history as hist
from evolve.operators.scripts import load_scripts
from evolve.plans import planning as pl
from evolve.plans.effects import effective_steps
from evolve.sources.files import read_script_files
from evolve.sources.tables import read_history, write_history

T0 = dt.datetime(2024, 1, 1)
TABLE = "pipeline_history"


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w") as fh:
        fh.write(text)


def _scripts(spark, folder, down=False):
    return load_scripts(classify_files(read_script_files(spark, {"p": [folder]})), down=down)


def _targets(spark, down=False, destination=None):
    return spark.createDataFrame([(1, "p", down, destination)],
                                 "target_id long, project string, down boolean, destination int")


def _run(spark, folder, run_no, down=False, destination=None, force=False, in_transaction=True,
         validate=True):
    """One run: returns the number of history rows after it."""
    scripts = _scripts(spark, folder, down=down).cache()
    h = read_history(spark, TABLE)
    t = _targets(spark, down, destination)
    g = checks.gate(h, scripts, t) if validate else None
    acts = pl.run_action(t, h, scripts, gate=g)
    action = acts.first().action
    if action != "run":
        return action, h.count()
    plan = (pl.plan_down(acts, scripts, spark.createDataFrame([], "project string, hook_type string, hook_order int, "
                                                                  "hook_version int, file_name string, content string"))
            if down else
            pl.plan_up(acts, scripts, spark.createDataFrame([], "project string, hook_type string, hook_order int, "
                                                                "hook_version int, file_name string, content string")))
    steps = (plan.where(F.col("kind").isin("UP", "DOWN"))
             .join(scripts.select(F.col("direction").alias("kind"), "version", "description", "md5_checksum",
                                  "content"), ["kind", "version"]))
    log = steps.select(
        (F.lit(run_no * 1000) + F.col("step")).cast("long").alias("event_id"), "target_id", "version",
        F.col("kind").alias("direction"), "description", "md5_checksum",
        (~F.col("content").contains("-- fails")).alias("success"),
        (F.lit(T0 + dt.timedelta(days=run_no)).cast("timestamp_ntz")
         + F.make_dt_interval(secs=F.col("step").cast("decimal(18,6)"))).alias("executed_at"))
    kept = effective_steps(log, force=force, in_transaction=in_transaction)
    failed = log.where(~F.col("success")).count()  # before the old snapshot is replaced
    write_history(spark, hist.fold_history(kept, h), TABLE)
    return ("failed" if failed else "ok"), read_history(spark, TABLE).count()


def test_a_project_over_its_life(spark, tmpdir_path):
    spark.sql(f"DROP TABLE IF EXISTS {TABLE}")
    folder = tmpdir_path
    texts = {"V1_accounts.sql": "SELECT 'accounts'", "V2_ledger.sql": "SELECT 'ledger'"}
    for name, text in texts.items():
        _write(folder, name, text)

    # one version at a time, then nothing to do for that destination
    assert _run(spark, folder, 1, destination=1) == ("ok", 1)
    assert _run(spark, folder, 2, destination=1) == ("up_to_date", 1)

    # version 3 fails outside a transaction: 2 stays, 3 is recorded as failed and blocks what follows
    _write(folder, "V3_fees.sql", "SELECT 'fees' -- fails")
    assert _run(spark, folder, 3, in_transaction=False) == ("failed", 3)
    assert [(r.version, r.success) for r in read_history(spark, TABLE).orderBy("version").collect()] == [
        (1, True), (2, True), (3, False)]
    assert _run(spark, folder, 4)[0] == "blocked"

    # a repair that keeps the recorded success doesn't help, one that resets it does, with the new text
    _write(folder, "V3_fees.sql", "SELECT 'fees'")
    scripts, t = _scripts(spark, folder), _targets(spark)
    for reset, failing in ((False, 1), (True, 0)):
        h = read_history(spark, TABLE)
        write_history(spark, hist.repair(h, scripts, t, T0 + dt.timedelta(days=5), reset), TABLE)
        assert hist.failing(read_history(spark, TABLE)).count() == failing
    assert checks.drift(read_history(spark, TABLE), scripts, t).count() == 0

    # a renamed script is drift under its old description
    os.rename(os.path.join(folder, "V2_ledger.sql"), os.path.join(folder, "V2_book.sql"))
    renamed = _scripts(spark, folder)
    assert checks.gate(read_history(spark, TABLE), renamed, t).first().stage == 3
    assert [(r.version, r.reason) for r in checks.drift_detail(read_history(spark, TABLE), renamed, t).collect()] == [
        (2, "description")]
    os.rename(os.path.join(folder, "V2_book.sql"), os.path.join(folder, "V2_ledger.sql"))

    # version 4 and two DOWN scripts: down to 0 leaves what has none
    _write(folder, "V4_audit.sql", "SELECT 'audit'")
    for v, name in ((3, "fees"), (4, "audit")):
        _write(folder, f"V{v}_{name}.down.sql", f"SELECT 'no {name}'")
    assert _run(spark, folder, 6) == ("ok", 4)
    acts = pl.run_action(_targets(spark, True), read_history(spark, TABLE), _scripts(spark, folder, down=True))
    left = pl.missing_down(acts, _scripts(spark, folder, down=True), read_history(spark, TABLE))
    assert sorted(r.version for r in left.collect()) == [1, 2]
    assert _run(spark, folder, 7, down=True) == ("ok", 2)

    # destinations on the wrong side, and a transaction that leaves nothing of its run
    assert _run(spark, folder, 8, destination=1) == ("up_below_current", 2)
    assert _run(spark, folder, 9, down=True, destination=3) == ("down_above_current", 2)
    _write(folder, "V4_audit.sql", "SELECT 'audit' -- fails")
    assert _run(spark, folder, 10) == ("failed", 2)
    assert _run(spark, folder, 11, destination=3) == ("ok", 3)
