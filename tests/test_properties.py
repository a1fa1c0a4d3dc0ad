"""Properties of the history operators on the derived fleet."""

from pyspark.sql import functions as F

from evolve import fixtures as fx
from evolve.operators import checks, history as hist
from conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fold_is_idempotent(spark):
    log = fx.log(spark, SF_SMALL)
    once = hist.fold_history(log)
    assert _rows(hist.fold_history(log, once)) == _rows(once)


def test_fold_of_batches_equals_fold_of_union(spark):
    log = fx.log(spark, SF_SMALL)
    parts = [log.where(F.dayofmonth("executed_at") < 10), log.where(F.dayofmonth("executed_at").between(10, 19)),
             log.where(F.dayofmonth("executed_at") >= 20)]
    h = None
    for p in parts:
        h = hist.fold_history(p, h)
    assert _rows(h) == _rows(hist.fold_history(log))


def test_repair_then_no_drift_and_no_failing(spark):
    h, s, t = fx.history(spark, SF_SMALL), fx.scripts(spark, SF_SMALL), fx.targets(spark, SF_SMALL)
    repaired = hist.repair(h, s, t, __import__("datetime").datetime(2024, 2, 1))
    assert checks.drift(repaired, s, t).count() == 0
    assert hist.failing(repaired).count() == 0


def test_fleet_result_equals_single_target_result(spark):
    h, s, t = fx.history(spark, SF_SMALL), fx.scripts(spark, SF_SMALL), fx.targets(spark, SF_SMALL)
    one = t.orderBy("target_id").first().target_id
    fleet = checks.status(h, s, t).where(F.col("target_id") == one)
    alone = checks.status(h.where(F.col("target_id") == one), s, t.where(F.col("target_id") == one))
    assert _rows(fleet) == _rows(alone)
