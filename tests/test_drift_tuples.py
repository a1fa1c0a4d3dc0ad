"""Drift by distinct tuples: the history stays where it is, hot tuples are dealt out."""

import re

import pytest
from pyspark.sql import functions as F

from evolve.operators import checks
from evolve.plans import planning as pl

HISTORY = "target_id long, version int, description string, md5_checksum string, success boolean"


def fleet(spark, n):
    """n targets; version 1 as in the scripts, version 2 edited on every target, version 3 failed and edited."""
    ids = spark.range(n).withColumnRenamed("id", "target_id")
    row = lambda v, d, m, ok: F.struct(F.lit(v).alias("version"), F.lit(d).alias("description"),
                                       F.lit(m).alias("md5_checksum"), F.lit(ok).alias("success"))
    rows = F.array(row(1, "a", "m1", True), row(2, "b", "edited", True), row(3, "c", "edited", False))
    h = ids.select("target_id", F.explode(rows).alias("r")).select("target_id", "r.*")
    t = ids.select("target_id", F.lit("p").alias("project"))
    s = spark.createDataFrame([("p", "UP", v, d, f"m{v}") for v, d in ((1, "a"), (2, "b"), (3, "c"))],
                              "project string, direction string, version int, description string, md5_checksum string")
    return h, s, t


def exchanged_on_tuples(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"hashpartitioning\([^)]*md5_checksum[^)]*\)", plan)


def test_one_tuple_on_a_million_targets(spark):
    h, s, t = fleet(spark, 1_000_000)
    bad = checks.bad_tuples(h, s, t)
    assert [tuple(r) for r in bad.collect()] == [("p", 2, "b", "edited", "checksum")]
    d = checks.drift(h, s, t)
    assert exchanged_on_tuples(d) == []
    per_task = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 1_000_000 and max(per_task) < 1.2 * sum(per_task) / len(per_task) and len(per_task) >= 4


@pytest.mark.parametrize("operator", [checks.drift, checks.drift_detail, checks.status, checks.gate, checks.gate_problems])
def test_history_is_not_exchanged_on_tuples(spark, operator):
    df = operator(*fleet(spark, 100))
    df.collect()
    assert exchanged_on_tuples(df) == []


def test_many_bad_tuples_meet_by_salt(spark, monkeypatch):
    """Beyond the size that is sent to the rows: the same result, a hot tuple over several tasks."""
    h, s, t = fleet(spark, 20_000)
    want = sorted(map(tuple, checks.drift_detail(h, s, t).collect()))
    monkeypatch.setattr(checks, "BROADCAST_TUPLES", 0)
    d = checks.drift_detail(h, s, t)
    assert "_salt" in exchanged_on_tuples(d)[0]
    assert sorted(map(tuple, d.collect())) == want
    status = sorted(map(tuple, checks.status(h, s, t).collect()))
    assert status == [(i, 2, 1, 1) for i in range(20_000)]


def test_load_failure_comes_through_the_gate_alone(spark):
    """A gate that stopped at the load is no pass: the run fails to load."""
    h, s, t = fleet(spark, 2)
    t = t.select("*", F.lit(False).alias("down"), F.lit(None).cast("int").alias("destination"))
    invalid = spark.createDataFrame([("p", "out of range")], "project string, message string")
    g = checks.gate(h.where("false"), s, t, invalid)
    assert {r.stage for r in g.collect()} == {checks.STAGE_LOAD}
    acts = pl.run_action(t, h.where("false"), s, gate=g)
    assert {r.action for r in acts.collect()} == {"load_failed"}
    assert checks.problems(h, s, t, invalid).where("kind = 'load'").count() == 2
