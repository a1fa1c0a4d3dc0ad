"""A history stored in buckets, published tables that gain columns, and repairs as changed rows only."""

import datetime as dt
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evolve import schemas
from evolve.operators import history as hist
from evolve.sources import tables

NOW = dt.datetime(2024, 5, 1)


def name():
    return f"t_{uuid.uuid4().hex}"


def log_of(spark, rows):
    return spark.createDataFrame(
        [(i, t, v, d, "d", f"m{v}", ok, NOW + dt.timedelta(seconds=i)) for i, (t, v, d, ok) in enumerate(rows)], schemas.LOG)


def files_of(spark, table):
    found = spark.table(table).select(tables.BUCKET, F.input_file_name().alias("f")).distinct().collect()
    return {b: sorted(r.f for r in found if r[0] == b) for b in {r[0] for r in found}}


def test_untouched_buckets_keep_their_files(spark):
    t = name()
    tables.ensure_bucketed_history(spark, t, 8)
    tables.ensure_bucketed_history(spark, t, 8)
    first = log_of(spark, [(i, 1, "UP", True) for i in range(200)])
    assert tables.apply_log(spark, first, t) == list(range(8))
    before = files_of(spark, t)
    second = log_of(spark, [(3, 2, "UP", False), (3, 1, "UP", True), (3, 9, "DOWN", False)])
    touched = tables.apply_log(spark, second, t)
    after = files_of(spark, t)
    assert len(touched) == 1 and {b for b in before if before[b] != after[b]} == set(touched)
    # readers at work on the old folders keep their files
    assert spark.read.parquet(*[f for fs in before.values() for f in fs]).count() == 200
    got = spark.table(t).drop(tables.BUCKET)
    both = hist.fold_history(second, hist.fold_history(first))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, both.select(got.columns).collect()), key=repr)
    # once more: nothing changes, an empty batch touches nothing
    tables.apply_log(spark, second, t)
    assert got.count() == both.count() and tables.apply_log(spark, second.limit(0), t) == []


def test_a_bucket_without_rows_goes(spark):
    t = name()
    tables.ensure_bucketed_history(spark, t, 4)
    tables.apply_log(spark, log_of(spark, [(7, 1, "UP", True)]), t)
    tables.apply_log(spark, log_of(spark, [(7, 1, "DOWN", True)]), t)
    assert spark.table(t).count() == 0 and spark.sql(f"SHOW PARTITIONS {t}").collect() == []
    tables.apply_log(spark, log_of(spark, [(7, 2, "DOWN", True)]), t)
    assert spark.table(t).count() == 0


def test_only_touched_buckets_are_read(spark):
    t = name()
    tables.ensure_bucketed_history(spark, t, 8)
    tables.apply_log(spark, log_of(spark, [(i, 1, "UP", True) for i in range(200)]), t)
    plan = spark.table(t).where(F.col(tables.BUCKET).isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(1 paths)" in plan


def test_other_tables_are_refused(spark):
    t = name()
    tables.ensure_history(spark, t)
    with pytest.raises(ValueError, match="ensure_bucketed_history"):
        tables.apply_log(spark, log_of(spark, [(1, 1, "UP", True)]), t)


def test_a_published_table_keeps_its_name_while_it_gains_columns(spark):
    t = name()
    tables.publish_table(spark, spark.range(3).select("id", F.lit("a").alias("x")), t)
    statements, sql = [], spark.sql
    spark.sql = lambda q, *a, **k: (statements.append(q), sql(q, *a, **k))[1]
    try:
        tables.publish_table(spark, spark.range(5).select(F.lit(1).alias("first"), "id", F.lit("b").alias("x"),
                                                          F.lit(2.5).alias("y")), t)
    finally:
        del spark.sql
    assert not any(q.startswith(f"DROP TABLE {t}") and not q.startswith(f"DROP TABLE {t}__") or "RENAME" in q for q in statements)
    assert spark.table(t).columns == ["id", "x", "first", "y"]
    assert sorted(map(tuple, spark.table(t).collect())) == [(i, "b", 1, 2.5) for i in range(5)]
    # a column that goes: the entry is replaced
    tables.publish_table(spark, spark.range(2), t)
    assert sorted(map(tuple, spark.table(t).collect())) == [(0,), (1,)]


SCRIPTS = st.lists(st.tuples(st.sampled_from("pq"), st.integers(1, 4), st.sampled_from("ab"), st.sampled_from("mn")),
                   max_size=8, unique_by=lambda s: s[:2])
STORED = st.lists(st.tuples(st.integers(1, 4), st.integers(1, 5), st.sampled_from("ab"), st.sampled_from("mn"), st.booleans()),
                  max_size=14, unique_by=lambda r: r[:2])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(scripts=SCRIPTS, stored=STORED, reset=st.booleans())
def test_changes_make_the_repair(spark, scripts, stored, reset):
    """The changed rows are those of the repair that differ, and put in place they give it."""
    s = spark.createDataFrame([(p, "UP", v, d, m) for p, v, d, m in scripts],
                              "project string, direction string, version int, description string, md5_checksum string")
    h = spark.createDataFrame([(t, v, d, m, ok, NOW, None) for t, v, d, m, ok in stored], schemas.HISTORY)
    t = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, "none")], "target_id long, project string")
    later = NOW + dt.timedelta(days=1)
    whole = sorted(map(tuple, hist.repair(h, s, t, later, reset).collect()), key=repr)
    changes = hist.repair_changes(h, s, t, later, reset)
    got = sorted(map(tuple, changes.collect()), key=repr)
    assert got == [r for r in whole if r not in set(map(tuple, h.collect()))]
    assert sorted(map(tuple, hist.apply_changes(h, changes).collect()), key=repr) == whole


def test_equal_targets_meet_no_script(spark):
    """Targets whose history is that of their project are told by fingerprint."""
    s = spark.createDataFrame([("p", "UP", v, "d", f"m{v}") for v in range(1, 6)],
                              "project string, direction string, version int, description string, md5_checksum string")
    rows = [(t, v, "d", f"m{v}", True, NOW, None) for t in range(50) for v in range(1, 6)]
    rows[7] = (1, 3, "d", "edited", True, NOW, None)
    h = spark.createDataFrame(rows, schemas.HISTORY)
    t = spark.range(50).select(F.col("id").alias("target_id"), F.lit("p").alias("project"))
    assert [r.target_id for r in hist.differing_targets(h, s, t).collect()] == [1]
    assert [(r.target_id, r.version) for r in hist.repair_changes(h, s, t, NOW).collect()] == [(1, 3)]
