"""Positions by counting sort: equal to one window, also where a value is cut
into ranges; nothing runs and nothing is written when the plan is built."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from evolve.functions import ranking
from evolve.functions.ranking import rank_by_counts
from evolve.operators import scripts as scr

SCHEMA = "g string, v int, path string"


def expected(df, by, value, tie):
    order = Window.partitionBy(*by).orderBy(value, tie)
    return sorted(map(tuple, df.withColumn("pos", F.row_number().over(order)).collect()))


def test_a_hot_value_is_cut_and_equals_a_window(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"),
        F.when(F.col("id") % 4 == 0, F.col("id") % 50).otherwise(7).cast("int").alias("v"),
        F.concat(F.lit("/long/common/prefix/"), F.md5(F.col("id").cast("string"))).alias("path"))
    got = rank_by_counts(df, ["g"], "v", "path", "pos", many=500)
    assert sorted(map(tuple, got.collect())) == expected(df, ["g"], "v", "path")


def test_ranges_of_a_hot_value_are_even(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("g").alias("g"), F.lit(1).alias("v"),
                               F.format_string("/scripts/%09d.sql", "id").alias("path"))
    got = rank_by_counts(df, ["g"], "v", "path", "pos", many=1000)
    assert got.where(F.substring("path", 10, 9).cast("int") + 1 != F.col("pos")).count() == 0
    cut = (df.groupBy(F.pmod(F.xxhash64("path"), F.lit(ranking.CELLS)).alias("c"))
           .agg(F.min_by("path", F.xxhash64(F.lit(1), F.col("path"))).alias("p")))
    cuts = df.crossJoin(F.broadcast(cut.agg(F.sort_array(F.collect_set("p")).alias("cuts"))))
    largest = (cuts.groupBy(ranking._cuts_up_to(F.col("cuts"), F.col("path")).alias("piece")).count()
               .agg(F.max("count")).first()[0])
    assert largest < 20 * n / ranking.CELLS


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-3, 3), st.text("xyz/é", max_size=3)), max_size=40),
       st.integers(0, 5))
def test_random_rows_with_ties_equal_a_window(spark, rows, many):
    df = spark.createDataFrame(rows, SCHEMA)
    got = rank_by_counts(df, ["g"], "v", "path", "pos", many=many)
    assert sorted(map(tuple, got.collect())) == expected(df, ["g"], "v", "path")


@pytest.mark.parametrize("many", [0, 1 << 16])
def test_null_and_repeated_paths_are_kept(spark, many):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, "p"), ("a", 1, "p"), ("a", 0, "q")], SCHEMA)
    got = rank_by_counts(df, ["g"], "v", "path", "pos", many=many)
    assert sorted((r.pos, r.path) for r in got.collect()) == [(1, "q"), (2, None), (3, "p"), (4, "p")]


def test_nothing_runs_when_the_order_is_built(spark):
    df = spark.createDataFrame([("p", "UP", 2, "b"), ("p", "UP", 1, "a"), ("p", "DOWN", 1, "c"), ("p", "DOWN", 2, "d")],
                               "project string, direction string, version int, path string")
    spark.sparkContext.setJobGroup("order-built", "")
    try:
        ordered = scr.ordered_scripts(df)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("order-built")) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert sorted((r.direction, r.position, r.version) for r in ordered.collect()) == [
        ("DOWN", 1, 2), ("DOWN", 2, 1), ("UP", 1, 1), ("UP", 2, 2)]
