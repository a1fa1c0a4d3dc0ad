"""The one-pass classifier equals matching the eleven fixed patterns one by one."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evolve.functions.classify import PATTERNS, kind_of

PREFIXES = ["V", "R", "B", "BE", "BV", "A", "AE", "AV", "X", "", "v", "BVV"]
PIECES = ["0", "1", "007", "70000", "255", "256", "_", "x", "a_b", ".", ".down", ".sql", ".template",
          "lang", "9", "-", " "]


def expected(name):
    hits = [k for k, p in PATTERNS.items() if re.search(p, name)]
    assert len(hits) <= 1
    return hits[0] if hits else None


names = st.builds(lambda p, parts: p + "".join(parts), st.sampled_from(PREFIXES),
                  st.lists(st.sampled_from(PIECES), max_size=7))


@settings(max_examples=20, deadline=None)
@given(st.lists(names, min_size=50, max_size=200))
def test_kind_matches_patterns(spark, batch):
    batch = batch + ["V001_a.sql", "V001_a.down.sql", "BV001_002_x.sql", "BV001_x.sql", "AV1_2_3_x.sql",
                     "a.template.sql", "V001_x.template.sql", "R01_x.down.sql", "B001_x.down.sql"]
    df = spark.createDataFrame([(n,) for n in batch], "name string")
    got = {r.name: r.kind for r in df.select("name", kind_of(F.col("name")).alias("kind")).collect()}
    for n in batch:
        assert got[n] == expected(n), n


def test_rank_by_sort_equals_window_on_a_hot_group(spark):
    from pyspark.sql import Window
    from evolve.functions.ranking import rank_by_id, rank_by_sort
    df = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"),
        (F.col("id") % 7).alias("k"), F.format_string("p%09d", F.col("id")).alias("path"), "id")
    ref = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("k", "path")))
    got = rank_by_sort(df, ["g"], ["k", "path"], "pos")
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0
    ref_id = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    got_id = rank_by_id(df, ["g"], "id", "pos", bucket_width=1000)
    assert got_id.exceptAll(ref_id).count() == 0 and ref_id.exceptAll(got_id).count() == 0
