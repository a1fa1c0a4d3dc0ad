"""Version bitmaps: equal to the window over the rows, mergeable, exact at word borders."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evolve.operators import bitmaps, checks, history as hist

EDGES = [0, 1, 2, 62, 63, 64, 65, 127, 128, 129, 191, 192, 4095, 4096, 65534, 65535]
VERSIONS = st.one_of(st.sampled_from(EDGES), st.integers(0, 200))
ROWS = st.lists(st.tuples(st.integers(1, 4), VERSIONS, st.booleans()), max_size=60, unique_by=lambda r: r[:2])
SCHEMA = "target_id long, version int, success boolean"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def plain_gaps(rows):
    out = []
    for t in {r[0] for r in rows}:
        last = 0
        for v in sorted(v for u, v, _ in rows if u == t):
            if v != last + 1 and not (v == 1 and last == 0):
                out.append((t, last + 1, v - 1))
            last = v
    return sorted(out)


def words_in_python(rows):
    words = {}
    for t, v, ok in rows:
        p, s = words.get((t, v // 64), (0, 0))
        words[t, v // 64] = (p | 1 << v % 64, s | ok << v % 64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return sorted((*k, signed(p), signed(s)) for k, (p, s) in words.items())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, cut=st.integers(0, 60))
def test_words_gaps_and_merging(spark, rows, cut):
    h = spark.createDataFrame(rows, SCHEMA)
    words = bitmaps.version_words(h)
    assert rows_of(words) == words_in_python(rows)
    # two batches, also overlapping ones, merge into the words of their union
    batches = [bitmaps.version_words(spark.createDataFrame(b, SCHEMA)) for b in (rows[:cut], rows[max(0, cut - 3):])]
    assert rows_of(bitmaps.merge_words(*batches)) == words_in_python(rows)
    assert rows_of(bitmaps.history_gap_ranges(words)) == plain_gaps(rows)
    counted = bitmaps.word_lists(words).select("target_id", bitmaps.n_gaps(F.col("words")).alias("n"),
                                               bitmaps.latest_of(F.col("words")).alias("latest"))
    gaps = plain_gaps(rows)
    assert rows_of(counted) == sorted(
        (t, sum(g[0] == t for g in gaps), max((v for u, v, ok in rows if u == t and ok), default=0))
        for t in {r[0] for r in rows})


def test_gaps_equal_the_window(spark):
    """The same ranges as the window over history rows, every target checked."""
    rows = [(t, v, (t * v) % 5 != 0) for t in range(1, 30) for v in range(0 if t % 3 else 1, 300) if (t * 7 + v * v) % 6]
    h = spark.createDataFrame(rows, SCHEMA)
    targets = h.select("target_id", F.lit("p").alias("project")).distinct()
    scripts = spark.createDataFrame([("p", "UP", 1)], "project string, direction string, version int")
    assert rows_of(bitmaps.history_gap_ranges(bitmaps.version_words(h))) == rows_of(
        checks.history_gap_ranges(h, scripts, targets))
    assert rows_of(bitmaps.latest_versions(bitmaps.version_words(h), targets)) == rows_of(hist.latest_version(h, targets))


def test_range_mask(spark):
    cases = [(w, lo, hi) for w in (0, 1, 2) for lo in (-1, 0, 5, 62, 63, 64, 127, 200) for hi in (0, 1, 63, 64, 65, 127, 128, 191)]
    df = spark.createDataFrame(cases, "word int, lo int, hi int")
    got = df.select("word", "lo", "hi", bitmaps.versions_of(
        F.col("word"), bitmaps.range_mask(F.col("word"), F.col("lo"), F.col("hi"))).alias("v")).collect()
    for r in got:
        assert r.v == [v for v in range(r.word * 64, r.word * 64 + 64) if r.lo < v <= r.hi], r


def test_summary_has_no_window(spark):
    rows = [(1, 1, "a", "m", True), (1, 3, "a", "m", True)]
    h = spark.createDataFrame(rows, "target_id long, version int, description string, md5_checksum string, success boolean")
    t = spark.createDataFrame([(1, "p")], "target_id long, project string")
    s = spark.createDataFrame([("p", "UP", 1, "a", "m")], "project string, direction string, version int, "
                                                         "description string, md5_checksum string")
    df = checks.status(h, s, t)
    assert [tuple(r) for r in df.collect()] == [(1, 3, 2, 0)]
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
