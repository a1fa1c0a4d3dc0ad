"""Gap checks equal the reference's validation loop: expected starts at 1,
each version must equal it, then expected = version + 1."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from evolve.operators import checks


def loop(versions):
    out, expected = [], 1
    for v in sorted(versions):
        if v != expected:
            out.append((expected, v))
        expected = v + 1
    return sorted(out)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=10), min_size=1, max_size=5))
def test_local_gaps_match_loop(spark, projects):
    rows = [(f"p{i}", "UP", v, f"p{i}/f{j}.sql") for i, vs in enumerate(projects) for j, v in enumerate(vs)]
    s = spark.createDataFrame(rows, "project string, direction string, version int, path string")
    got = {}
    for r in checks.local_gaps(s).collect():
        got.setdefault(r.project, []).append((r.expected, r.got))
    for i, vs in enumerate(projects):
        assert sorted(got.get(f"p{i}", [])) == loop(vs)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sets(st.integers(1, 12), max_size=8), min_size=1, max_size=5))
def test_history_gaps_match_loop(spark, targets):
    t0 = dt.datetime(2024, 1, 1)
    h = spark.createDataFrame([(i, v, "d", "m", v % 3 != 0, t0, None) for i, vs in enumerate(targets) for v in vs],
                              "target_id long, version int, description string, md5_checksum string, "
                              "success boolean, executed_at timestamp_ntz, repaired_at timestamp_ntz")
    s = spark.createDataFrame([("p", "UP", 1, "d", "m")],
                              "project string, direction string, version int, description string, md5_checksum string")
    t = spark.createDataFrame([(i, "p") for i in range(len(targets))], "target_id long, project string")
    got = {}
    for r in checks.history_gap_ranges(h, s, t).collect():
        got.setdefault(r.target_id, []).append((r.gap_from, r.gap_to + 1))
    for i, vs in enumerate(targets):
        assert sorted(got.get(i, [])) == loop(vs)
