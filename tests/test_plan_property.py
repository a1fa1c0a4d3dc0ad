"""plan_up equals a model of an up run: BEFORE hooks; per pending script in
(version, file name) order: REPEATABLE (above version 1), BEFORE_EACH,
BEFORE_VERSION of that version, the script, AFTER_VERSION, AFTER_EACH;
then AFTER hooks.  Hooks of one type by (order, name)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from evolve.plans import planning as pl

TYPES = ["BEFORE", "BEFORE_EACH", "BEFORE_VERSION", "AFTER_VERSION", "AFTER_EACH", "AFTER", "REPEATABLE"]


def model(scripts, hooks, latest, destination):
    def of(kind, version=None):
        """Names of the hooks of one type, by (order, name); versioned types
        only those of ``version``."""
        return [n for _, n in sorted((o, n) for t, o, v, n in hooks
                                     if t == kind and (v is None or v == version))]
    out = [("BEFORE", None, n) for n in of("BEFORE")]
    for v, name in sorted(scripts):
        if not latest < v <= destination:
            continue
        if v > 1:
            out += [("REPEATABLE", v, n) for n in of("REPEATABLE")]
        out += [("BEFORE_EACH", v, n) for n in of("BEFORE_EACH")]
        out += [("BEFORE_VERSION", v, n) for n in of("BEFORE_VERSION", v)]
        out.append(("UP", v, name))
        out += [("AFTER_VERSION", v, n) for n in of("AFTER_VERSION", v)]
        out += [("AFTER_EACH", v, n) for n in of("AFTER_EACH")]
    return out + [("AFTER", None, n) for n in of("AFTER")]


SCRIPT = st.tuples(st.integers(1, 6), st.sampled_from(["a", "b"]))
HOOK = st.tuples(st.sampled_from(TYPES), st.integers(1, 3), st.integers(1, 6), st.sampled_from(["h1", "h2", "h3"]))
TARGET = st.tuples(st.integers(0, 6), st.integers(0, 7))


@settings(max_examples=10, deadline=None)
@given(st.lists(SCRIPT, min_size=1, max_size=8, unique=True), st.lists(HOOK, max_size=8),
       st.lists(TARGET, min_size=1, max_size=5))
def test_plan_up_matches_model(spark, raw_scripts, raw_hooks, raw_targets):
    scripts = [(v, f"V{v:03d}_{d}.sql") for v, d in raw_scripts]
    hooks = [(t, o, v if t.endswith("_VERSION") else None, f"{t}_{n}") for t, o, v, n in raw_hooks]
    hooks = list({(t, v, n): (t, o, v, n) for t, o, v, n in hooks}.values())  # one file per name
    targets = [(i, lat, lat + extra) for i, (lat, extra) in enumerate(raw_targets)]
    s = spark.createDataFrame([("p", "UP", v, "d", n, "m") for v, n in scripts],
                              "project string, direction string, version int, description string, "
                              "file_name string, md5_checksum string")
    h = spark.createDataFrame([("p", t, o, v, n, "") for t, o, v, n in hooks],
                              "project string, hook_type string, hook_order int, hook_version int, "
                              "file_name string, content string")
    acts = spark.createDataFrame([(i, "p", False, lat, dest, "run") for i, lat, dest in targets],
                                 "target_id long, project string, down boolean, latest_version int, "
                                 "destination int, action string")
    rows = pl.plan_up(acts, s, h).collect()
    for i, lat, dest in targets:
        got = [(r.kind, r.version, r.name) for r in sorted((r for r in rows if r.target_id == i),
                                                             key=lambda r: r.step)]
        assert got == model(scripts, hooks, lat, dest), (i, lat, dest)


def down_model(scripts, hooks, latest, destination):
    rd = [n for _, n in sorted((o, n) for t, o, v, n in hooks if t == "REPEATABLE_DOWN")]
    out = []
    for v, name in sorted(scripts, key=lambda s: (-s[0], s[1])):
        if not destination < v <= latest:
            continue
        out.append(("DOWN", v, name))
        if v > destination + 1:
            out += [("REPEATABLE_DOWN", v, n) for n in rd]
    return out


@settings(max_examples=10, deadline=None)
@given(st.lists(SCRIPT, min_size=1, max_size=8, unique=True),
       st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["r1", "r2"])), max_size=3, unique_by=lambda x: x[1]),
       st.lists(TARGET, min_size=1, max_size=5))
def test_plan_down_matches_model(spark, raw_scripts, raw_hooks, raw_targets):
    scripts = [(v, f"V{v:03d}_{d}.down.sql") for v, d in raw_scripts]
    hooks = [("REPEATABLE_DOWN", o, None, n) for o, n in raw_hooks]
    targets = [(i, lat + extra, lat) for i, (lat, extra) in enumerate(raw_targets)]  # latest >= destination
    s = spark.createDataFrame([("p", "DOWN", v, "d", n, None) for v, n in scripts],
                              "project string, direction string, version int, description string, "
                              "file_name string, md5_checksum string")
    h = spark.createDataFrame([("p", t, o, v, n, "") for t, o, v, n in hooks],
                              "project string, hook_type string, hook_order int, hook_version int, "
                              "file_name string, content string")
    acts = spark.createDataFrame([(i, "p", True, lat, dest, "run") for i, lat, dest in targets],
                                 "target_id long, project string, down boolean, latest_version int, "
                                 "destination int, action string")
    rows = pl.plan_down(acts, s, h).collect()
    for i, lat, dest in targets:
        got = [(r.kind, r.version, r.name) for r in sorted((r for r in rows if r.target_id == i),
                                                             key=lambda r: r.step)]
        assert got == down_model(scripts, hooks, lat, dest), (i, lat, dest)
