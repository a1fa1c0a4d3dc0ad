"""fold_history equals applying the log one event at a time, in
(executed_at, event_id) order, to the stored history."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from evolve.operators.history import fold_history

T0 = dt.datetime(2024, 1, 1)
HIST = ("target_id long, version int, description string, md5_checksum string, success boolean, "
        "executed_at timestamp_ntz, repaired_at timestamp_ntz")
LOG = ("event_id long, target_id long, version int, direction string, description string, "
       "md5_checksum string, success boolean, executed_at timestamp_ntz")


def model(base, events):
    state = {(r[0], r[1]): list(r[2:]) for r in base}
    for e in sorted(events, key=lambda e: (e[7], e[0])):
        key, direction, ok = (e[1], e[2]), e[3], e[6]
        if direction == "UP":
            repaired = state[key][4] if key in state else None
            state[key] = [e[4], e[5], ok, e[7], repaired]
        elif ok:
            state.pop(key, None)
    return sorted((k[0], k[1], *v) for k, v in state.items())


KEYS = st.tuples(st.integers(1, 3), st.integers(1, 4))
EVENT = st.tuples(KEYS, st.sampled_from(["UP", "UP", "DOWN"]), st.sampled_from(["a", "b"]),
                  st.sampled_from(["m1", "m2"]), st.booleans(), st.integers(0, 5))


@settings(max_examples=15, deadline=None)
@given(st.lists(EVENT, max_size=40), st.lists(st.tuples(KEYS, st.booleans(), st.booleans()), max_size=6))
def test_fold_matches_sequential_model(spark, raw_events, raw_base):
    base = {}
    for (t, v), ok, repaired in raw_base:
        base[(t, v)] = (t, v, "old", "m0", ok, T0, T0 + dt.timedelta(days=9) if repaired else None)
    events = [(i, t, v, d, desc, md5, ok, T0 + dt.timedelta(hours=h))
              for i, ((t, v), d, desc, md5, ok, h) in enumerate(raw_events)]
    h = spark.createDataFrame(list(base.values()), HIST)
    log = spark.createDataFrame(events, LOG)
    got = sorted(tuple(r) for r in fold_history(log, h).collect())
    assert got == model(base.values(), events)


def effective_model(events, force, in_transaction):
    runs = {}
    for e in events:
        runs.setdefault((e[1], e[7].date()), []).append(e)
    kept = []
    for evs in runs.values():
        evs = sorted(evs, key=lambda e: (e[7], e[0]))
        if in_transaction:
            kept += [] if any(not e[6] for e in evs) else evs
        elif force:
            kept += evs
        else:
            for e in evs:
                kept.append(e)
                if not e[6]:
                    break
    return sorted(e[0] for e in kept)


@settings(max_examples=10, deadline=None)
@given(st.lists(EVENT, max_size=40), st.booleans(), st.booleans())
def test_effective_steps_match_model(spark, raw_events, force, in_transaction):
    from evolve.plans.effects import effective_steps
    events = [(i, t, v, d, desc, md5, ok, T0 + dt.timedelta(hours=h * 7))
              for i, ((t, v), d, desc, md5, ok, h) in enumerate(raw_events)]
    log = spark.createDataFrame(events, LOG)
    got = sorted(r.event_id for r in effective_steps(log, force, in_transaction).collect())
    assert got == effective_model(events, force, in_transaction)


def repair_model(base, scripts, now, reset):
    state = {(r[0], r[1]): list(r[2:]) for r in base}
    for target in (1, 2, 3):
        for v, desc, md5 in scripts:
            key = (target, v)
            if key not in state:
                state[key] = [desc, md5, True, now, now]
            else:
                d0, m0, ok, ex, rep = state[key]
                changed = desc != d0 or md5 != m0
                state[key] = [desc, md5, True if reset else ok, ex, now if changed else rep]
    return sorted((k[0], k[1], *v) for k, v in state.items())


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(KEYS, st.sampled_from(["a", "b"]), st.sampled_from(["m1", "m2"]), st.booleans(),
                          st.booleans()), max_size=8, unique_by=lambda x: x[0]),
       st.lists(st.tuples(st.integers(1, 5), st.sampled_from(["a", "b"]), st.sampled_from(["m1", "m2"])),
                max_size=5, unique_by=lambda x: x[0]),
       st.booleans())
def test_repair_matches_model(spark, raw_base, raw_scripts, reset):
    from evolve.operators.history import repair
    now = T0 + dt.timedelta(days=30)
    base = [(t, v, d, m, ok, T0, T0 + dt.timedelta(days=1) if rep else None)
            for (t, v), d, m, ok, rep in raw_base]
    h = spark.createDataFrame(base, HIST)
    s = spark.createDataFrame([("p", "UP", v, d, m) for v, d, m in raw_scripts],
                              "project string, direction string, version int, description string, md5_checksum string")
    t = spark.createDataFrame([(i, "p") for i in (1, 2, 3)], "target_id long, project string")
    got = sorted(tuple(r) for r in repair(h, s, t, now, reset_success=reset).collect())
    assert got == repair_model(base, raw_scripts, now, reset)
