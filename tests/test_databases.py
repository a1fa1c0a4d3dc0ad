"""Import of many databases' histories, with a connection function over Parquet folders."""

import datetime as dt
import os

import pytest

from evolve import schemas
from evolve.operators import history as hist
from evolve.sources import databases

AT = dt.datetime(2024, 3, 1, 12, 0, 0, 123456)


def reader():
    """The connection function, made here so that it travels by value."""
    def from_parquet(source):
        import pyarrow.parquet as pq
        if source == "down":
            raise ConnectionError("no route to host")
        for row in pq.read_table(source).to_pylist():
            yield tuple(row[c] for c in ("version", "description", "md5_checksum", "success", "executed_at", "repaired_at"))
        if "broken" in source:
            raise OSError("connection lost")
    return from_parquet


def store(folder, name, rows):
    import pyarrow as pa
    import pyarrow.parquet as pq
    names = ["version", "description", "md5_checksum", "success", "executed_at", "repaired_at"]
    path = os.path.join(folder, name)
    types = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.timestamp("us"), pa.timestamp("us")]
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=names), path)
    return path


def test_import_with_failing_databases(spark, tmpdir_path):
    rows = {t: [(v, f"d{v}", f"m{t}", v % 2 == 0, AT, None if v % 3 else AT) for v in range(1, t + 1)] for t in range(6)}
    sources = [(t, store(tmpdir_path, f"{t}.parquet", r)) for t, r in rows.items()]
    sources += [(100, "down"), (101, store(tmpdir_path, "broken.parquet", rows[3])), (102, "/nowhere.parquet")]
    for per_partition in (1, 4):
        got = databases.read_histories(spark, sources, reader(), per_partition)
        assert got.rdd.getNumPartitions() == -(-len(sources) // per_partition)
        h = databases.imported_history(got)
        assert h.columns == [f.name for f in schemas.HISTORY.fields]
        assert sorted(map(tuple, h.collect()), key=repr) == sorted(
            ((t, *r) for t, rs in rows.items() for r in rs), key=repr)
        failed = {r.target_id: r.error for r in databases.failed_databases(got).collect()}
        assert set(failed) == {100, 101, 102}
        # a database that breaks off counts as not read
        assert failed[100] == "ConnectionError: no route to host" and failed[101] == "OSError: connection lost"
    # an imported fleet is a history like any other
    targets = spark.createDataFrame([(t,) for t in rows], "target_id long")
    assert {r.target_id: r.latest_version for r in hist.latest_version(h, targets).collect()} == {
        t: max((v for v in range(1, t + 1) if v % 2 == 0), default=0) for t in rows}


def test_a_thousand_databases_are_one_scan(spark):
    at = AT
    got = databases.read_histories(spark, [(i, i) for i in range(1000)], lambda s: [(1, "d", "m", True, at, None)], 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Union" not in plan
    assert got.count() == 1000 and got.rdd.getNumPartitions() == 20


def sources_that_tell(folder, n):
    """Sources that leave a file wherever they are unpacked; made here so that they travel by value."""
    def unpacked(i):
        import uuid
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return Source(i)

    class Source:
        def __init__(self, i):
            self.i = i

        def __reduce__(self):
            return unpacked, (self.i,)
    return [(i, Source(i)) for i in range(n)]


def test_a_task_gets_its_own_databases_only(spark, tmpdir_path):
    at = AT
    got = databases.read_histories(spark, sources_that_tell(tmpdir_path, 24), lambda s: [(s.i, "d", "m", True, at, None)], 2)
    assert sorted((r.target_id, r.version) for r in got.collect()) == [(i, i) for i in range(24)]
    assert len(os.listdir(tmpdir_path)) <= 2 * 24  # packed and unpacked with its own task


def test_no_database(spark):
    got = databases.read_histories(spark, [], reader())
    assert got.collect() == [] and databases.imported_history(got).columns == [f.name for f in schemas.HISTORY.fields]
    with pytest.raises(ValueError, match="one database"):
        databases.read_histories(spark, [(1, 1)], reader(), 0)
