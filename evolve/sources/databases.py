"""The histories of many live databases as one DataFrame (S3).

One task per group of databases: the executors connect, each task to its own
databases, and only the driver knows their whole list; a task gets the entries
of its group, so that tasks don't grow with the fleet.  A database that can't be read doesn't end the job: it gives one
row with its error, so a fleet's import says which databases it lacks.

``connect(source)`` is called on the executors.  It gets one entry of
``sources`` and gives the rows of that database's history table as tuples
(version, description, md5_checksum, success, executed_at, repaired_at), in
any order.  It travels by value if it is defined in a function or in the main
script, else its module must be there on the executors.  With psycopg it would be

    def connect(source):
        with psycopg.connect(source["dsn"]) as c, c.cursor("history") as rows:
            rows.execute("SELECT version, description, md5_checksum, success, executed_at, repaired_at FROM history")
            yield from rows
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evolve import schemas

IMPORT = T.StructType([T.StructField(f.name, f.dataType, True) for f in schemas.HISTORY.fields]
                      + [T.StructField("error", T.StringType(), True)])


def _reader(connect: Callable[[Any], Iterable[tuple]]):
    """What a task does with its group of databases.  Made here so that it
    travels to the executors by value, whatever is installed there."""
    def read(group: Iterable[tuple[int, Any]]) -> Iterable[tuple]:
        for target_id, source in group:
            try:
                # a database counts whole or not at all: its rows (at most one a version) are held until read
                rows = [(target_id, *row, None) for row in connect(source)]
            except Exception as cause:  # whatever the caller's driver raises is that database's result
                rows = [(target_id, *[None] * 6, f"{type(cause).__name__}: {cause}")]
            yield from rows
    return read


def read_histories(spark: SparkSession, sources: list[tuple[int, Any]], connect: Callable[[Any], Iterable[tuple]],
                   per_partition: int = 1) -> DataFrame:
    """All histories in one scan: the history columns and ``error`` (then all
    but ``target_id`` are null).  ``sources``: (target_id, what ``connect``
    takes) per database, ``per_partition`` of them to a task."""
    if per_partition < 1:
        raise ValueError("a partition reads one database at least")
    if not sources:
        return spark.createDataFrame([], IMPORT)
    groups = [sources[i:i + per_partition] for i in range(0, len(sources), per_partition)]
    read = _reader(connect)
    rows = spark.sparkContext.parallelize(groups, len(groups)).flatMap(read)
    return spark.createDataFrame(rows, IMPORT)


def imported_history(imported: DataFrame) -> DataFrame:
    """The history rows of an import."""
    return imported.where(F.col("error").isNull()).select(*[f.name for f in schemas.HISTORY.fields])


def failed_databases(imported: DataFrame) -> DataFrame:
    """``target_id, error`` of the databases that couldn't be read."""
    return imported.where(F.col("error").isNotNull()).select("target_id", "error")
