"""History tables and published tables in the session catalog.

Parquet tables cannot be updated in place (Spark rejects UPDATE / DELETE /
MERGE on them), so a new history is written as a whole new snapshot into its
own folder, and the table is then pointed at that folder in one catalog
statement.  ``ensure_bucketed_history`` / ``apply_log`` keep a history in
buckets of targets instead, each with its own folder: a log batch rewrites the
buckets that it touches and no other.  ``buckets`` stores the history
bucketed and sorted by ``target_id``: later gap windows, latest / status
aggregates and joins on ``target_id`` then read co-partitioned data and skip
their shuffle.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evolve import schemas
from evolve.operators.history import last_outcomes, merge_outcomes
from evolve.session import checkpoint_dir


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def read_history(spark: SparkSession, table: str) -> DataFrame:
    """The stored history; an absent table reads as an empty history (latest
    version 0, nothing failing, nothing to validate)."""
    if spark.catalog.tableExists(table):
        return spark.table(table)
    return spark.createDataFrame([], schemas.HISTORY)


def _snapshot_root(spark: SparkSession, table: str) -> str:
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    return f"{warehouse.rstrip('/')}/{table}__snapshots"


def _new_snapshot_path(spark: SparkSession, table: str) -> str:
    stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    return f"{_snapshot_root(spark, table)}/snapshot={stamp}-{uuid.uuid4().hex[:8]}"


def _table_info(spark: SparkSession, table: str) -> dict:
    return {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}


def ensure_history(spark: SparkSession, table: str, buckets: int | None = None) -> None:
    """Create the history table if it does not exist (idempotent).  It is an
    external table over a snapshot folder, so later snapshots can be swapped
    in by pointing the table at a new folder."""
    clustered = (f" CLUSTERED BY (target_id) SORTED BY (target_id, version) INTO {buckets} BUCKETS"
                 if buckets else "")
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({_ddl(schemas.HISTORY)}) USING parquet{clustered} "
                  f"LOCATION '{_new_snapshot_path(spark, table)}'")


def _swap_in(spark: SparkSession, df: DataFrame, table: str, buckets: int | None, sort_cols: list[str]) -> None:
    """Write ``df`` completely into a new snapshot folder, then make ``table``
    point at it with one catalog statement.

    Until that statement the old snapshot is the table; a failed or killed job
    leaves it untouched.  Old snapshot folders stay in place, so readers still
    running on them do not lose their files (a retention job may remove them).
    ``buckets=None`` keeps the table's current bucketing.

    New columns, the normal case of a migrated table, are added to the table
    (at its end, where old files read as null) before it is pointed at the new
    folder, so the name is always there.  Only another bucketing, or a column
    that went or changed its type, replaces the catalog entry by dropping and
    renaming.
    """
    staging = f"{table}__staging"
    exists = spark.catalog.tableExists(table)
    info = _table_info(spark, table) if exists else {}
    if exists and info.get("Type") != "EXTERNAL":
        raise ValueError(f"{table} is a managed table: replacing it would delete its files under its readers")
    current = int(info.get("Num Buckets") or 0) if exists else 0
    if buckets is None:
        buckets = current or None
    spark.sql(f"DROP TABLE IF EXISTS {staging}")
    if exists:
        old = spark.table(table).schema
        kept = [f.name for f in old.fields if f.name in df.columns]
        df = df.select(*kept, *[c for c in df.columns if c not in kept])
    w = df.write.mode("overwrite").format("parquet").option("path", _new_snapshot_path(spark, table))
    if buckets:
        w = w.bucketBy(buckets, sort_cols[0]).sortBy(*sort_cols)
    w.saveAsTable(staging)
    if not exists:
        spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")
    elif current == (buckets or 0) and _is_prefix(old, spark.table(staging).schema):
        path = _table_info(spark, staging)["Location"]
        gained = spark.table(staging).schema.fields[len(old.fields):]
        if gained:
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({_ddl(T.StructType(gained))})")
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
        spark.sql(f"DROP TABLE {staging}")  # external: the files now belong to the table
    else:
        # a new bucket layout, or columns that went: replace the catalog entry
        spark.sql(f"DROP TABLE {table}")
        spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")
    spark.catalog.refreshTable(table)


def _is_prefix(old: T.StructType, new: T.StructType) -> bool:
    shape = lambda s: [(f.name, f.dataType) for f in s.fields]
    return shape(new)[:len(old.fields)] == shape(old)


def write_history(spark: SparkSession, df: DataFrame, table: str, buckets: int | None = None) -> None:
    """Replace the history with ``df`` (which may be computed from it): a new
    snapshot is written in full, then swapped in (see :func:`_swap_in`)."""
    _swap_in(spark, df.select(*[f.name for f in schemas.HISTORY.fields]), table, buckets,
             ["target_id", "version"])


def publish_table(spark: SparkSession, df: DataFrame, table: str) -> None:
    """Write a migrated table once, all or nothing for this table: the new
    snapshot becomes the table only after every task of the write succeeded."""
    _swap_in(spark, df, table, None, [])


def publisher(spark: SparkSession, table: str):
    """``publish`` callback for :func:`evolve.plans.migrate.migrate_table`: write
    the table after every version (the non-transactional mode) and go on from
    the written files.  ``publish.rows`` holds the rows written per version,
    counted by the write job itself."""
    def publish(df: DataFrame, version: int) -> DataFrame:
        counted = Observation()
        publish_table(spark, df.observe(counted, F.count(F.lit(1)).alias("rows")), table)
        publish.rows[version] = counted.get["rows"]
        return spark.read.parquet(_table_info(spark, table)["Location"])
    publish.rows = {}
    return publish


BUCKET = "bucket"
BUCKETS = "evolve.buckets"


def ensure_bucketed_history(spark: SparkSession, table: str, buckets: int = 64, location: str | None = None) -> None:
    """Create a history table in ``buckets`` buckets of targets, if it does not
    exist: partitions by a hash of ``target_id``, each in a folder of its own."""
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({_ddl(schemas.HISTORY)}, {BUCKET} INT) USING parquet "
                  f"PARTITIONED BY ({BUCKET}) LOCATION '{location or _new_snapshot_path(spark, table)}' "
                  f"TBLPROPERTIES ('{BUCKETS}' = '{buckets}')")


def _bucket_of(buckets: int):
    return F.pmod(F.xxhash64("target_id"), F.lit(buckets)).cast("int")


def _written_buckets(spark: SparkSession, path: str) -> set[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [f.getPath().getName() for f in files]
    return {int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")}


def apply_log(spark: SparkSession, log: DataFrame, table: str) -> list[int]:
    """Fold a log batch into a bucketed history and return the buckets that it
    touches, which alone are read and written again.

    The batch is reduced to one outcome a key first (in the shared checkpoint
    folder); the partitions of its buckets are read by partition pruning,
    merged and written into a new folder by one job; then each of these
    partitions is pointed at its new folder, or dropped if no row is left, by
    one catalog statement a bucket.  A job that fails before that changes
    nothing; a run that ends between two statements leaves whole old and whole
    new buckets, and applying the same batch again completes it (a fold is
    idempotent).  Old folders stay for readers still running on them."""
    properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if BUCKETS not in properties:
        raise ValueError(f"{table} was not made by ensure_bucketed_history")
    buckets = int(properties[BUCKETS])
    checkpoint_dir(spark)
    last = last_outcomes(log).withColumn(BUCKET, _bucket_of(buckets)).checkpoint(eager=True)
    touched = sorted(r[0] for r in last.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return []
    stored = spark.table(table).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    path = _new_snapshot_path(spark, table)
    # a target has at most 65,536 versions, so a bucket's size is that of its targets
    (merge_outcomes(last.drop(BUCKET), stored).withColumn(BUCKET, _bucket_of(buckets)).repartition(BUCKET)
     .sortWithinPartitions(BUCKET, "target_id", "version").write.partitionBy(BUCKET).parquet(path))
    written = _written_buckets(spark, path)
    present = {int(r[0].split("=")[1]) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    for b in touched:
        if b in written:
            change = "PARTITION ({0}) SET LOCATION" if b in present else "ADD PARTITION ({0}) LOCATION"
            spark.sql(f"ALTER TABLE {table} {change.format(f'{BUCKET}={b}')} '{path}/{BUCKET}={b}'")
        elif b in present:
            spark.sql(f"ALTER TABLE {table} DROP PARTITION ({BUCKET}={b})")
    spark.catalog.refreshTable(table)
    return touched
