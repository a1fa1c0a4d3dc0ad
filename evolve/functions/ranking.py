"""Positions inside groups without sending a whole group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evolve.session import checkpoint_dir

DEFAULT_BUCKET = 1 << 20
MANY = 1 << 16        # rows of one value from which it is cut into path ranges
CELLS_LOG2 = 10       # at most 2^10 cuts for one value
CELLS = 1 << CELLS_LOG2
SALTS = 32


def rank_by_id(df: DataFrame, by: list[str], id_col: str, name: str,
               bucket_width: int = DEFAULT_BUCKET) -> DataFrame:
    """``row_number() over (partition by <by> order by <id_col>)`` for a unique
    integer ``id_col``, computed in bounded pieces.

    A plain window puts every row of a group into one task, and one group may
    hold a large share of the table.  Here rows are cut into id buckets of
    ``bucket_width`` (so at most that many rows share a window partition), the
    bucket sizes are counted with a hash aggregate, and each bucket's offset is a
    running sum over the bucket counts of its group (one row per bucket).
    """
    bucket = F.floor(F.col(id_col) / F.lit(bucket_width)).cast("long")
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*by, "_bucket").orderBy(id_col)
    return (keyed.join(offsets, [*by, "_bucket"])
            .withColumn(name, (F.row_number().over(inner) + F.col("_off")).cast("int"))
            .drop("_bucket", "_off"))


def rank_by_sort(df: DataFrame, by: list[str], order: list, name: str,
                 partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by <by> order by <order>)`` for any sort
    key, with no group in one task: a range shuffle on (by, order) cuts even a
    single huge group into contiguous pieces of about equal size; rows are
    numbered inside their piece, and each piece's offset inside its group is a
    running sum over the piece sizes (at most ``partitions`` rows per group).

    ``order`` must be unique inside a group (e.g. it ends with a path).

    The range bounds come from sampling, and two exchanges sample
    differently, so the rows with their piece ids are written once with
    ``DataFrame.checkpoint()`` into the shared checkpoint folder and both the
    numbering and the piece sizes read that copy (this runs one job when
    called).
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    pieces = (df.repartitionByRange(n, *[F.col(b) for b in by], *cols)
              .withColumn("_piece", F.spark_partition_id())
              .checkpoint(eager=True))
    local = Window.partitionBy("_piece", *by).orderBy(*cols)
    numbered = pieces.withColumn("_local", F.row_number().over(local))
    sizes = numbered.groupBy(*by, "_piece").agg(F.max("_local").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (numbered.join(offsets, [*by, "_piece"])
            .withColumn(name, (F.col("_local") + F.col("_off")).cast("int"))
            .drop("_piece", "_local", "_off"))


def rank_by_counts(df: DataFrame, by: list[str], value, tie: str, name: str, many: int = MANY) -> DataFrame:
    """``row_number() over (partition by <by> order by <value>, <tie>)`` as a
    counting sort, for a ``value`` with few distinct numbers in a group (a
    version has 65,536, a hook order 256) and a string or number ``tie``.

    Rows are counted per value; a value's first position is the running sum of
    the counts before it (one row per distinct value, never per row of ``df``).
    Inside a value, rows are numbered by ``tie``.  A value with more than
    ``many`` rows is cut into ranges of ``tie`` first: its rows are dealt by
    hash into ``CELLS`` cells, each cell's row with the least second hash is a
    cut, and a row's range is found by binary search among the sorted cuts.
    The ranges are numbered apart, and their sizes join the running sums.

    Cuts come from hashes, not from sampling, so every scan and every retried
    task finds the same ranges: nothing has to be written in between, and no
    job runs when this is called.  Cuts meet the rows on the value and a salt,
    so that a hot value is no hot join key.

    Rows that agree in all three are numbered in any order, but apart.  ``by``
    and ``value`` must not be null; a null ``tie`` comes first.  An empty table
    gives an empty one.
    """
    key = [*by, "_value"]
    rows = df.withColumn("_value", value if not isinstance(value, str) else F.col(value))
    cells = (rows.groupBy(*key, F.pmod(F.xxhash64(F.col(tie)), F.lit(CELLS)).alias("_cell"))
             .agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.col(tie), F.struct(F.xxhash64(F.lit(1), F.col(tie)), tie)).alias("_cut")))
    cuts = (cells.groupBy(*key).agg(F.sum("_n").alias("_n"), F.sort_array(F.collect_set("_cut")).alias("_cuts"))
            .where(F.col("_n") > many)
            .select(*key, "_cuts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")))
    salt = F.pmod(F.xxhash64(F.lit(2), F.col(tie)), F.lit(SALTS)).cast("int")
    pieces = (rows.withColumn("_salt", salt)
              .join(cuts, [*key, "_salt"], "left")
              .withColumn("_piece", _cuts_up_to(F.col("_cuts"), F.col(tie)))
              .drop("_cuts", "_salt"))
    sizes = pieces.groupBy(*key, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_value", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*key, "_piece").orderBy(tie)
    return (pieces.join(offsets, [*key, "_piece"])
            .withColumn(name, (F.row_number().over(inside) + F.col("_off")).cast("int"))
            .drop("_value", "_piece", "_off"))


def _cuts_up_to(cuts, x):
    """How many of the sorted cuts are <= x, bit by bit; 0 without cuts."""
    def with_bit(at, bit):
        on = at + bit
        return F.when((on <= F.size(cuts)) & (F.try_element_at(cuts, on) <= x), on).otherwise(at)

    bits = F.array(*[F.lit(1 << b) for b in range(CELLS_LOG2, -1, -1)])
    return F.when(cuts.isNull() | x.isNull(), F.lit(0)).otherwise(F.aggregate(bits, F.lit(0), with_bit))
