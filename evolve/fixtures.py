"""Relations derived from the given test tables (documents, events,
conversations), with DataFrame code.  The registered queries and the tests run
the library's operators over them; the oracle SQL in ``evolve.oracle`` derives
the same relations as CTEs.

Every document, event and conversation turn takes part:

* ``scripts``: every document is an UP script; project = its source and the
  block of ``BLOCK`` positions it falls in (so versions stay in the stored
  range), version = its position in that project by doc_id.
* ``targets``: one run configuration per user; users are dealt over the
  sources and their blocks.
* ``log``: one attempt per event; target = user, version spread over the
  whole range of the target's project.
* ``history``: the fold of ``log``.
* ``mini_*``: conversations as targets: every turn is a history row of the
  conversation's source; some turns hold a version that no script has.
* ``files``: script folders, one project per document source.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evolve.functions.ranking import rank_by_id
from evolve.operators.history import fold_history, repair

BLOCK = 10_000  # documents of one source in one project
TEXT_BUCKET = 1 << 12  # ids ranked together where rows carry their text

_MEMO: dict = {}
MEMO_SIZE = 256  # plans kept; the oldest goes first


def memo(fn):
    """Build each fixture DataFrame once per session (object and application)
    and arguments.  Only the
    plan object is reused (it is immutable); every query still runs its whole
    plan.  Shared subtrees also let Spark reuse their exchanges."""
    def wrapper(spark, *args, **kwargs):
        key = (fn.__name__, spark.sparkContext.applicationId, id(spark), args, tuple(sorted(kwargs.items())))
        if key not in _MEMO:
            made = fn(spark, *args, **kwargs)
            while len(_MEMO) >= MEMO_SIZE:
                del _MEMO[next(iter(_MEMO))]
            _MEMO[key] = made
        return _MEMO[key]
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


@memo
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@memo
def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document sources, numbered: ``source, n_docs, idx, n_src``.  One
    row per source: a dimension, so its window is small."""
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    return per.select("source", "n_docs", (F.row_number().over(Window.orderBy("source")) - 1).alias("idx"),
                      F.count(F.lit(1)).over(Window.partitionBy()).alias("n_src"))


def _assigned(spark: SparkSession, sf_dir: str, df: DataFrame, key: str) -> DataFrame:
    """``df`` with the project dealt to ``key`` and its number of scripts."""
    s = sources(spark, sf_dir)
    n_src = s.select(F.max("n_src").alias("_n")).first()["_n"]  # one number
    j = df.join(s, F.pmod(F.col(key), F.lit(n_src)) == F.col("idx"))
    block = F.pmod(F.floor(F.col(key) / F.lit(n_src)), F.ceil(F.col("n_docs") / F.lit(BLOCK)))
    return (j.withColumn("_block", block)
            .withColumn("project", F.concat_ws("/", "source", F.col("_block").cast("string")))
            .withColumn("size", F.least(F.lit(BLOCK), F.col("n_docs") - F.col("_block") * BLOCK).cast("int"))
            .select(*df.columns, "project", "size"))


@memo
def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP scripts: every document (see the module's head)."""
    # checksums before the ranking: no text goes through its exchanges
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.md5("text").alias("md5_checksum"),
        F.md5(F.concat("text", F.lit("#old"))).alias("old_md5"))
    at = F.col("rn") - 1
    d = rank_by_id(d, ["source"], "doc_id", "rn").withColumn("version", (F.pmod(at, F.lit(BLOCK)) + 1).cast("int"))
    return d.select(
        F.concat_ws("/", "source", F.floor(at / F.lit(BLOCK)).cast("string")).alias("project"),
        F.lit("UP").alias("direction"), "version", F.col("source").alias("description"),
        F.format_string("V%03d_%s.sql", F.col("version"), F.col("source")).alias("file_name"),
        "md5_checksum", "old_md5")


@memo
def down_scripts(spark: SparkSession, sf_dir: str, skip_tens: bool = False) -> DataFrame:
    """DOWN scripts for the same versions; ``skip_tens`` leaves out version % 10 = 0."""
    s = scripts(spark, sf_dir).withColumn("direction", F.lit("DOWN")) \
        .withColumn("md5_checksum", F.lit(None).cast("string")) \
        .withColumn("file_name", F.format_string("V%03d_%s.down.sql", "version", "description"))
    return s.where(F.col("version") % 10 != 0) if skip_tens else s


@memo
def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution log: one attempt per event, its version spread by props.k and
    event_id over the whole range of the target's project.

    'error' events failed, every fifth event is a DOWN, value > 60 recorded an
    old script text.
    """
    e = _assigned(spark, sf_dir, table(spark, sf_dir, "events"), "user_id")
    k = F.get_json_object("props", "$.k").cast("long")
    e = e.withColumn("version", (F.pmod(k * 7919 + F.col("event_id"), F.col("size")) + 1).cast("int"))
    s = scripts(spark, sf_dir).select("project", "version", "description", "md5_checksum", "old_md5")
    return e.join(s, ["project", "version"]).select(
        F.col("event_id"),
        F.col("user_id").alias("target_id"),
        F.col("version"),
        F.when(F.col("event_id") % 5 == 0, F.lit("DOWN")).otherwise(F.lit("UP")).alias("direction"),
        F.col("description"),
        F.when(F.col("value") > 60, F.col("old_md5")).otherwise(F.col("md5_checksum")).alias("md5_checksum"),
        (F.col("event_type") != "error").alias("success"),
        F.col("ts").alias("executed_at"),
    )


@memo
def far_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with every seventh event's version moved to the end of the
    stored range, so that some lie above it."""
    moved = F.when(F.col("event_id") % 7 == 0, 32763).otherwise(0)
    return log(spark, sf_dir).withColumn("version", (F.col("version") + moved).cast("int"))


@memo
def hook_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with an AFTER_EACH hook's attempt after each step (twice the
    event ids, so that a hook follows its step); some hooks failed."""
    steps = log(spark, sf_dir)
    hooks = steps.select(
        (F.col("event_id") * 2 + 1).alias("event_id"), "target_id", "version",
        F.lit("AFTER_EACH").alias("direction"), F.lit("ae1").alias("description"),
        F.lit(None).cast("string").alias("md5_checksum"), (F.col("event_id") % 11 != 0).alias("success"), "executed_at")
    return steps.withColumn("event_id", F.col("event_id") * 2).unionByName(hooks)


@memo
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_history(log(spark, sf_dir))


@memo
def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run configuration per user: down for user_id % 6 >= 3; destinations by
    user_id % 6, as parts of the project's range (one lies above it)."""
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("target_id")).distinct()
    m, size = F.col("target_id") % 6, F.col("size")
    part = lambda a, b: F.floor(size * a / F.lit(b))
    dest = (F.when(m == 1, part(9, 10)).when(m == 2, part(6, 5)).when(m == 3, part(2, 5)).when(m == 5, part(19, 20))
            .cast("int"))
    return _assigned(spark, sf_dir, u, "target_id").select(
        "target_id", "project", (m >= 3).alias("down"), dest.alias("destination"))


@memo
def half_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history after an earlier repair of every second target."""
    h, t = history(spark, sf_dir), targets(spark, sf_dir)
    return repair(h, scripts(spark, sf_dir), t.where(F.col("target_id") % 2 == 0), _dt.datetime(2024, 1, 20), True)


@memo
def file_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user as an upward run over a script folder of its source: the
    whole one, the one without out-of-range files ('-sound'), or one that
    holds no script ('-none')."""
    m = F.floor(F.col("target_id") / 3) % 4
    kind = F.when(m < 2, "").when(m == 2, "-sound").otherwise("-none")
    return targets(spark, sf_dir).select(
        "target_id", F.concat(F.substring_index("project", "/", 1), kind).alias("project"),
        F.lit(False).alias("down"), F.lit(None).cast("int").alias("destination"))


def _of_every_project(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    """The same small hook set for every project."""
    names = ["hook_type", "hook_order", "hook_version", "file_name", "content"]
    types = ["string", "int", "int", "string", "string"]
    each = F.explode(F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types)])
                               for r in rows])).alias("h")
    return scripts(spark, sf_dir).select("project").distinct().select("project", each).select("project", "h.*")


@memo
def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hook set of every project (a configuration, not data)."""
    return _of_every_project(spark, sf_dir, [
        ("BEFORE", 1, None, "b1", ""), ("BEFORE", 2, None, "b2", ""), ("BEFORE_EACH", 1, None, "be1", ""),
        ("BEFORE_VERSION", 1, 8, "bv1", ""), ("AFTER_VERSION", 1, 8, "av1", ""),
        ("AFTER_EACH", 1, None, "ae1", ""), ("AFTER", 1, None, "a1", ""), ("REPEATABLE", 1, None, "r1", "")])


@memo
def down_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_every_project(spark, sf_dir, [("REPEATABLE_DOWN", 1, None, "rd1", "")])


# --- mini fleet -----------------------------------------------------------

@memo
def mini_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project twice: whole, and as '<project>-gappy' without version 4."""
    whole = scripts(spark, sf_dir).drop("old_md5")
    gappy = whole.where(F.col("version") != 4).withColumn("project", F.concat("project", F.lit("-gappy")))
    return whole.unionByName(gappy)


def _conversations(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """``df`` with the project of its conv_id (``base``: the whole one)."""
    a = _assigned(spark, sf_dir, df, "conv_id").withColumnRenamed("project", "base")
    return a.withColumn("project", F.when(F.col("conv_id") % 4 == 0, F.concat("base", F.lit("-gappy")))
                        .otherwise(F.col("base")))


@memo
def mini_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return _conversations(spark, sf_dir, c).select(F.col("conv_id").alias("target_id"), "project")


@memo
def mini_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn: version turn + 1, except that turns whose text length
    is a multiple of 19 hold a version 1000 above the project's last one,
    which has no script (a gap below it, and a missing script).  Some rows hold
    another description or checksum, some failed."""
    c = _conversations(spark, sf_dir, table(spark, sf_dir, "conversations"))
    lost = F.length("text") % 19 == 0
    c = c.withColumn("version", (F.when(lost, F.col("size") + 1000).otherwise(0) + F.col("turn") + 1).cast("int"))
    d = scripts(spark, sf_dir).select(F.col("project").alias("base"), "version", "description", "md5_checksum")
    j = c.join(d, ["base", "version"], "left")
    md5 = F.coalesce("md5_checksum", F.md5(F.concat("text", F.lit("#lost"))))
    return j.select(
        F.col("conv_id").alias("target_id"), "version",
        F.concat(F.coalesce("description", F.lit("lost")),
                 F.when(F.length("text") % 31 == 0, "_old").otherwise("")).alias("description"),
        F.when(F.length("text") % 23 == 0, F.md5("text")).otherwise(md5).alias("md5_checksum"),
        (F.length("text") % 29 != 0).alias("success"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("executed_at"),
        F.lit(None).cast("timestamp_ntz").alias("repaired_at"),
    )


# --- script folders -----------------------------------------------------------

@memo
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script folders: one project per document source.

    rn = position of the document in its source by doc_id; v = rn, o = rn * 7.
    The file name kind is chosen by doc_id % 16 (see FIXTURES.md).
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    d = rank_by_id(d, ["source"], "doc_id", "rn", TEXT_BUCKET)
    v = F.format_string("%03d", F.col("rn"))
    o = F.format_string("%03d", F.col("rn") * 7)
    m = (F.col("doc_id") % 16).cast("int")
    # name = prefix, number, [_version], "_", lang, suffix -- picked by doc_id % 16
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), m + 1)
    prefix = pick(["V", "R", "R", "B", "BE", "BV", "A", "AE", "AV", "", "", "V", "V", "V", "V", "V"])
    suffix = pick([".sql", ".sql", ".down.sql", ".sql", ".sql", ".sql", ".sql", ".sql", ".sql", ".md",
                   ".template.sql", ".sql", ".down.sql", ".sql", ".sql", ".sql"])
    number = (F.when(m.between(1, 8), o).when(m == 11, F.lit("70000"))
              .when(m.isin(9, 10), F.lit("")).otherwise(v))
    second = F.when(m.isin(5, 8), F.concat(F.lit("_"), v)).otherwise(F.lit(""))
    sep = F.when(m.isin(9, 10), F.lit("")).otherwise(F.lit("_"))
    body = F.when(m == 9, F.lit("notes")).otherwise(F.col("lang"))
    name = F.concat(prefix, number, second, sep, body, suffix)
    path = F.concat(F.col("source"), F.lit("/d"), F.lpad(F.col("doc_id").cast("string"), 8, "0"),
                    F.lit("/"), name)
    return d.select(F.col("source").alias("project"), "doc_id", "rn", "lang", name.alias("file_name"),
                    path.alias("path"), F.col("text").alias("content"))


@memo
def template_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a script of its source, with three template uses
    appended; each source has one template ``sig`` = ``<$1/$2>``."""
    d = table(spark, sf_dir, "documents")
    scripts = d.select(F.col("source").alias("project"), "doc_id",
                       F.concat(F.col("text"), F.lit(" {{sig, "), F.col("source"),
                                F.lit(" , x}} {{ sig,z,y}} {{nope}}")).alias("content"))
    templates = d.select(F.col("source").alias("project")).distinct().select(
        "project", F.lit("sig").alias("name"), F.lit("<$1/$2>").alias("body"))
    return scripts, templates


# --- versioned changes of user tables -----------------------------------------------

def orders_changes():
    from evolve.plans.migrate import Change
    return [
        Change(1, "SELECT *, CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 100000 "
                  "THEN 'mid' ELSE 'low' END AS band FROM {t}",
               "SELECT * EXCEPT (band) FROM {t}", "add_band"),
        Change(2, "SELECT * EXCEPT (o_orderpriority), o_orderpriority AS priority FROM {t}",
               "SELECT * EXCEPT (priority), priority AS o_orderpriority FROM {t}", "rename_priority"),
        Change(3, "SELECT * FROM {t} WHERE o_orderstatus <> 'P'", "SELECT * FROM {t}", "drop_pending"),
    ]


def lineitem_changes():
    from evolve.plans.migrate import Change, Hook
    changes = [
        Change(1, "SELECT *, l_extendedprice * (1 - l_discount) AS net FROM {t}",
               "SELECT * EXCEPT (net) FROM {t}", "add_net"),
        Change(2, "SELECT *, net * (1 + l_tax) AS charge FROM {t}",
               "SELECT * EXCEPT (charge) FROM {t}", "add_charge"),
        Change(3, "SELECT * EXCEPT (l_tax) FROM {t} WHERE l_returnflag <> 'R'", None, "drop_returns"),
    ]
    hooks = [Hook("BEFORE", 1, "SELECT * FROM {t} WHERE l_quantity > 0", name="positive_quantity")]
    return changes, hooks
