"""Validation of local scripts and stored histories: gaps, drift, failing rows,
the staged gate that decides whether a run may start, and the status summary.

Window bounds.  Windows partitioned by target run over the history, whose key
is (target_id, version) with version <= 65535, so one window partition holds at
most 65536 rows however large the fleet or a single target's log grows.  Local
gaps are computed over *distinct* versions per project (same bound) after a hash
aggregate; copies of one version are expanded from their count, not windowed.
``status`` and ``gate`` take latest version and gaps from version bitmaps
(:mod:`evolve.operators.bitmaps`), without a window.

Drift by distinct tuples.  A fleet's history repeats the same few (project,
version, description, checksum) tuples on every target.  They are reduced to
the distinct ones (partial sums in every task: one row per tuple and task,
however many targets hold it), those that no local script has are the bad
tuples, and rows are marked by a join with the bad ones alone, see
:func:`marked`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evolve.operators import bitmaps
from evolve.operators.history import failing
from evolve.session import checkpoint_dir

# Problem texts.
MSG_FAILING = "found an unsucceeded migration: %d"
MSG_LOCAL_GAP = "expected version %d got %d"
MSG_HISTORY_GAP = "missing version %d"
MSG_DRIFT = ("invalid migration found: version: %d, description: %s, md5_checksum: %s."
             " Please check your local migration and changes")

TUPLE = ["project", "version", "description", "md5_checksum"]
BROADCAST_TUPLES = 50_000  # a tuple holds at most some 350 bytes (description: 255 characters)
SALTS = 32
PIECE = 512   # targets, and problems, of one project that meet in one place, about
PIECES = 32   # pieces of a project's problems at least, so that a small project isn't one task

STAGE_LOAD = -1
STAGE_FAILING, STAGE_LOCAL, STAGE_HISTORY = 1, 2, 3


def _up(scripts: DataFrame) -> DataFrame:
    if "direction" in scripts.columns:
        return scripts.where(F.col("direction") == "UP")
    return scripts


def _projects_with_scripts(scripts: DataFrame) -> DataFrame:
    return _up(scripts).select("project").distinct()


def _checked_history(history: DataFrame, scripts: DataFrame, targets: DataFrame) -> DataFrame:
    """History rows of targets whose project has at least one UP script, with
    the target's project attached.  (Without local UP scripts the reference
    skips the history checks altogether.)"""
    tp = targets.select("target_id", "project").join(_projects_with_scripts(scripts), "project", "left_semi")
    return history.join(tp, "target_id")


def local_gaps(scripts: DataFrame) -> DataFrame:
    """Breaks in each project's UP versions (W1): the first must be 1, each
    next one the previous + 1.  One row per break with (expected, got).  A
    version present k times adds k-1 breaks (expected version+1, got version).

    The window runs over distinct versions only (at most 65536 per project).
    The breaks of copies come from their count, whatever their names.
    """
    up = _up(scripts)
    counts = up.groupBy("project", "version").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    w = Window.partitionBy("project").orderBy("version")
    first = (counts.withColumn("expected", F.coalesce(F.lag("version").over(w) + 1, F.lit(1)))
             .where(F.col("version") != F.col("expected"))
             .select("project", F.col("expected").cast("int"), F.col("version").alias("got")))
    extra = (counts.where(F.col("copies") > 1)
             .select("project", "version", F.explode(F.sequence(F.lit(2), "copies")).alias("_copy"))
             .select("project", (F.col("version") + 1).cast("int").alias("expected"), F.col("version").alias("got")))
    return first.unionByName(extra).withColumn(
        "message", F.format_string(MSG_LOCAL_GAP, "expected", "got"))


def _history_breaks(history: DataFrame) -> DataFrame:
    w = Window.partitionBy("target_id").orderBy("version")
    return (history.select("target_id", "version")
            .withColumn("expected", F.coalesce(F.lag("version").over(w) + 1, F.lit(1)))
            .where(F.col("version") != F.col("expected")))


def history_gaps(history: DataFrame, scripts: DataFrame, targets: DataFrame) -> DataFrame:
    """First missing version of every gap in each target's history.

    All rows count, failed ones too; a missing tail is not a gap.  Targets
    whose project has no UP script are not checked.
    """
    h = _checked_history(history, scripts, targets)
    return (_history_breaks(h)
            .select("target_id", F.col("expected").cast("int").alias("missing_version"),
                    F.format_string(MSG_HISTORY_GAP, "expected").alias("message")))


def history_gap_ranges(history: DataFrame, scripts: DataFrame, targets: DataFrame) -> DataFrame:
    """The same gaps as closed ranges [gap_from, gap_to]."""
    h = _checked_history(history, scripts, targets)
    return (_history_breaks(h)
            .select("target_id", F.col("expected").cast("int").alias("gap_from"),
                    (F.col("version") - 1).cast("int").alias("gap_to")))


def bad_tuples(history: DataFrame, scripts: DataFrame, targets: DataFrame) -> DataFrame:
    """The distinct tuples of successful history rows that no local UP script
    has, with the reason: ``missing`` (no local script of that version),
    ``description`` (one exists under another name) or ``checksum`` (same name,
    other content).  Reasons are found for these tuples alone.

    Runs one job when called: the tuples go into the shared checkpoint folder,
    so that their number is known before rows are joined with them."""
    checkpoint_dir(history.sparkSession)
    h = _checked_history(history.where(F.col("success")).select("target_id", *TUPLE[1:]), scripts, targets)
    local = _up(scripts).select(*TUPLE)
    bad = h.select(*TUPLE).distinct().join(local, TUPLE, "left_anti")
    versions = local.select("project", "version").distinct().withColumn("_has_version", F.lit(True))
    names = local.select("project", "version", "description").distinct().withColumn("_has_name", F.lit(True))
    reason = (F.when(F.col("_has_version").isNull(), F.lit("missing"))
              .when(F.col("_has_name").isNull(), F.lit("description"))
              .otherwise(F.lit("checksum")))
    return (bad.join(versions, ["project", "version"], "left").join(names, ["project", "version", "description"], "left")
            .select(*TUPLE, reason.alias("reason")).checkpoint(eager=True))


def marked(rows: DataFrame, bad: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` (with ``target_id`` and the tuple columns) joined with the bad
    tuples: ``reason`` says what is wrong, null if nothing.

    Up to ``BROADCAST_TUPLES`` bad tuples are sent to the rows, which stay
    where they are.  With more, both sides meet on the tuple and a salt, so
    that a tuple that very many targets hold is dealt over ``SALTS`` tasks."""
    if bad.count() <= BROADCAST_TUPLES:
        return rows.join(F.broadcast(bad), TUPLE, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    return (rows.withColumn("_salt", F.pmod(F.hash("target_id"), F.lit(SALTS)))
            .join(bad.select("*", salts), [*TUPLE, "_salt"], how).drop("_salt"))


def _drifted(history: DataFrame, scripts: DataFrame, targets: DataFrame) -> DataFrame:
    bad = bad_tuples(history, scripts, targets)
    h = _checked_history(history.where(F.col("success")).select("target_id", *TUPLE[1:]), scripts, targets)
    return marked(h, bad, "inner")


def drift(history: DataFrame, scripts: DataFrame, targets: DataFrame) -> DataFrame:
    """Successful history rows whose (version, description, checksum) is not
    among the project's local UP scripts (J1): edited, renamed or deleted
    scripts.  Local scripts missing from the history are not drift.
    """
    return _drifted(history, scripts, targets).select("target_id", "version", "description", "md5_checksum")


def drift_detail(history: DataFrame, scripts: DataFrame, targets: DataFrame) -> DataFrame:
    """Drift rows with their reason (J2), see :func:`bad_tuples`."""
    return _drifted(history, scripts, targets).select(
        "target_id", "version", "description", "md5_checksum", "reason",
        F.format_string(MSG_DRIFT, "version", "description", "md5_checksum").alias("message"))


def _in_pieces(df: DataFrame, sizes: DataFrame, n: str, piece: str, name: str) -> DataFrame:
    """A project's rows as arrays of about ``PIECE`` rows each, dealt over ``n``
    pieces by their hash (copies of a row apart), beside the project's sizes."""
    columns = [c for c in df.columns if c != "project"]
    copies = df.groupBy("project", *columns).agg(F.count(F.lit(1)).cast("int").alias("_n")).select(
        "project", *columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    return (copies.join(sizes, "project")
            .groupBy(*sizes.columns, F.pmod(F.xxhash64(*columns, "_copy"), F.col(n)).cast("int").alias(piece))
            .agg(F.collect_list(F.struct(*columns)).alias(name)))


def _of_every_target(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row of a project with every target of it: the result's own size,
    from few bytes and few projects.  So that a project is no single task, both
    its targets and its rows are cut into pieces of about ``PIECE``, one array
    each, as many as the project needs (of rows ``PIECES`` at least, smaller
    then); each pair of pieces meets in one of
    ``spark.sql.shuffle.partitions`` tasks, which writes the pair's product out
    of the two arrays, row by row.  The product isn't shuffled or sorted, what
    is shuffled is a ``PIECE``-th part of it."""
    count = F.count(F.lit(1))
    pieces = lambda n, least: F.greatest(F.ceil(F.col(n) / F.lit(PIECE)), F.lit(least)).cast("int").alias(n)
    sizes = (targets.groupBy("project").agg(count.alias("_n_targets"))
             .join(rows.groupBy("project").agg(count.alias("_n_rows")), "project")
             .select("project", pieces("_n_targets", 1), pieces("_n_rows", PIECES)))
    key = ["project", "_target_piece", "_row_piece"]
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    t = (_in_pieces(targets, sizes, "_n_targets", "_target_piece", "_targets")
         .select(*key[:2], "_targets", each("_n_rows").alias("_row_piece")).repartition(tasks, *key))
    r = (_in_pieces(rows, sizes, "_n_rows", "_row_piece", "_rows")
         .select("project", "_row_piece", "_rows", each("_n_targets").alias("_target_piece")).repartition(tasks, *key))
    return (t.join(r.hint("merge"), key)  # a broadcast would undo the dealing
            .select("project", "_targets", F.explode("_rows").alias("_row"))
            .select("project", "_row", F.explode("_targets").alias("_target"))
            .select("project", "_target.*", "_row.*"))


def problems(history: DataFrame, scripts: DataFrame, targets: DataFrame,
             invalid: DataFrame | None = None) -> DataFrame:
    """Every validation problem of every target, tagged with its stage (M5);
    with ``invalid`` also the out-of-range files of its project (stage -1)."""
    f = (failing(history).join(targets.select("target_id"), "target_id", "left_semi")
         .select("target_id", F.lit(STAGE_FAILING).alias("stage"), F.lit("failing").alias("kind"),
                 "version", F.format_string(MSG_FAILING, "version").alias("message")))
    lg = (_of_every_target(targets.select("target_id", "project"), local_gaps(scripts).select("project", "got", "message"))
          .select("target_id", F.lit(STAGE_LOCAL).alias("stage"), F.lit("local_gap").alias("kind"),
                  F.col("got").alias("version"), "message"))
    hg = (history_gaps(history, scripts, targets)
          .select("target_id", F.lit(STAGE_HISTORY).alias("stage"), F.lit("history_gap").alias("kind"),
                  F.col("missing_version").alias("version"), "message"))
    dr = (drift_detail(history, scripts, targets)
          .select("target_id", F.lit(STAGE_HISTORY).alias("stage"), F.lit("drift").alias("kind"), "version", "message"))
    out = f.unionByName(lg).unionByName(hg).unionByName(dr)
    if invalid is None:
        return out
    load = _of_every_target(targets.select("target_id", "project"), invalid.select("project", "message")).select(
        "target_id", F.lit(STAGE_LOAD).alias("stage"), F.lit("load").alias("kind"),
        F.lit(None).cast("int").alias("version"), "message")
    return out.unionByName(load)


def _with_project(history: DataFrame, scripts: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets' history rows with their project, what drifted (``reason``,
    null if nothing), and ``_checked``: the project has an UP script."""
    with_scripts = _up(scripts).select("project").distinct().withColumn("_checked", F.lit(True))
    tp = targets.select("target_id", "project").join(with_scripts, "project", "left").select(
        "target_id", "project", F.coalesce("_checked", F.lit(False)).alias("_checked"))
    rows = history.select("target_id", "version", "description", "md5_checksum", "success").join(tp, "target_id")
    return marked(rows, bad_tuples(history, scripts, targets)).withColumn(
        "_drift", F.col("success") & F.col("reason").isNotNull()).drop("reason")


def _flagged(history: DataFrame, scripts: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets' history rows with what is wrong with each: ``_gap`` (a gap
    lies below it, from ``_expected`` on; one window per target) and ``_drift``."""
    w = Window.partitionBy("target_id").orderBy("version")
    return (_with_project(history, scripts, targets)
            .withColumn("_expected", F.coalesce(F.lag("version").over(w) + 1, F.lit(1)).cast("int"))
            .withColumn("_gap", F.col("_checked") & (F.col("version") != F.col("_expected"))))


def _history_summary(history: DataFrame, scripts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target latest version, failing rows and history mismatches (gaps +
    drift, a row that is both counts twice).  One exchange of the history, on
    target_id: rows become version words with their counts, words one row per
    target; latest version and gaps are bit arithmetic."""
    rows = _with_project(history, scripts, targets)
    words = rows.groupBy("target_id", "_checked", F.shiftright("version", 6).alias("word")).agg(
        *bitmaps.word_columns(), F.count_if(~F.col("success")).alias("n_failing"), F.count_if("_drift").alias("n_drift"))
    lists = words.groupBy("target_id", "_checked").agg(
        bitmaps.word_list(), F.sum("n_failing").alias("n_failing"), F.sum("n_drift").alias("n_drift"))
    gaps = F.when(F.col("_checked"), bitmaps.n_gaps(F.col("words"))).otherwise(0)
    return lists.select("target_id", bitmaps.latest_of(F.col("words")).alias("latest"), "n_failing",
                        (gaps + F.col("n_drift")).alias("n_mismatch"))


def gate(history: DataFrame, scripts: DataFrame, targets: DataFrame,
         invalid: DataFrame | None = None) -> DataFrame:
    """First failing validation stage per target (D2); 0 = passes, with the
    number of problems that stage reports.

    Stage -1 (only with ``invalid``, the out-of-range files): the project's
    load failed, nothing else is looked at.  Stage 1: failed rows in the history; 2: gaps in the local UP scripts;
    3: history gaps and drift.  A target stops at its first failing stage.
    Only counts are needed, so stage 2 is counted per project (one row each)
    and stages 1 and 3 come from the one-pass history summary.
    """
    summary = _history_summary(history, scripts, targets)
    lg = local_gaps(scripts).groupBy("project").agg(F.count(F.lit(1)).alias("n_local"))
    t = (targets.select("target_id", "project").join(summary, "target_id", "left")
         .join(lg, "project", "left"))
    n1, n2, n3 = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_failing", "n_local", "n_mismatch"))
    n0 = F.lit(0)
    if invalid is not None:
        t = t.join(invalid.groupBy("project").agg(F.count(F.lit(1)).alias("n_invalid")), "project", "left")
        n0 = F.coalesce(F.col("n_invalid"), F.lit(0))
    stage = F.when(n0 > 0, STAGE_LOAD).when(n1 > 0, STAGE_FAILING).when(n2 > 0, STAGE_LOCAL).when(n3 > 0, STAGE_HISTORY).otherwise(0)
    count = F.when(n0 > 0, n0).when(n1 > 0, n1).when(n2 > 0, n2).when(n3 > 0, n3).otherwise(0)
    return t.select("target_id", "project", stage.cast("int").alias("stage"), count.cast("long").alias("problems"))


def gate_problems(history: DataFrame, scripts: DataFrame, targets: DataFrame,
                  invalid: DataFrame | None = None) -> DataFrame:
    """The problems of each target's first failing stage (what a run reports);
    with ``invalid``, a project whose load fails reports its out-of-range files.

    What a target stops at before its history is compared (load, failing rows,
    local gaps) is known first, one row per target; the flagged history is
    read once, and its rows are written out only for targets that stop there."""
    gaps = local_gaps(scripts)
    has = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    t = (targets.select("target_id", "project")
         .join(has(failing(history), "target_id", "_failing"), "target_id", "left")
         .join(has(gaps, "project", "_local_gap"), "project", "left"))
    load = F.lit(False)
    if invalid is not None:
        t = t.join(has(invalid, "project", "_broken"), "project", "left")
        load = F.col("_broken").isNotNull()
    stages = t.select("target_id", "project", F.when(load, STAGE_LOAD).when(F.col("_failing"), STAGE_FAILING)
                      .when(F.col("_local_gap"), STAGE_LOCAL).otherwise(STAGE_HISTORY).alias("stage"))
    drifted = F.format_string(MSG_DRIFT, "version", "description", "md5_checksum")

    def found(kind, version, message, when):
        row = F.struct(F.lit(kind).alias("kind"), F.col(version).cast("int").alias("version"), message.alias("message"))
        return F.when(when, row)

    stage = F.col("stage")
    listed = F.array_compact(F.array(
        found("failing", "version", F.format_string(MSG_FAILING, "version"), (stage == STAGE_FAILING) & ~F.col("success")),
        found("history_gap", "_expected", F.format_string(MSG_HISTORY_GAP, "_expected"),
              (stage == STAGE_HISTORY) & F.col("_gap")),
        found("drift", "version", drifted, (stage == STAGE_HISTORY) & F.col("_drift"))))
    rows = (_flagged(history, scripts, targets).where(~F.col("success") | F.col("_gap") | F.col("_drift"))
            .drop("project").join(stages.where(stage.isin(STAGE_FAILING, STAGE_HISTORY)), "target_id")
            .select("target_id", "stage", F.explode(listed).alias("p")).select("target_id", "stage", "p.*"))
    every = targets.select("target_id", "project")
    sound = every if invalid is None else every.join(invalid.select("project").distinct(), "project", "left_anti")
    sound = sound.join(failing(history).select("target_id").distinct(), "target_id", "left_anti")
    local = (_of_every_target(sound, gaps.select("project", "got", "message"))
             .select("target_id", F.lit(STAGE_LOCAL).alias("stage"), F.lit("local_gap").alias("kind"),
                     F.col("got").alias("version"), "message"))
    out = rows.unionByName(local)
    if invalid is not None:
        out = out.unionByName(_of_every_target(every, invalid.select("project", "message"))
                              .select("target_id", F.lit(STAGE_LOAD).alias("stage"), F.lit("load").alias("kind"),
                                      F.lit(None).cast("int").alias("version"), "message"))
    return out


def status(history: DataFrame, scripts: DataFrame, targets: DataFrame,
           invalid: DataFrame | None = None) -> DataFrame:
    """Per target: latest applied version, number of history mismatches (gaps
    and drift) and number of failing rows (A3).  Local gaps are not counted.
    With ``invalid`` (the out-of-range files), ``load_failed`` tells whose
    project can't be loaded.  One pass over the history (see
    :func:`_history_summary`)."""
    summary = _history_summary(history, scripts, targets)
    cols = [F.coalesce("latest", F.lit(0)).cast("int").alias("latest_version"),
            F.coalesce("n_mismatch", F.lit(0)).cast("long").alias("mismatches"),
            F.coalesce("n_failing", F.lit(0)).cast("long").alias("failing")]
    t = targets.select("target_id", "project").join(summary, "target_id", "left")
    if invalid is not None:
        t = t.join(invalid.select("project").distinct().withColumn("_broken", F.lit(True)), "project", "left")
        cols.append(F.coalesce("_broken", F.lit(False)).alias("load_failed"))
    return t.select("target_id", *cols)
