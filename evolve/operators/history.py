"""History table operators: latest version, failing rows, folding an execution
log into the history, and repair.

Scale notes.  Every operator here is keyed by ``(target_id, version)`` or by
``target_id``.  Reductions are hash aggregates (``max_by`` / ``max`` /
``count``), which combine map-side before the shuffle, so one hot target or one
version attempted millions of times costs one row per map task in the shuffle,
not one row per attempt.  The join back to the stored history is on the same
``(target_id, version)`` key as the aggregate, so the aggregate's output
partitioning is reused and only the stored history is exchanged.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evolve import schemas
from evolve.operators import bitmaps
from evolve.session import checkpoint_dir

KEY = ["target_id", "version"]
HISTORY_COLS = [f.name for f in schemas.HISTORY.fields]
BLOCK_WORDS = 4                # a target meets its scripts in blocks of 4 words, 256 versions
SALTS = 8                      # tasks over which the targets of one project and block are dealt
BROADCAST_TARGETS = 1_000_000  # 8 bytes each


def _as_history(df: DataFrame) -> DataFrame:
    """Project to the history schema; ``repaired_at`` is optional on input."""
    if "repaired_at" not in df.columns:
        df = df.withColumn("repaired_at", F.lit(None).cast("timestamp_ntz"))
    return df.select(*HISTORY_COLS)


def last_outcomes(log: DataFrame) -> DataFrame:
    """Last attempt per (target_id, version), ordered by (executed_at, event_id).

    Hook rows (any direction but UP and DOWN) write no history.  Failed DOWN attempts are dropped first: they leave the stored row as it is.
    So are versions above the stored column's range (SMALLINT, 32767): their
    history row cannot be written.  ``cleared`` tells whether a successful
    DOWN happened for the key, which deletes the row and with it any
    ``repaired_at`` value.
    """
    kept = log.where(((F.col("direction") == "UP") | ((F.col("direction") == "DOWN") & F.col("success")))
                     & (F.col("version") <= schemas.MAX_STORED_VERSION))
    return kept.groupBy(*KEY).agg(
        F.max_by(
            F.struct("direction", "description", "md5_checksum", "success", "executed_at"),
            F.struct("executed_at", "event_id"),
        ).alias("last"),
        F.bool_or(F.col("direction") == "DOWN").alias("cleared"),
    )


def fold_history(log: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Apply an execution log to a history table (upserts and rollbacks, M3).

    * a successful or failed UP writes the row: description, checksum, success
      and executed_at come from the attempt; ``repaired_at`` of an existing row
      is kept;
    * a successful DOWN deletes the row; a failed DOWN changes nothing;
    * for each key only the last attempt counts, so the result equals applying
      the log one event at a time in (executed_at, event_id) order.
    """
    return merge_outcomes(last_outcomes(log), history)


def merge_outcomes(last: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Apply per-key outcomes (:func:`last_outcomes`) to a stored history."""
    if history is None:
        return (last.where(F.col("last.direction") == "UP")
                .select(*KEY, "last.description", "last.md5_checksum", "last.success",
                        "last.executed_at",
                        F.lit(None).cast("timestamp_ntz").alias("repaired_at")))
    h = _as_history(history).alias("h")
    j = h.join(last.alias("l"), KEY, "full_outer")
    touched = F.col("l.last").isNotNull()
    pick = lambda c: F.when(touched, F.col(f"l.last.{c}")).otherwise(F.col(f"h.{c}"))
    return (j.where(~touched | (F.col("l.last.direction") == "UP"))
            .select(*KEY,
                    pick("description").alias("description"),
                    pick("md5_checksum").alias("md5_checksum"),
                    pick("success").alias("success"),
                    pick("executed_at").alias("executed_at"),
                    F.when(F.coalesce(F.col("l.cleared"), F.lit(False)), F.lit(None))
                     .otherwise(F.col("h.repaired_at")).cast("timestamp_ntz").alias("repaired_at")))


def unrecorded(log: DataFrame) -> DataFrame:
    """Attempts whose history row can't be written, with the reason: their
    version lies above the stored column's range.  Together with the attempts
    that the fold takes in, they account for every row of the log."""
    return (log.where(F.col("version") > schemas.MAX_STORED_VERSION)
            .select("event_id", *KEY, "direction", "success",
                    F.format_string("version %d is out of range, the highest recorded version is %d",
                                    F.col("version"), F.lit(schemas.MAX_STORED_VERSION)).alias("reason")))


def apply_ups(history: DataFrame, log: DataFrame) -> DataFrame:
    """Upsert the outcomes of UP attempts (M1); another direction in the log
    is an error."""
    up = F.when(F.col("direction") == "UP", F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("apply_ups takes UP attempts only, got "), F.col("direction"))).cast("boolean"))
    return fold_history(log.where(up), history)


def apply_rollbacks(history: DataFrame, log: DataFrame) -> DataFrame:
    """Delete rows rolled back by a successful DOWN attempt (M2).

    A DOWN of a version that is not in the history is a no-op, a failed DOWN
    leaves the row in place.
    """
    gone = (log.where((F.col("direction") == "DOWN") & F.col("success"))
            .select(*KEY))
    return _as_history(history).join(gone, KEY, "left_anti")


def latest_version(history: DataFrame, targets: DataFrame) -> DataFrame:
    """Highest successfully applied version per target, 0 if none (A1).

    Failed rows and gaps are ignored: {1 ok, 5 ok, 7 failed} gives 5.  Targets
    without any history row get 0.  The history is reduced to one row per
    target before it meets ``targets``.
    """
    top = history.groupBy("target_id").agg(
        F.max(F.when(F.col("success"), F.col("version"))).alias("latest"))
    return (targets.select("target_id").join(top, "target_id", "left")
            .select("target_id", F.coalesce("latest", F.lit(0)).cast("int").alias("latest_version")))


def failing(history: DataFrame) -> DataFrame:
    """History rows of unsuccessful attempts (P5)."""
    return (history.where(~F.col("success"))
            .select("target_id", "version", "description", "md5_checksum"))


def repair(history: DataFrame, scripts: DataFrame, targets: DataFrame,
           as_of: _dt.datetime | Column, reset_success: bool = True) -> DataFrame:
    """Rewrite the history so every local UP script counts as applied (M4).

    Per target, every UP script of its project is upserted:
    new key -> success, ``executed_at`` and ``repaired_at`` = ``as_of``;
    existing key -> description and checksum replaced, ``repaired_at`` = ``as_of``
    only if one of them differed.  ``reset_success=True`` also marks existing
    rows successful (one supported driver does, the other keeps the value).
    History rows without a local script are kept as they are.  A target whose
    history table does not exist is left alone (optional ``history_exists``
    column of ``targets``; without it every target has a table).

    The targets x scripts product is the size of the result itself, so its
    rows are made where they are written (see :func:`_lacking`); what is
    shuffled grows with the history, the scripts and the targets' blocks of
    versions.
    """
    met, lacking = _repair_parts(history, scripts, targets)
    return _repaired(met, as_of, reset_success).unionByName(_repaired(lacking, as_of, reset_success))


def fold_after_repair(log: DataFrame, history: DataFrame, scripts: DataFrame, targets: DataFrame,
                      as_of: _dt.datetime | Column, reset_success: bool = True) -> DataFrame:
    """``fold_history(log, repair(history, scripts, targets, as_of))``: the log
    is folded into those rows of the repair whose key the history or the log
    holds, and no other row of the repair goes through a shuffle."""
    met, lacking = _repair_parts(history, scripts, targets, log.select(*KEY))
    return (fold_history(log, _repaired(met, as_of, reset_success))
            .unionByName(_repaired(lacking, as_of, reset_success)))


def _repair_parts(history: DataFrame, scripts: DataFrame, targets: DataFrame,
                  others: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The full outer join of the history ``h`` and the targets' scripts ``s``
    on KEY, in two parts: the keys that the history (or ``others``) holds, and
    the rows of all other scripts."""
    h, recorded, t = _as_history(history), _recorded(scripts), _repair_targets(targets)
    keys = h.select(*KEY) if others is None else h.select(*KEY).unionByName(others.select(*KEY))
    wanted = _wanted_at(keys, recorded, t).alias("s")
    return h.alias("h").join(wanted, KEY, "full_outer"), _lacking(keys, recorded, t)


def _wanted_at(keys: DataFrame, recorded: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets' scripts at the given keys only."""
    return (keys.distinct().join(targets, "target_id").join(recorded, ["project", "version"])
            .select(*KEY, "s_description", "s_md5"))


def _lacking(keys: DataFrame, recorded: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets' scripts ``s`` at all but the given keys, beside an empty
    history row ``h``.

    A target's keys are reduced to version words, and each of its blocks of
    versions is one row with these words.  Such rows meet the scripts of their
    project's block, dealt by a salt so that a project of very many targets is
    no hot key; the product comes out of this join and isn't shuffled again."""
    block = F.shiftright("version", 6 + BLOCK_WORDS.bit_length() - 1).alias("_block")
    place = F.shiftright("version", 6).bitwiseAND(F.lit(BLOCK_WORDS - 1))
    words = [F.bit_or(F.when(place == i, bitmaps._bit("version"))).alias(f"_word{i}") for i in range(BLOCK_WORDS)]
    held = keys.groupBy("target_id", block).agg(*words)
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes make many rows: not coalesced
    rows = (targets.join(recorded.select("project", block).distinct(), "project")
            .join(held, ["target_id", "_block"], "left")
            .withColumn("_salt", F.pmod(F.xxhash64("target_id"), F.lit(SALTS)).cast("int"))
            .repartition(tasks, "project", "_block", "_salt"))
    dealt = recorded.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")) \
        .repartition(tasks, "project", "_block", "_salt")
    word = F.lit(0).cast("long")
    for i in range(BLOCK_WORDS):
        word = F.when(place == i, F.col(f"_word{i}")).otherwise(word)
    there = F.getbit(F.coalesce(word, F.lit(0).cast("long")), F.col("version").bitwiseAND(F.lit(bitmaps.WORD - 1))) == 1
    new = rows.join(dealt, ["project", "_block", "_salt"]).where(~there)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.HISTORY.fields if f.name not in KEY]
    s = F.struct("s_description", "s_md5").alias("s")
    return new.select(*KEY, s, F.struct(*none).alias("h"))


def _recorded(scripts: DataFrame) -> DataFrame:
    """The UP script of each (project, version) that a repair records."""
    # versions above the stored range cannot be written; those upserts fail alone
    # copies of a version are upserted in path order, so the last one stays
    order = next(c for c in ("path", "file_name", "description") if c in scripts.columns)
    return (scripts.where((F.col("direction") == "UP") & (F.col("version") <= schemas.MAX_STORED_VERSION))
            .groupBy("project", "version")
            .agg(F.max_by(F.struct("description", "md5_checksum"), F.struct(order, "description", "md5_checksum"))
                 .alias("_s"))
            .select("project", "version", F.col("_s.description").alias("s_description"),
                    F.col("_s.md5_checksum").alias("s_md5")))


def _repair_targets(targets: DataFrame) -> DataFrame:
    if "history_exists" in targets.columns:
        targets = targets.where(F.col("history_exists"))
    return targets.select("target_id", "project")


def _repaired(j: DataFrame, as_of: _dt.datetime | Column, reset_success: bool) -> DataFrame:
    """The rows of a repair from history rows ``h`` joined with scripts ``s``."""
    # text -> TIMESTAMP_NTZ is independent of the session time zone
    now = as_of if isinstance(as_of, Column) else F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    has_script = F.col("s.s_md5").isNotNull()
    existed = F.col("h.md5_checksum").isNotNull()
    differs = ((F.col("s.s_description") != F.col("h.description"))
               | (F.col("s.s_md5") != F.col("h.md5_checksum")))
    success = F.col("h.success") if not reset_success else F.lit(True)
    return j.select(
        *KEY,
        F.when(has_script, F.col("s.s_description")).otherwise(F.col("h.description")).alias("description"),
        F.when(has_script, F.col("s.s_md5")).otherwise(F.col("h.md5_checksum")).alias("md5_checksum"),
        F.when(has_script & ~existed, F.lit(True))
         .when(has_script, success).otherwise(F.col("h.success")).alias("success"),
        F.when(existed, F.col("h.executed_at")).otherwise(now).alias("executed_at"),
        F.when(has_script & ~existed, now)
         .when(has_script & differs, now)
         .otherwise(F.col("h.repaired_at")).cast("timestamp_ntz").alias("repaired_at"),
    )


def _fingerprint(rows: DataFrame, key: str, description: str, md5: str, prefix: str) -> DataFrame:
    """Per ``key`` the fingerprint of its set of (version, description,
    checksum): their number and two sums of 64-bit hashes.  Partial sums are
    made in every task; two different sets agree with a probability of about
    2^-128, and equal sets always do."""
    hashes = [F.xxhash64("version", description, md5), F.xxhash64(F.lit(1), "version", description, md5)]
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"{prefix}n"), *[
        F.sum(h.cast("decimal(20,0)")).alias(f"{prefix}{i}") for i, h in enumerate(hashes)])


def differing_targets(history: DataFrame, scripts: DataFrame, targets: DataFrame,
                      succeeded_only: bool = False) -> DataFrame:
    """``target_id, project`` of the targets whose history isn't exactly their
    project's UP scripts, told by the fingerprints of both sets: one row a
    target meets one row a project, no history row meets a script.

    ``succeeded_only``: a failed row counts as not there."""
    rows = history.where(F.col("success")) if succeeded_only else history
    have = _fingerprint(rows, "target_id", "description", "md5_checksum", "h")
    want = _fingerprint(_recorded(scripts), "project", "s_description", "s_md5", "s")
    same = F.lit(True)
    for c in ("n", "0", "1"):
        same = same & F.col(f"h{c}").eqNullSafe(F.col(f"s{c}"))
    return (_repair_targets(targets).join(want, "project").join(have, "target_id", "left")
            .where(~same).select("target_id", "project"))


def repair_changes(history: DataFrame, scripts: DataFrame, targets: DataFrame,
                   as_of: _dt.datetime | Column, reset_success: bool = True) -> DataFrame:
    """The rows that :func:`repair` adds or changes, and only these; what it
    leaves alone is not written again (see :func:`apply_changes`).

    Targets whose history equals their scripts are found by fingerprints and
    left out, so in a fleet where few targets differ the targets x scripts
    product is that of these few.  A history with rows beyond its scripts
    differs too; its rows are compared one by one.  Exact but for the
    fingerprints' 2^-128 (see :func:`_fingerprint`).

    Runs one job when called: the differing targets go into the shared
    checkpoint folder, so that the history is compared once, and up to
    ``BROADCAST_TARGETS`` of them are sent to its rows."""
    checkpoint_dir(history.sparkSession)
    differing = differing_targets(history, scripts, targets, reset_success).checkpoint(eager=True)
    recorded, ids = _recorded(scripts), differing.select("target_id")
    if ids.count() <= BROADCAST_TARGETS:
        ids = F.broadcast(ids)
    h = _as_history(history.join(ids, "target_id", "left_semi"))
    j = _wanted_at(h.select(*KEY), recorded, differing).alias("s").join(h.alias("h"), KEY)
    new = F.col("h.md5_checksum").isNull()
    changed = ((F.col("s.s_description") != F.col("h.description")) | (F.col("s.s_md5") != F.col("h.md5_checksum")))
    if reset_success:
        changed = changed | ~F.col("h.success")
    lacking = _lacking(h.select(*KEY), recorded, differing)
    return (_repaired(j.where(new | changed), as_of, reset_success)
            .unionByName(_repaired(lacking, as_of, reset_success)))


def apply_changes(history: DataFrame, changes: DataFrame) -> DataFrame:
    """A history with changed and new rows in place of those of the same key."""
    return _as_history(history).join(changes.select(*KEY), KEY, "left_anti").unionByName(changes.select(*HISTORY_COLS))
