"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query derives its inputs from the given tables with ``evolve.fixtures``
and runs one library operator over them.  ``evolve.oracle.SQL`` holds the
matching DuckDB statement under the same name.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evolve import fixtures as fx
from evolve.functions import classify as cls
from evolve.functions.templates import expand_templates
from evolve.operators import bitmaps, checks
from evolve.operators import history as hist
from evolve.operators import scripts as scr
from evolve.plans import planning as pl
from evolve.plans.effects import effective_steps
from evolve.plans.migrate import migrate_table
from evolve.session import checkpoint_dir
from evolve.sources import databases, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


@register("fold_history")
def q_fold_history(spark, sf):
    return hist.fold_history(fx.log(spark, sf))


@register("latest_version")
def q_latest_version(spark, sf):
    return hist.latest_version(fx.history(spark, sf), fx.targets(spark, sf))


def _main(spark, sf):
    return fx.history(spark, sf), fx.scripts(spark, sf), fx.targets(spark, sf)


def _mini(spark, sf):
    return fx.mini_history(spark, sf), fx.mini_scripts(spark, sf), fx.mini_targets(spark, sf)


@register("failing")
def q_failing(spark, sf):
    return hist.failing(fx.history(spark, sf))


@register("history_gaps")
def q_history_gaps(spark, sf):
    return checks.history_gaps(*_main(spark, sf))


@register("history_gap_ranges")
def q_history_gap_ranges(spark, sf):
    return checks.history_gap_ranges(*_main(spark, sf))


@register("version_words")
def q_version_words(spark, sf):
    return bitmaps.version_words(fx.history(spark, sf))


@register("gap_ranges_by_words")
def q_gap_ranges_by_words(spark, sf):
    return bitmaps.history_gap_ranges(bitmaps.version_words(fx.history(spark, sf)))


@register("gap_ranges_merged")
def q_gap_ranges_merged(spark, sf):
    h = fx.mini_history(spark, sf)
    two = [bitmaps.version_words(h.where(F.col("version") % 3 == 0)), bitmaps.version_words(h.where(F.col("version") % 3 != 0))]
    return bitmaps.history_gap_ranges(bitmaps.merge_words(*two))


@register("latest_by_words")
def q_latest_by_words(spark, sf):
    return bitmaps.latest_versions(bitmaps.version_words(fx.history(spark, sf)), fx.targets(spark, sf))


@register("drift")
def q_drift(spark, sf):
    return checks.drift(*_main(spark, sf))


@register("drift_detail")
def q_drift_detail(spark, sf):
    return checks.drift_detail(*_main(spark, sf))


@register("drift_reasons")
def q_drift_reasons(spark, sf):
    return checks.drift_detail(*_mini(spark, sf))


@register("status")
def q_status(spark, sf):
    return checks.status(*_main(spark, sf))


@register("gate")
def q_gate(spark, sf):
    return checks.gate(*_mini(spark, sf))


@register("all_problems")
def q_all_problems(spark, sf):
    return checks.problems(*_mini(spark, sf))


@register("gate_problems")
def q_gate_problems(spark, sf):
    return checks.gate_problems(*_mini(spark, sf))


def _classified(spark, sf):
    return cls.classify_files(fx.files(spark, sf))


@register("classify_files")
def q_classify_files(spark, sf):
    return _classified(spark, sf).select("project", "file_name", "path", "kind", "category", "version",
                                         "hook_order", "description", "valid")


@register("invalid_files")
def q_invalid_files(spark, sf):
    return cls.invalid_files(_classified(spark, sf))


@register("select_scripts")
def q_select_scripts(spark, sf):
    m = scr.migrations_of(_classified(spark, sf))
    return scr.select_scripts(m, down=False).select("project", "direction", "version", "description", "path")


@register("select_hooks_up")
def q_select_hooks_up(spark, sf):
    h = scr.hooks_of(_classified(spark, sf))
    return scr.select_hooks(h, down=False).select("project", "hook_type", "hook_order", "hook_version", "path")


@register("select_hooks_down")
def q_select_hooks_down(spark, sf):
    h = scr.hooks_of(_classified(spark, sf))
    return scr.select_hooks(h, down=True).select("project", "hook_type", "hook_order", "hook_version", "path")


@register("ordered_scripts")
def q_ordered_scripts(spark, sf):
    m = scr.migrations_of(_classified(spark, sf)).drop("content")  # keys only through the ranking
    return scr.ordered_scripts(m).select("project", "direction", "version", "path", "position")


@register("ordered_hooks")
def q_ordered_hooks(spark, sf):
    h = scr.hooks_of(_classified(spark, sf)).drop("content")
    return scr.ordered_hooks(h).select("project", "hook_type", "hook_order", "path", "position")


@register("local_gaps")
def q_local_gaps(spark, sf):
    return checks.local_gaps(scr.migrations_of(_classified(spark, sf)))


@register("next_version")
def q_next_version(spark, sf):
    return scr.next_version(_classified(spark, sf), "next_change")


@register("expand_templates")
def q_expand_templates(spark, sf):
    scripts, templates = fx.template_uses(spark, sf)
    return expand_templates(scripts, templates).select("project", "doc_id", "content")


@register("checksum")
def q_checksum(spark, sf):
    c = _classified(spark, sf)
    up = c.where((F.col("kind") == "UP") & F.col("valid"))
    used = up.select("project", "path", "version",
                     F.concat("content", F.lit(" {{"), "lang", F.lit(", "), "project", F.lit("}}"))
                     .alias("content"))
    expanded = expand_templates(used, scr.templates_of(c))
    return expanded.select("project", "path", "version", F.md5("content").alias("md5_checksum"))


def _used_files(spark, sf):
    """The classified files; every one ends with a template use."""
    use = F.concat(F.lit(" {{"), "lang", F.lit(", "), "project", F.lit("}}"))
    return _classified(spark, sf).withColumn("content", F.concat("content", use))


def _twice(c):
    """Every script folder twice: whole, and as '<project>-sound' without its
    out-of-range files."""
    return c.unionByName(c.where("valid").withColumn("project", F.concat("project", F.lit("-sound"))))


def _folder_files(spark, sf):
    return _twice(_used_files(spark, sf))


def _written(spark, df):
    """``df``, written once as Parquet into the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _folders(spark, sf):
    """History, loaded scripts, targets and out-of-range files of the script
    folders.  The checks use each of them several times, and the load reads its
    files several times, so the history, the targets and the files are written
    once (with the texts that the load reads: those of UP scripts and
    templates), and so is the load (keys and checksums, no text)."""
    text = F.when(F.col("kind").isin("UP", "TEMPLATE") & F.col("valid"), F.col("content"))
    c = _twice(_written(spark, _used_files(spark, sf).withColumn("content", text)))
    loaded = scr.load_scripts(c).drop("content").checkpoint()
    return (_written(spark, fx.history(spark, sf)), loaded, _written(spark, fx.file_targets(spark, sf)),
            cls.invalid_files(c).checkpoint())


@register("load_scripts")
def q_load_scripts(spark, sf):
    return scr.load_scripts(_folder_files(spark, sf), down=True).select(
        "project", "direction", "version", "path", F.length("content").alias("n_chars"), "md5_checksum")


@register("load_hooks")
def q_load_hooks(spark, sf):
    return scr.load_hooks(_folder_files(spark, sf), use_after_each=False).select(
        "project", "hook_type", "hook_order", "hook_version", "path", F.length("content").alias("n_chars"))


@register("gate_problems_loaded")
def q_gate_problems_loaded(spark, sf):
    return checks.gate_problems(*_folders(spark, sf))


@register("run_action_loaded")
def q_run_action_loaded(spark, sf):
    h, s, t, invalid = _folders(spark, sf)
    return (pl.run_action(t, h, s, invalid=invalid)
            .select("target_id", "project", "latest_version", "destination", "action"))


@register("run_action_gate_loaded")
def q_run_action_gate_loaded(spark, sf):
    """The load failure passed on by the gate alone."""
    h, s, t, invalid = _folders(spark, sf)
    return (pl.run_action(t, h, s, gate=checks.gate(h, s, t, invalid))
            .select("target_id", "project", "latest_version", "destination", "action"))


@register("all_problems_loaded")
def q_all_problems_loaded(spark, sf):
    return checks.problems(*_folders(spark, sf))


@register("gate_loaded")
def q_gate_loaded(spark, sf):
    return checks.gate(*_folders(spark, sf))


@register("status_loaded")
def q_status_loaded(spark, sf):
    return checks.status(*_folders(spark, sf))


def _fleet_scripts(spark, sf, skip_tens=False):
    cols = ["project", "direction", "version", "description", "file_name"]
    return fx.scripts(spark, sf).select(*cols).unionByName(
        fx.down_scripts(spark, sf, skip_tens).select(*cols))


def _actions(spark, sf, skip_tens=False):
    return pl.run_action(fx.targets(spark, sf), fx.history(spark, sf), _fleet_scripts(spark, sf, skip_tens))


@register("run_action")
def q_run_action(spark, sf):
    return _actions(spark, sf).select("target_id", "down", "latest_version", "destination", "action")


@register("pending_up")
def q_pending_up(spark, sf):
    return pl.pending_up(_actions(spark, sf), _fleet_scripts(spark, sf)).select("target_id", "version")


@register("pending_down")
def q_pending_down(spark, sf):
    return pl.pending_down(_actions(spark, sf), _fleet_scripts(spark, sf), fx.history(spark, sf)) \
        .select("target_id", "version", "applied")


@register("missing_down")
def q_missing_down(spark, sf):
    return pl.missing_down(_actions(spark, sf, True), _fleet_scripts(spark, sf, True), fx.history(spark, sf))


@register("missing_down_by_words")
def q_missing_down_by_words(spark, sf):
    return bitmaps.missing_downs(bitmaps.version_words(fx.history(spark, sf)), _actions(spark, sf, True),
                                 _fleet_scripts(spark, sf, True))


@register("plan_up")
def q_plan_up(spark, sf):
    return pl.plan_up(_actions(spark, sf), _fleet_scripts(spark, sf), fx.hooks(spark, sf))


@register("plan_down")
def q_plan_down(spark, sf):
    return pl.plan_down(_actions(spark, sf, True), _fleet_scripts(spark, sf, True), fx.down_hooks(spark, sf))


SPLIT = _dt.datetime(2024, 1, 16)     # the log is applied in two batches: before / from this time
REPAIR_AT = _dt.datetime(2024, 2, 1)  # "now" of the repair runs
LOG_COLS = ["event_id", "target_id", "version", "direction", "success", "executed_at"]


def _halves(spark, sf):
    lg = fx.log(spark, sf)
    split = F.lit(SPLIT.isoformat(sep=" ")).cast("timestamp_ntz")  # time-zone free
    return lg.where(F.col("executed_at") < split), lg.where(F.col("executed_at") >= split)


@register("apply_ups")
def q_apply_ups(spark, sf):
    first, second = _halves(spark, sf)
    return hist.apply_ups(hist.fold_history(first), second.where(F.col("direction") == "UP"))


@register("unrecorded")
def q_unrecorded(spark, sf):
    return hist.unrecorded(fx.far_log(spark, sf))


@register("apply_rollbacks")
def q_apply_rollbacks(spark, sf):
    first, second = _halves(spark, sf)
    return hist.apply_rollbacks(hist.fold_history(first), second)


@register("fold_incremental")
def q_fold_incremental(spark, sf):
    first, second = _halves(spark, sf)
    return hist.fold_history(second, hist.fold_history(first))


@register("fold_after_repair")
def q_fold_after_repair(spark, sf):
    first, second = _halves(spark, sf)
    return hist.fold_after_repair(second, hist.fold_history(first), fx.scripts(spark, sf), fx.targets(spark, sf), SPLIT)


@register("repair_reset")
def q_repair_reset(spark, sf):
    return hist.repair(fx.history(spark, sf), fx.scripts(spark, sf), fx.targets(spark, sf), REPAIR_AT, True)


@register("repair_keep")
def q_repair_keep(spark, sf):
    return hist.repair(fx.history(spark, sf), fx.scripts(spark, sf), fx.targets(spark, sf), REPAIR_AT, False)


@register("repair_changes_reset")
def q_repair_changes_reset(spark, sf):
    return hist.repair_changes(fx.history(spark, sf), fx.scripts(spark, sf), fx.targets(spark, sf), REPAIR_AT, True)


@register("repair_changes_keep")
def q_repair_changes_keep(spark, sf):
    return hist.repair_changes(fx.half_repaired(spark, sf), fx.scripts(spark, sf), fx.targets(spark, sf), REPAIR_AT, False)


@register("stored_history")
def q_stored_history(spark, sf):
    """Two batches of the log applied to a history stored in buckets."""
    name = f"stored_history_{uuid.uuid4().hex}"
    tables.ensure_bucketed_history(spark, name, 16, f"{checkpoint_dir(spark).rstrip('/')}/{name}")
    for batch in _halves(spark, sf):
        tables.apply_log(spark, batch, name)
    return spark.table(name).drop(tables.BUCKET)


@register("imported_history")
def q_imported_history(spark, sf):
    """Every target's history, stored on its own, read back as one fleet: a
    target's Parquet folder stands for its database."""
    def rows_of(folder):
        import pyarrow.parquet as pq
        columns = ["version", "description", "md5_checksum", "success", "executed_at", "repaired_at"]
        return zip(*(c.to_pylist() for c in pq.read_table(folder, columns=columns, partitioning=None).columns))

    path = f"{checkpoint_dir(spark).rstrip('/')}/histories-{uuid.uuid4().hex}"
    h = fx.history(spark, sf)
    # tasks move their own folders into place; nobody else knows this path before the job has ended
    (h.repartition("target_id").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
     .partitionBy("target_id").parquet(path))
    folder = path.removeprefix("file:")
    ids = [r.target_id for r in h.select("target_id").distinct().collect()]  # the configuration of an import
    found = databases.read_histories(spark, [(i, f"{folder}/target_id={i}") for i in ids], rows_of, 16)
    return databases.imported_history(found)


@register("effective_failfast")
def q_effective_failfast(spark, sf):
    return effective_steps(fx.log(spark, sf)).select(*LOG_COLS)


@register("effective_atomic")
def q_effective_atomic(spark, sf):
    return effective_steps(fx.log(spark, sf), in_transaction=True).select(*LOG_COLS)


@register("effective_hooks")
def q_effective_hooks(spark, sf):
    return effective_steps(fx.hook_log(spark, sf)).select(*LOG_COLS)


@register("fold_hooks")
def q_fold_hooks(spark, sf):
    return hist.fold_history(effective_steps(fx.hook_log(spark, sf), in_transaction=True))


@register("migrate_orders_up")
def q_migrate_orders_up(spark, sf):
    return migrate_table(spark, fx.table(spark, sf, "orders"), fx.orders_changes(), 0, 3).table


@register("migrate_orders_down")
def q_migrate_orders_down(spark, sf):
    up = migrate_table(spark, fx.table(spark, sf, "orders"), fx.orders_changes(), 0, 3).table
    return migrate_table(spark, up, fx.orders_changes(), 3, 1).table


@register("migrate_lineitem_up")
def q_migrate_lineitem_up(spark, sf):
    changes, hooks = fx.lineitem_changes()
    return migrate_table(spark, fx.table(spark, sf, "lineitem"), changes, 0, 3, hooks=hooks).table


@register("run_action_gated")
def q_run_action_gated(spark, sf):
    h, s, t = _mini(spark, sf)
    t = t.select("target_id", "project", F.lit(False).alias("down"), F.lit(None).cast("int").alias("destination"))
    return (pl.run_action(t, h, s, gate=checks.gate(h, s, t))
            .select("target_id", "latest_version", "destination", "action"))
