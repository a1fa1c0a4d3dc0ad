"""Run planning for a fleet: destination, action, pending versions, and the
ordered step list (scripts and hooks) each target would execute.

Range joins.  "UP scripts with latest < version <= destination" has no
equi-key besides the project, which is low-cardinality.  Versions are cut into
blocks of ``VERSION_BLOCK``; each target's range is exploded to the blocks it
touches (at most 65536 / VERSION_BLOCK = 256) and joined to the scripts on
(project, block), the exact bounds staying a residual filter.  That is an
ordinary hash join whose output is the result plus at most two partial blocks
per target, instead of a nested loop or a per-project cross product.

Step numbers.  ``plan_up``: ``row_number`` per target over the plan: a window
partition holds one target's plan, at most (65536 versions x hooks per version)
rows.  ``plan_down`` numbers a project's steps once, with such a window per
project, and a target's steps are a run of them, so its plans (targets x
scripts) come out of the range join without a shuffle after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evolve import schemas
from evolve.operators.checks import STAGE_LOAD
from evolve.operators.history import latest_version
from evolve.operators.scripts import select_hooks

VERSION_BLOCK = 256

# position of each step type inside one version of an up run
PHASE = {"REPEATABLE": 1, "BEFORE_EACH": 2, "BEFORE_VERSION": 3, "UP": 4, "AFTER_VERSION": 5, "AFTER_EACH": 6,
         "BEFORE": 0, "AFTER": 0}

ACTIONS = ("load_failed", "no_scripts", "blocked", "up_to_date", "up_below_current", "down_above_current", "run")


def _script_stats(scripts: DataFrame) -> DataFrame:
    return scripts.groupBy("project").agg(
        F.count_if(F.col("direction") == "UP").alias("n_up"),
        F.count_if(F.col("direction") == "DOWN").alias("n_down"),
        F.max(F.when(F.col("direction") == "UP", F.col("version"))).alias("max_up"))


def run_action(targets: DataFrame, history: DataFrame, scripts: DataFrame,
               gate: DataFrame | None = None, invalid: DataFrame | None = None) -> DataFrame:
    """What a run of each target does.

    Destination: up -> given or the highest local UP version; down -> given
    or 0.  Action, first match wins: ``load_failed`` (the project has an
    ``invalid`` file, as :func:`evolve.functions.classify.invalid_files` gives
    them, or its ``gate`` stopped at the load), ``no_scripts`` (none in the run's
    direction), ``blocked`` (validation stage failed; only with ``gate``),
    ``up_to_date``, ``up_below_current``, ``down_above_current``, ``run``.
    Only ``run`` executes anything; ``load_failed`` and ``blocked`` are errors.
    """
    latest = latest_version(history, targets)
    t = (targets.select("target_id", "project", "down", "destination")
         .join(latest, "target_id")
         .join(_script_stats(scripts), "project", "left"))
    down = F.col("down")
    dest = F.when(down, F.coalesce("destination", F.lit(0))) \
        .otherwise(F.coalesce("destination", "max_up")).cast("int")
    t = t.withColumn("resolved", dest)
    no_scripts = F.when(down, F.coalesce("n_down", F.lit(0)) < 1).otherwise(F.coalesce("n_up", F.lit(0)) < 1)
    blocked = broken = F.lit(False)
    if gate is not None:
        t = t.join(gate.select("target_id", F.col("stage").alias("_stage")), "target_id", "left")
        blocked = F.coalesce(F.col("_stage"), F.lit(0)) > 0
        broken = F.coalesce(F.col("_stage") == STAGE_LOAD, F.lit(False))
    if invalid is not None:
        t = t.join(invalid.select("project").distinct().withColumn("_broken", F.lit(True)), "project", "left")
        broken = broken | F.coalesce("_broken", F.lit(False))
    latest_c = F.col("latest_version")
    action = (F.when(broken, "load_failed")
              .when(no_scripts, "no_scripts")
              .when(blocked, "blocked")
              .when(latest_c == F.col("resolved"), "up_to_date")
              .when(~down & (F.col("resolved") < latest_c), "up_below_current")
              .when(down & (F.col("resolved") > latest_c), "down_above_current")
              .otherwise("run"))
    return t.select("target_id", "project", "down", "latest_version",
                    F.col("resolved").alias("destination"), action.alias("action"))


def versions_in_range(ranges: DataFrame, scripts: DataFrame, lo: str, hi: str) -> DataFrame:
    """Join ``ranges`` (project, lo, hi, ...) to ``scripts`` (project, version,
    ...) on ``lo <= version <= hi`` through version blocks (see module doc)."""
    block = lambda c: F.floor(c / VERSION_BLOCK).cast("int")
    # no script lies outside 0..MAX_VERSION, so a range is cut to it first
    first = F.greatest(F.col(lo), F.lit(0))
    last = F.least(F.col(hi), F.lit(schemas.MAX_VERSION))
    tasks = int(scripts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes make many rows: not coalesced
    r = (ranges.where(first <= last)
         .withColumn("_block", F.explode(F.sequence(block(first), block(last))))
         .repartition(tasks, "project", "_block"))
    s = scripts.withColumn("_block", block(F.col("version"))).repartition(tasks, "project", "_block")
    return (r.join(s, ["project", "_block"])
            .where(F.col("version").between(F.col(lo), F.col(hi)))
            .drop("_block"))


def _path(scripts: DataFrame):
    """What orders copies of a version: the path, where scripts carry it."""
    return F.col("path") if "path" in scripts.columns else F.col("file_name")


def _runs(actions: DataFrame, down: bool) -> DataFrame:
    return actions.where((F.col("action") == "run") & (F.col("down") == F.lit(down)))


def pending_up(actions: DataFrame, scripts: DataFrame) -> DataFrame:
    """UP scripts an up run applies: latest < version <= destination."""
    r = _runs(actions, False).select("target_id", "project",
                                     (F.col("latest_version") + 1).alias("_lo"),
                                     F.col("destination").alias("_hi"))
    s = scripts.where(F.col("direction") == "UP").select("project", "version", "description", "file_name",
                                                        _path(scripts).alias("path"))
    return versions_in_range(r, s, "_lo", "_hi").drop("_lo", "_hi")


def pending_down(actions: DataFrame, scripts: DataFrame, history: DataFrame) -> DataFrame:
    """DOWN scripts a down run visits, destination < version <= latest (J7),
    with ``applied``: the version has a history row (otherwise the rollback is
    a silent no-op)."""
    r = _runs(actions, True).select("target_id", "project",
                                    (F.col("destination") + 1).alias("_lo"),
                                    F.col("latest_version").alias("_hi"))
    s = scripts.where(F.col("direction") == "DOWN").select("project", "version", "description", "file_name")
    p = versions_in_range(r, s, "_lo", "_hi").drop("_lo", "_hi")
    applied = history.select("target_id", "version", F.lit(True).alias("_applied"))
    return (p.join(applied, ["target_id", "version"], "left")
            .withColumn("applied", F.coalesce("_applied", F.lit(False))).drop("_applied"))


def missing_down(actions: DataFrame, scripts: DataFrame, history: DataFrame) -> DataFrame:
    """Applied versions inside a down run's range without a DOWN script (J8):
    the run leaves them in place without a word."""
    r = _runs(actions, True).select("target_id", "project", "destination", "latest_version")
    h = history.select("target_id", "version").join(r, "target_id") \
        .where((F.col("version") > F.col("destination")) & (F.col("version") <= F.col("latest_version")))
    d = scripts.where(F.col("direction") == "DOWN").select("project", "version").distinct()
    return h.join(d, ["project", "version"], "left_anti").select("target_id", "version")


def plan_up(actions: DataFrame, scripts: DataFrame, hooks: DataFrame, **flags) -> DataFrame:
    """Ordered steps of every up run.

    All BEFORE hooks; then per version ascending: REPEATABLE (not before
    version 1), BEFORE_EACH, BEFORE_VERSION of that version, the script,
    AFTER_VERSION, AFTER_EACH; finally all AFTER hooks.  Hooks run in order
    inside their type.  BEFORE / AFTER run even when no version is pending.
    ``flags`` are the ``use_*`` switches of :func:`select_hooks`.
    """
    runs = _runs(actions, False).select("target_id", "project")
    pend = pending_up(actions, scripts).select("target_id", "project", "version",
                                              F.col("file_name").alias("_script"), F.col("path").alias("_path"))
    h = select_hooks(hooks, down=False, **flags).select("project", "hook_type", "hook_order", "hook_version",
                                                        "file_name")
    # phase of each hook type inside a version; BEFORE / AFTER wrap the run
    phase = F.try_element_at(F.create_map(*[F.lit(x) for kv in PHASE.items() for x in kv]), F.col("hook_type"))
    h = h.withColumn("_phase", phase)
    per_version = h.where(F.col("_phase") > 0)
    around = h.where(F.col("hook_type").isin("BEFORE", "AFTER"))

    # versioned hooks meet their version by an equi-join; the others go with
    # every version (a row of the plan each), REPEATABLE not before version 1
    hv = per_version.select(F.col("project").alias("_h_project"), F.col("hook_type").alias("kind"),
                            F.col("hook_order").alias("_order"), F.col("hook_version").alias("_h_version"),
                            F.col("file_name").alias("name"), "_phase")
    same_project = F.col("project") == F.col("_h_project")
    fitting = (F.col("kind") != "REPEATABLE") | (F.col("version") > 1)
    of_version = pend.join(hv.where(F.col("_h_version").isNotNull()),
                           same_project & (F.col("version") == F.col("_h_version")) & fitting)
    of_all = pend.join(hv.where(F.col("_h_version").isNull()), same_project & fitting)
    vh = (of_version.unionByName(of_all)
          .select("target_id", F.lit(1).alias("_block"), "version", F.col("_path").alias("_script_key"),
                  "_phase", "_order", "kind", "name"))
    sv = pend.select("target_id", F.lit(1).alias("_block"), "version", F.col("_path").alias("_script_key"),
                     F.lit(PHASE["UP"]).alias("_phase"), F.lit(0).alias("_order"), F.lit("UP").alias("kind"),
                     F.col("_script").alias("name"))
    ba = (runs.join(around, "project")
          .select("target_id", F.when(F.col("hook_type") == "BEFORE", 0).otherwise(2).alias("_block"),
                  F.lit(None).cast("int").alias("version"), F.lit(None).cast("string").alias("_script_key"),
                  F.lit(0).alias("_phase"), F.col("hook_order").alias("_order"),
                  F.col("hook_type").alias("kind"), F.col("file_name").alias("name")))
    allp = ba.unionByName(vh).unionByName(sv)
    w = Window.partitionBy("target_id").orderBy("_block", "version", "_script_key", "_phase", "_order", "name")
    return allp.select("target_id", F.row_number().over(w).cast("int").alias("step"), "kind",
                       F.col("version").cast("int").alias("version"), "name")


def plan_down(actions: DataFrame, scripts: DataFrame, hooks: DataFrame, use_repeatable: bool = True) -> DataFrame:
    """Ordered steps of every down run (W5): DOWN scripts by version
    descending; after each one whose version > destination + 1, the
    REPEATABLE_DOWN hooks (they run even when the rollback was a no-op).
    No BEFORE / AFTER hooks run downwards."""
    r = _runs(actions, True).select("target_id", "project",
                                    (F.col("destination") + 1).alias("_lo"),
                                    F.col("latest_version").alias("_hi"))
    h = select_hooks(hooks, down=True, use_repeatable=use_repeatable).select("project", "hook_order", "file_name")
    steps = _numbered_downs(scripts, h)
    r = r.join(_above(steps, r.select("project", F.col("_hi").alias("version"))), ["project", "_hi"])
    lowest = F.col("version") == F.col("_lo")  # its hooks don't run, so its scripts follow each other
    number = F.when(lowest, F.col("_before") + F.col("_bare")).otherwise(F.col("_position")) - F.col("_above")
    return (versions_in_range(r, steps, "_lo", "_hi").where(~lowest | (F.col("_phase") == 0))
            .select("target_id", number.cast("int").alias("step"), "kind",
                    F.col("version").cast("int").alias("version"), "name"))


def _numbered_downs(scripts: DataFrame, hooks: DataFrame) -> DataFrame:
    """The steps of a down run over a project's whole range, hooks after every
    script: ``_position`` of each, and of a version's scripts without hooks the
    steps ``_before`` that version and their place ``_bare`` in it."""
    s = (scripts.where((F.col("direction") == "DOWN") & F.col("version").between(0, schemas.MAX_VERSION))
         .select("project", "version", _path(scripts).alias("_path"), F.col("file_name").alias("_script")))
    rows = (s.select("project", "version", "_path", F.lit(0).alias("_phase"), F.lit(0).alias("_order"),
                     F.lit("DOWN").alias("kind"), F.col("_script").alias("name"))
            .unionByName(s.join(hooks, "project")
                         .select("project", "version", "_path", F.lit(1).alias("_phase"), F.col("hook_order").alias("_order"),
                                 F.lit("REPEATABLE_DOWN").alias("kind"), F.col("file_name").alias("name"))))
    order = ["_path", "_phase", "_order", "name"]
    whole = Window.partitionBy("project").orderBy(F.col("version").desc(), *order)
    of_version = Window.partitionBy("project", "version")
    return (rows.withColumn("_position", F.row_number().over(whole))
            .withColumn("_before", F.min("_position").over(of_version) - 1)
            .withColumn("_bare", F.row_number().over(of_version.orderBy("_phase", *order))))


def _above(steps: DataFrame, tops: DataFrame) -> DataFrame:
    """How many of a project's steps lie ``_above`` each version ``_hi`` that
    any of its targets stands at: one row a version, however many targets."""
    counts = steps.groupBy("project", "version").agg(F.count(F.lit(1)).alias("_n"))
    marks = (counts.unionByName(tops.distinct().withColumn("_n", F.lit(0).cast("long")))
             .groupBy("project", "version").agg(F.sum("_n").alias("_n")))
    higher = Window.partitionBy("project").orderBy(F.col("version").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return marks.select("project", F.col("version").alias("_hi"),
                        F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_above"))
