"""Script and hook sets of projects: split a classified listing into
migrations / hooks / templates, select what a run loads, checksum, order.

Inputs are classified listings (``evolve.functions.classify.classify_files``)
with at least ``project, file_name, path, content``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolve.functions.classify import invalid_files
from evolve.functions.ranking import rank_by_counts
from evolve.functions.templates import expand_templates

HOOK_FLAGS = {
    "REPEATABLE": "use_repeatable",
    "BEFORE": "use_before",
    "BEFORE_EACH": "use_before_each",
    "BEFORE_VERSION": "use_before_version",
    "AFTER": "use_after",
    "AFTER_EACH": "use_after_each",
    "AFTER_VERSION": "use_after_version",
}


def migrations_of(classified: DataFrame) -> DataFrame:
    """Migration files with parsed numbers in range."""
    return (classified.where((F.col("category") == "migration") & F.col("valid"))
            .select("project", F.col("kind").alias("direction"), "version", "description",
                    "file_name", "path", "content"))


def hooks_of(classified: DataFrame) -> DataFrame:
    return (classified.where((F.col("category") == "hook") & F.col("valid"))
            .select("project", F.col("kind").alias("hook_type"), "hook_order",
                    F.col("version").alias("hook_version"), "description", "file_name", "path", "content"))


def templates_of(classified: DataFrame) -> DataFrame:
    return (classified.where(F.col("kind") == "TEMPLATE")
            .select("project", F.col("description").alias("name"), F.col("content").alias("body"), "path"))


def loadable(df: DataFrame, classified: DataFrame) -> DataFrame:
    """Keep rows of projects whose load succeeds (no out-of-range file).  The
    failed projects, one name each, are sent to the rows: these hold texts, and
    on ``project`` all texts of a folder would be shuffled into one task."""
    failed = invalid_files(classified).select("project").distinct()
    return df.join(F.broadcast(failed), "project", "left_anti")


def with_checksum(scripts: DataFrame) -> DataFrame:
    """Lower-case hex MD5 of the (expanded) content, UP scripts only (F1)."""
    return scripts.withColumn(
        "md5_checksum", F.when(F.col("direction") == "UP", F.md5(F.col("content"))))


def load_scripts(classified: DataFrame, down: bool = False) -> DataFrame:
    """Migrations as a run loads them: selected by direction, templates
    expanded, checksummed; projects with an invalid file load nothing."""
    m = select_scripts(loadable(migrations_of(classified), classified), down)
    m = expand_templates(m, templates_of(classified))
    return with_checksum(m)


def load_hooks(classified: DataFrame, down: bool = False, **flags) -> DataFrame:
    """Hooks as a run loads them: selected by the flags, templates expanded."""
    h = select_hooks(loadable(hooks_of(classified), classified), down, **flags)
    return expand_templates(h, templates_of(classified))


def select_scripts(scripts: DataFrame, down: bool = False) -> DataFrame:
    """UP scripts always, DOWN scripts only for a down run."""
    return scripts if down else scripts.where(F.col("direction") == "UP")


def select_hooks(hooks: DataFrame, down: bool = False, use_repeatable: bool = True,
                 use_before: bool = True, use_before_each: bool = True, use_before_version: bool = True,
                 use_after: bool = True, use_after_each: bool = True,
                 use_after_version: bool = True) -> DataFrame:
    """Hooks a run loads (P4): a down run only REPEATABLE_DOWN (if repeatable
    hooks are on); an up run each type by its own flag, never REPEATABLE_DOWN."""
    if down:
        kinds = ["REPEATABLE_DOWN"] if use_repeatable else []
    else:
        flags = dict(use_repeatable=use_repeatable, use_before=use_before, use_before_each=use_before_each,
                     use_before_version=use_before_version, use_after=use_after,
                     use_after_each=use_after_each, use_after_version=use_after_version)
        kinds = [k for k, f in HOOK_FLAGS.items() if flags[f]]
    return hooks.where(F.col("hook_type").isin(*kinds)) if kinds else hooks.where(F.lit(False))


def ordered_scripts(scripts: DataFrame) -> DataFrame:
    """Position of each script in its run order (O1): UP ascending, DOWN
    descending by version; copies of a version ordered by path.  A counting
    sort over the versions (one pass for both directions: DOWN counts on the
    negated version), so many copies of one version still spread over tasks."""
    signed = F.when(F.col("direction") == "DOWN", -F.col("version")).otherwise(F.col("version"))
    return rank_by_counts(scripts, ["project", "direction"], signed, "path", "position")


def ordered_hooks(hooks: DataFrame) -> DataFrame:
    """Position of each hook inside its type (O2): by order, ties by path."""
    return rank_by_counts(hooks, ["project", "hook_type"], "hook_order", "path", "position")


def next_version(classified: DataFrame, name: str) -> DataFrame:
    """Latest local UP version per project (0 if none), the next one and the
    file names a new script (and its optional DOWN script) get (A2, P6).
    ``%03d`` pads, it never cuts."""
    up = F.when((F.col("kind") == "UP") & F.col("valid"), F.col("version"))
    return (classified.groupBy("project")
            .agg(F.coalesce(F.max(up), F.lit(0)).cast("int").alias("latest_local"),
                 F.bool_or((F.col("kind") == "UP") & ~F.col("valid")).alias("has_invalid"))
            .select("project", "latest_local", (F.col("latest_local") + 1).cast("int").alias("next_version"),
                    F.format_string("V%03d_%s.sql", F.col("latest_local") + 1, F.lit(name)).alias("new_file_name"),
                    F.format_string("V%03d_%s.down.sql", F.col("latest_local") + 1, F.lit(name))
                    .alias("new_down_file_name"),
                    "has_invalid"))
