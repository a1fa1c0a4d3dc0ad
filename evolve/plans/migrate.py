"""Versioned change of a Spark table (X1-X4): move a DataFrame from one
version to another by applying the UP (or DOWN) change of every version in
between, with hooks in the same order a database run uses.

A change is SELECT-style text run as ``spark.sql(text, t=df)`` (``{t}`` is the
table at the previous version) or a ``DataFrame -> DataFrame`` callable.  The
whole chain stays one logical plan, so Catalyst fuses it: projections merge,
filters reach the scan, unused columns are pruned.

A step fails when it doesn't resolve, or when its rows can't be computed.  The
second only shows when the chain runs: at a cut (``checkpoint_every``, into
the session's shared checkpoint folder) or when a version is published.  A
chain that fails there is run again from the last good state, step by step, to
name the step; so the outcome doesn't depend on where the cuts lie.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from evolve.session import checkpoint_dir

# Error texts of failing hooks and rollbacks.
MSG_HOOK = "error executing hook %d_%s: %s"
MSG_VERSIONED_HOOK = "error executing versioned hook %d_%d_%s: %s"
MSG_ROLLBACK = "error rolling back migration %d: %s"

RUN_ERRORS = (PySparkException, Py4JJavaError)

Transform = str | Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Change:
    version: int
    up: Transform
    down: Transform | None = None
    description: str = ""


@dataclass(frozen=True)
class Hook:
    hook_type: str            # BEFORE, BEFORE_EACH, BEFORE_VERSION, AFTER_VERSION, AFTER_EACH, AFTER,
    order: int                # REPEATABLE, REPEATABLE_DOWN
    transform: Transform
    version: int | None = None  # BEFORE_VERSION / AFTER_VERSION only
    name: str = ""


@dataclass
class Outcome:
    """``log``: (step, kind, version, name, success, error) of every attempt.
    ``table`` is the start table if the run was rolled back."""
    table: DataFrame
    log: list[tuple] = field(default_factory=list)
    checksums: dict[int, str] = field(default_factory=dict)  # of the UP changes
    rows: dict[int, int] = field(default_factory=dict)       # written per published version, if the publisher counts
    rolled_back: bool = False

    @property
    def errors(self) -> list[str]:
        return [error for *_, success, error in self.log if not success]

    @property
    def success(self) -> bool:
        return not self.errors

    def log_frame(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([
            T.StructField("step", T.IntegerType()), T.StructField("kind", T.StringType()),
            T.StructField("version", T.IntegerType()), T.StructField("name", T.StringType()),
            T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType()),
            T.StructField("rows", T.LongType())])
        written = [self.rows.get(v) if k in ("UP", "DOWN") and ok else None for _, k, v, _, ok, _ in self.log]
        return spark.createDataFrame([(*entry, n) for entry, n in zip(self.log, written)], schema)


@dataclass(frozen=True)
class Step:
    kind: str                 # UP, DOWN or a hook type
    version: int | None
    name: str
    transform: Transform
    order: int | None = None  # hooks only

    def error(self, cause: Exception) -> str:
        """The error as a run reports it."""
        if self.kind == "UP":
            return str(cause)
        if self.kind == "DOWN":
            return MSG_ROLLBACK % (self.version, cause)
        if self.kind in ("BEFORE_VERSION", "AFTER_VERSION"):
            return MSG_VERSIONED_HOOK % (self.order, self.version, self.kind, cause)
        return MSG_HOOK % (self.order, self.kind, cause)


def apply_transform(spark: SparkSession, df: DataFrame, transform: Transform) -> DataFrame:
    if callable(transform):
        return transform(df)
    return spark.sql(transform, t=df)


def _in_order(hooks: list[Hook]) -> list[Hook]:
    return sorted(hooks, key=lambda h: (h.order, h.name))


def steps_up(changes: list[Change], hooks: list[Hook], start: int, stop: int) -> list[Step]:
    """The steps in run order for start < version <= stop."""
    by_type: dict[str, list[Hook]] = {}
    for h in _in_order(hooks):
        by_type.setdefault(h.hook_type, []).append(h)

    def run(kind, version=None):
        return [Step(kind, version, h.name, h.transform, h.order) for h in by_type.get(kind, [])
                if version is None or h.version is None or h.version == version]

    out = run("BEFORE")
    for c in sorted(changes, key=lambda c: c.version):
        if not start < c.version <= stop:
            continue
        if c.version > 1:
            out += run("REPEATABLE")
        out += run("BEFORE_EACH")
        out += run("BEFORE_VERSION", c.version)
        out.append(Step("UP", c.version, c.description, c.up))
        out += run("AFTER_VERSION", c.version)
        out += run("AFTER_EACH")
    return out + run("AFTER")


def steps_down(changes: list[Change], hooks: list[Hook], start: int, stop: int) -> list[Step]:
    """The steps for stop < version <= start, descending; REPEATABLE_DOWN hooks
    after each one above stop + 1 (a version without a DOWN transform is
    passed over, with its hooks)."""
    rd = [h for h in _in_order(hooks) if h.hook_type == "REPEATABLE_DOWN"]
    out = []
    for c in sorted(changes, key=lambda c: -c.version):
        if not stop < c.version <= start or c.down is None:
            continue
        out.append(Step("DOWN", c.version, c.description, c.down))
        if c.version > stop + 1:
            out += [Step("REPEATABLE_DOWN", c.version, h.name, h.transform, h.order) for h in rd]
    return out


class _Chain:
    """The state of one run: the table so far, the last state whose rows were
    computed, and the steps since then."""

    def __init__(self, spark: SparkSession, df: DataFrame, force: bool, out: Outcome):
        self.spark, self.force, self.out = spark, force, out
        self.current = self.computed = df
        self.since: list[tuple[int, Step]] = []   # (its row in the log, step)

    def failed(self, row: int, step: Step, cause: Exception) -> None:
        number, kind, version, name, *_ = self.out.log[row]
        self.out.log[row] = (number, kind, version, name, False, step.error(cause))

    def apply(self, number: int, step: Step) -> bool:
        """Add a step to the plan; false if the run ends here."""
        self.out.log.append((number, step.kind, step.version, step.name, True, None))
        row = len(self.out.log) - 1
        try:
            nxt = apply_transform(self.spark, self.current, step.transform)
            nxt.schema  # resolve now: analysis errors surface here
        except AnalysisException as cause:
            self.failed(row, step, cause)
            return self.force
        self.current = nxt
        self.since.append((row, step))
        return True

    def checkpoint(self, df: DataFrame) -> DataFrame:
        checkpoint_dir(self.spark)
        return df.checkpoint()

    def compute(self, store: Callable[[DataFrame], DataFrame]) -> bool:
        """Run the steps since the last computed state, ``store`` keeps the
        result and gives the table to go on from; false if the run ends."""
        try:
            self.current = self.computed = store(self.current)
        except RUN_ERRORS:
            if not self._one_by_one():
                return False
            self.current = self.computed = store(self.computed)
        self.since = []
        return True

    def _one_by_one(self) -> bool:
        """Run each step alone from the last computed state; a failing one is
        logged and skipped, or ends the run (its later rows leave the log: they
        were never attempted)."""
        for row, step in self.since:
            try:
                self.computed = self.checkpoint(apply_transform(self.spark, self.computed, step.transform))
            except RUN_ERRORS as cause:
                self.failed(row, step, cause)
                if not self.force:
                    del self.out.log[row + 1:]
                    self.current, self.since = self.computed, []
                    return False
        self.current, self.since = self.computed, []
        return True


def migrate_table(spark: SparkSession, df: DataFrame, changes: list[Change], start: int, stop: int,
                  hooks: list[Hook] | None = None, force: bool = False, checkpoint_every: int = 0,
                  publish: Callable[[DataFrame, int], DataFrame | None] | None = None,
                  in_transaction: bool = False) -> Outcome:
    """Move ``df`` from version ``start`` to ``stop`` (either direction).

    ``force``: a failing step is logged as failed and skipped, the chain goes
    on from the last good state (X3); without it the first failure ends the
    chain.  ``in_transaction``: any failure, forced or not, rolls the run back:
    the outcome's table is ``df`` and nothing is published.

    ``publish(df, version)`` is called after each version and its AFTER hooks
    (the "each" mode of :func:`evolve.sources.tables.publish_table`), in a
    transaction once at the end; if it returns a DataFrame (the table read
    back), the chain goes on from that instead of computing it again.  Without
    it nothing is written and the caller writes the final table once.

    With ``start == stop`` there is nothing to do, so no hook runs.
    ``checkpoint_every`` > 0 runs the chain every so many steps and at its end,
    so that every failing step is known when this returns.  With 0 and no
    ``publish`` the chain only is a plan: what fails at run time fails where
    the caller uses the table.
    """
    out = Outcome(df, checksums={c.version: checksum_of(c) for c in changes})
    if start == stop:
        return out
    steps = (steps_up if stop > start else steps_down)(changes, hooks or [], start, stop)
    chain = _Chain(spark, df, force, out)
    done = -1                 # log row of the version published last

    def due() -> int:
        return max((r for r, entry in enumerate(out.log) if entry[1] in ("UP", "DOWN") and entry[4]), default=-1)

    def idle() -> bool:
        return publish is None or due() <= done or (in_transaction and not out.success)

    def store(table: DataFrame) -> DataFrame:
        nonlocal done
        if idle():            # the version that was due turned out to fail
            return table
        row = due()
        version = out.log[row][2]
        back = publish(table, version)
        done = row
        if version in getattr(publish, "rows", {}):
            out.rows[version] = publish.rows[version]
        return table if back is None else back

    def published() -> bool:
        """Publish the last version that ran, if it isn't yet."""
        return idle() or chain.compute(store)

    def run() -> None:
        for number, step in enumerate(steps, start=1):
            if step.kind in ("REPEATABLE", "BEFORE_EACH", "BEFORE_VERSION", "UP", "DOWN") and not in_transaction:
                if not published():  # a new version begins
                    break
            if not chain.apply(number, step):
                break
            if checkpoint_every and number % checkpoint_every == 0 and not chain.compute(chain.checkpoint):
                break
        if checkpoint_every and chain.since:
            chain.compute(chain.checkpoint)
        if not published():   # the last steps failed at run time: what ran before them is published
            published()

    run()
    out.rolled_back = in_transaction and not out.success
    out.table = df if out.rolled_back else chain.current
    return out


def checksum_of(change: Change) -> str:
    """MD5 of a change's UP text (of its description, if it is a function)."""
    text = change.up if isinstance(change.up, str) else f"{change.version} {change.description}"
    return hashlib.md5(text.encode()).hexdigest()


def log_as_history_events(outcome: Outcome, target_id: int, at: _dt.datetime, spark: SparkSession) -> DataFrame:
    """The attempts of an outcome as execution-log rows (X4), with the checksums
    of the changes.  Hooks are rows too (direction = hook type, version null
    unless the hook belongs to one), so that
    :func:`evolve.plans.effects.effective_steps` sees their failures;
    :func:`evolve.operators.history.fold_history` takes the UP and DOWN rows."""
    rows = [(i, target_id, v, k, n, outcome.checksums.get(v) if k in ("UP", "DOWN") else None, ok, at)
            for (i, k, v, n, ok, _) in outcome.log]
    schema = ("event_id long, target_id long, version int, direction string, description string, "
              "md5_checksum string, success boolean, executed_at timestamp_ntz")
    return spark.createDataFrame(rows, schema)
