"""Results of the size targets x scripts leave the join that makes them without another shuffle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from evolve import fixtures as fx
from evolve import queries
from evolve.functions import classify as cls
from evolve.operators import checks
from evolve.operators import history as hist
from evolve.operators import scripts as scr
from evolve.plans import planning as pl

NOW = dt.datetime(2024, 3, 1)
LOG = ("event_id long, target_id long, version int, direction string, description string, md5_checksum string, "
       "success boolean, executed_at timestamp_ntz")
SCRIPTS = "project string, direction string, version int, description string, md5_checksum string"
HISTORY = ("target_id long, version int, description string, md5_checksum string, success boolean, "
           "executed_at timestamp_ntz, repaired_at timestamp_ntz")
TARGETS, N = 150, 600


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_and_shuffled(df):
    """The number of result rows, and of rows written to shuffles on the way."""
    execution = df._jdf.queryExecution()
    rows = execution.toRdd().count()

    def shuffled(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return shuffled(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return shuffled(plan.plan())
        n = plan.metrics().get("shuffleRecordsWritten").get().value() if name == "ShuffleExchangeExec" else 0
        return n + sum(shuffled(plan.children().apply(i)) for i in range(plan.children().size()))
    return rows, shuffled(execution.executedPlan())


def fleet(spark):
    project = F.expr("if(id >= 0, 'p', 'q')").alias("project")  # no constant
    s = spark.range(1, N + 1).select(project, F.lit("UP").alias("direction"),
                                     F.col("id").cast("int").alias("version"), F.lit("d").alias("description"),
                                     F.md5(F.col("id").cast("string")).alias("md5_checksum"))
    t = spark.range(TARGETS).select(F.col("id").alias("target_id"), project)
    h = t.select("target_id", F.lit(3).alias("version"), F.lit("d").alias("description"), F.lit("old").alias("md5_checksum"),
                 F.lit(False).alias("success"), F.lit(NOW).cast("timestamp_ntz").alias("executed_at"),
                 F.lit(None).cast("timestamp_ntz").alias("repaired_at"))
    return h, s, t


@pytest.mark.parametrize("name", ["repair", "repair_changes", "changes_after_repair", "fold_after_repair"])
def test_repair_shuffles_no_product(spark, no_broadcast, name):
    h, s, t = fleet(spark)
    if name == "fold_after_repair":
        log = h.select(F.col("target_id").alias("event_id"), "target_id", F.lit(5).alias("version"), F.lit("DOWN").alias("direction"),
                       "description", "md5_checksum", F.lit(True).alias("success"), "executed_at")
        df, n = hist.fold_after_repair(log, h, s, t, NOW), TARGETS * (N - 1)
    elif name == "changes_after_repair":
        half = hist.repair(h, s, t.where("target_id % 2 = 0"), NOW)
        df, n = hist.repair_changes(half, s, t, NOW, False), TARGETS // 2 * N
    else:
        df, n = getattr(hist, name)(h, s, t, NOW), TARGETS * N
    rows, shuffled = rows_and_shuffled(df)
    assert rows == n and shuffled < n / 3


@pytest.mark.parametrize("reset", [True, False])
def test_parts_make_the_outer_join(spark, reset):
    """Repeated targets and history keys, nulls, high versions: as the plain join gives them."""
    s = spark.createDataFrame([("p", "UP", v, "d", f"m{v}" if v % 5 else None) for v in (0, 1, 2, 5, 63, 64, 255, 256, 300, 1023, 32767, 40000)]
                              + [("q", "UP", 2, "e", "n2"), ("q", "UP", 70, None, "n70"), ("q", "DOWN", 3, "e", None), (None, "UP", 1, "d", "x")], SCRIPTS)
    t = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p"), (2, "p"), (3, "q"), (4, "none"), (None, "p"), (5, None), (7, "p")],
                              "target_id long, project string")
    h = spark.createDataFrame([(i, v, "d", m, (i or 0) % 2 == 0, NOW, None) for i in (1, 2, 3, 4, 5, 6, None)
                               for v, m in ((1, "m1"), (2, "old"), (2, "old"), (256, None), (300, "m300"), (500, "x"), (None, "m"))], HISTORY)
    log = spark.createDataFrame([(i, i % 8 or None, v, "DOWN" if i % 3 == 0 else "UP", "l", "ml", i % 2 == 0, NOW)
                                 for i, v in enumerate([0, 1, 2, 3, 64, 256, 300, 500, 900, 1023, 2, 2, 40000, 70, 70, 5])], LOG)

    def listed(df):
        return sorted(map(tuple, df.collect()), key=repr)

    wanted = t.join(hist._recorded(s), "project").drop("project")
    plain = hist._repaired(h.alias("h").join(wanted.alias("s"), hist.KEY, "full_outer"), NOW, reset)
    assert listed(hist.repair(h, s, t, NOW, reset)) == listed(plain)
    assert listed(hist.fold_after_repair(log, h, s, t, NOW, reset)) == listed(hist.fold_history(log, plain))
    differing = hist.differing_targets(h, s, t, reset)
    j = differing.join(hist._recorded(s), "project").alias("s").join(
        h.join(differing.select("target_id"), "target_id", "left_semi").alias("h"), hist.KEY, "left")
    changed = F.expr("h.md5_checksum is null or s.s_description <> h.description or s.s_md5 <> h.md5_checksum")
    changed = changed | ~F.col("h.success") if reset else changed
    assert listed(hist.repair_changes(h, s, t, NOW, reset)) == listed(hist._repaired(j.where(changed), NOW, reset))


def downs(spark, versions, project="p"):
    return spark.createDataFrame([(project, "DOWN", v, f"{v}", p) for v, p in versions],
                                 "project string, direction string, version int, file_name string, path string")


def test_plan_down_shuffles_no_product(spark, no_broadcast):
    s = downs(spark, [(v, f"{v}") for v in range(1, N + 1)])
    hooks = spark.createDataFrame([("p", "REPEATABLE_DOWN", 1, None, "r")],
                                  "project string, hook_type string, hook_order int, hook_version int, file_name string")
    acts = spark.range(TARGETS).select(F.col("id").alias("target_id"), F.lit("p").alias("project"), F.lit(True).alias("down"),
                                       F.lit(N).alias("latest_version"), F.lit(0).alias("destination"), F.lit("run").alias("action"))
    rows, shuffled = rows_and_shuffled(pl.plan_down(acts, s, hooks))
    assert rows == TARGETS * (2 * N - 1) and shuffled < rows / 3


def test_plan_down_of_copies(spark):
    """Copies of a version, repeated paths, null paths and a range's ends, step by step."""
    versions = [(0, "z"), (1, "a"), (1, "a"), (1, "b"), (2, None), (2, None), (4, "d"), (4, "c"), (300, "x"), (300, "x"), (None, "n"), (70000, "far")]
    order = [(2, "h2"), (1, "h1"), (1, "h0")]
    runs = [(i, lo, hi) for i, (lo, hi) in enumerate([(0, 300), (0, 1), (1, 4), (3, 4), (-3, 2), (-1, 299), (2, 3), (299, 80000), (5, 5), (3, 300)])]
    hooks = spark.createDataFrame([("p", "REPEATABLE_DOWN", o, None, n) for o, n in order],
                                  "project string, hook_type string, hook_order int, hook_version int, file_name string")
    acts = spark.createDataFrame([(i, "p", True, hi, lo, "run") for i, lo, hi in runs],
                                 "target_id long, project string, down boolean, latest_version int, destination int, action string")
    want = []
    for i, lo, hi in runs:
        mine = [(v, p) for v, p in versions if v is not None and lo < v <= min(hi, 65535) and v >= 0]
        steps = [(-v, p or "", 0, 0, f"{v}") for v, p in mine] + [(-v, p or "", 1, o, n) for v, p in mine if v > lo + 1 for o, n in order]
        want += [(i, k, "REPEATABLE_DOWN" if x[2] else "DOWN", -x[0], x[4]) for k, x in enumerate(sorted(steps), 1)]
    got = sorted(map(tuple, pl.plan_down(acts, downs(spark, versions), hooks).collect()))
    assert got == sorted(want)


def test_problems_of_a_project_are_many_tasks(spark, no_broadcast):
    """One project's problems meet its targets in every task, copies included."""
    h, s, t = fleet(spark)
    gappy = s.where("version % 3 = 0").unionByName(s.where("version = 6"))
    invalid = spark.createDataFrame([("p", "70000")] * 40, "project string, message string")
    for df, kind, n in ((checks.problems(h, gappy, t, invalid), "local_gap", N // 3 + 1), (checks.problems(h, gappy, t, invalid), "load", 40),
                        (checks.gate_problems(h.withColumn("success", F.lit(True)), gappy, t), "local_gap", N // 3 + 1),
                        (checks.gate_problems(h, gappy, t, invalid), "load", 40)):
        per = df.where(F.col("kind") == kind).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in per) == n * TARGETS
        assert max(r["count"] for r in per) < n * TARGETS * 2 / 3


@pytest.mark.parametrize("piece", [512, 4])
def test_every_target_as_the_plain_join(spark, monkeypatch, piece):
    """Repeated targets and rows, nulls, projects on one side only, more targets and rows than a piece holds."""
    monkeypatch.setattr(checks, "PIECE", piece)
    t = spark.createDataFrame([(i, "p") for i in range(30)] + [(7, "p"), (7, "p"), (None, "p"), (None, "p"), (1, "q"), (2, "none"), (3, None)],
                              "target_id long, project string")
    r = spark.createDataFrame([("p", i, f"m{i}") for i in range(40)] + [("p", 70000, "far")] * 9
                              + [("p", None, None), ("p", None, None), ("q", 1, "x"), ("other", 1, "y"), (None, 1, "z")],
                              "project string, got int, message string")
    columns = ["project", "target_id", "got", "message"]
    got, plain = (sorted(map(tuple, df.select(*columns).collect()), key=repr)
                  for df in (checks._of_every_target(t, r), t.join(r, "project")))
    assert got == plain and len(got) > 1000
    empty = t.where("target_id > 100")
    assert checks._of_every_target(empty, r).count() == checks._of_every_target(t, r.where("got < 0")).count() == 0


def wide(spark):
    """One project: 2,000 targets with a row each, one local gap, 300 out-of-range files."""
    project = F.expr("if(id >= 0, 'p', 'q')").alias("project")
    t = spark.range(2000).select(F.col("id").alias("target_id"), project)
    h = t.select("target_id", F.lit(1).alias("version"), F.lit("d").alias("description"), F.lit("m").alias("md5_checksum"),
                 F.lit(True).alias("success"), F.lit(NOW).cast("timestamp_ntz").alias("executed_at"),
                 F.lit(None).cast("timestamp_ntz").alias("repaired_at"))
    s = spark.createDataFrame([("p", "UP", 1, "d", "m"), ("p", "UP", 3, "d", "m3")], SCRIPTS)
    return h, s, t, spark.range(300).select(project, F.concat(F.lit("m"), "id").alias("message"))


@pytest.mark.parametrize("name, n", [("problems", 602_000), ("gate_problems", 600_000)])
def test_problems_shuffle_few_rows(spark, no_broadcast, name, n):
    """Targets and rows meet as arrays: what is shuffled is small beside both, not targets x pieces."""
    rows, shuffled = rows_and_shuffled(getattr(checks, name)(*wide(spark)))
    assert rows == n and shuffled < 60_000


def test_load_sends_failed_projects_to_the_files(spark, no_broadcast):
    """Texts aren't shuffled to find out whose project fails."""
    files = spark.range(3000).select(
        F.expr("if(id % 3 = 0, 'bad', 'good')").alias("project"), F.format_string("V%d_x.sql", F.col("id") * 30).alias("file_name"),
        F.col("id").cast("string").alias("path"), F.lit("select 1").alias("content"))
    c = cls.classify_files(files.where("id * 30 <= 65535 or id % 3 = 0"))
    rows, shuffled = rows_and_shuffled(scr.loadable(scr.migrations_of(c), c))
    assert rows == 2 * 65535 // 90 and shuffled < 100


def test_folders_are_derived_once(spark):
    """The checks of the loaded folders read what was written, not the tables again."""
    for df in queries._folders(spark, SF_SMALL):
        assert not [f for f in df.inputFiles() if SF_SMALL in f]
        assert df.count() > 0


def test_files_of_one_source_are_many_tasks(spark, no_broadcast, tmpdir_path):
    """Texts of a source that holds every document are ranked in several tasks, as a plain window ranks them."""
    docs = spark.range(40_000).select((F.col("id") * 3 - 500).alias("doc_id"), F.lit("a").alias("text"), F.lit("en").alias("lang"),
                                      F.lit("src0").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = fx.files(spark, tmpdir_path)
        per = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per) == 40_000 and max(per) < 30_000
        assert files.where("(rn - 1) * 3 - 500 != doc_id").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
