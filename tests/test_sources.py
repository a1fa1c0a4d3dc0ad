"""Folder loading, templates, history tables."""

import os
import re

from pyspark.sql import functions as F

from evolve.functions.classify import classify_files
from evolve.functions.templates import expand_templates
from evolve.operators import history as hist
from evolve.operators.scripts import load_hooks, load_scripts
from evolve.sources.files import read_script_files
from evolve.sources.tables import ensure_history, read_history, write_history


def _write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write(text)


def test_scripts_and_hooks_of_several_folders(spark, tmpdir_path):
    billing, shop = os.path.join(tmpdir_path, "billing"), os.path.join(tmpdir_path, "shop")
    _write(billing, "V003_invoices.sql", "CREATE TABLE invoices (id INT, {{audit, billing_user}})")
    _write(billing, "audit.template.sql", "changed_by STRING DEFAULT '$1'")
    _write(billing, "A012_grants.sql", "GRANT SELECT ON invoices TO reader")
    _write(shop, "V001_customers.sql", "CREATE TABLE customers (id INT)")
    _write(shop, "AE004_stats.sql", "ANALYZE TABLE customers -- {{audit, shop_user}}")
    _write(os.path.join(shop, "archive"), "V009_old.sql", "SELECT 9")      # a sub-folder isn't the location
    c = classify_files(read_script_files(spark, {"store": [shop, billing]}))
    m = {r.version: (r.description, r.content) for r in load_scripts(c).collect()}
    assert m == {1: ("customers", "CREATE TABLE customers (id INT)"),
                 3: ("invoices", "CREATE TABLE invoices (id INT, changed_by STRING DEFAULT 'billing_user')")}
    assert all(r.md5_checksum for r in load_scripts(c).collect())
    h = {(r.hook_type, r.hook_order): r.content for r in load_hooks(c).collect()}
    assert h == {("AFTER", 12): "GRANT SELECT ON invoices TO reader",
                 ("AFTER_EACH", 4): "ANALYZE TABLE customers -- changed_by STRING DEFAULT 'shop_user'"}


def test_missing_folder_is_an_error(spark, tmpdir_path):
    import pytest
    with pytest.raises(Exception):
        read_script_files(spark, {"p": [os.path.join(tmpdir_path, "nope")]}).count()


def _tpl(spark, content, templates):
    s = spark.createDataFrame([("p", 1, content)], "project string, id int, content string")
    t = spark.createDataFrame([("p", n, b) for n, b in templates], "project string, name string, body string")
    return expand_templates(s, t).first().content


def test_templates_without_values(spark):
    got = _tpl(spark, "({{key}}, {{stamp}}, other {{key}})", [("key", "id LONG"), ("stamp", "at TIMESTAMP")])
    assert got == "(id LONG, at TIMESTAMP, other id LONG)"


def test_templates_with_values(spark):
    got = _tpl(spark, "PARTITIONED BY {{cut, day, 7, 'x y'}};", [("cut", "RANGE($1 / $2 -- $3)")])
    assert got == "PARTITIONED BY RANGE(day / 7 -- 'x y');"


def test_templates_per_use_and_ordered_substitution(spark):
    got = _tpl(spark, "{{t, a}} {{t, b}} {{unknown, x}}", [("t", "<$1>")])
    assert got == "<a> <b> {{unknown, x}}"
    # $1 is replaced before $10 is seen, and an argument holding $2 is rewritten next
    got = _tpl(spark, "{{t, A$2, B}}", [("t", "$1|$10|$2")])
    assert got == "AB|AB0|B"


def test_history_table_round_trip(spark):
    table = "hist_round_trip"
    assert read_history(spark, table).count() == 0
    ensure_history(spark, table)
    ensure_history(spark, table)
    h = read_history(spark, table)
    log = spark.createDataFrame(
        [(1, 7, 1, "UP", "one", "m1", True, "2024-01-01 00:00:00")],
        "event_id long, target_id long, version int, direction string, description string, "
        "md5_checksum string, success boolean, executed_at string") \
        .withColumn("executed_at", F.col("executed_at").cast("timestamp_ntz"))
    write_history(spark, hist.fold_history(log, h), table, buckets=4)
    assert [(r.target_id, r.version) for r in read_history(spark, table).collect()] == [(7, 1)]
    # the new snapshot may be computed from the old one
    write_history(spark, hist.fold_history(log.withColumn("version", F.lit(2)), read_history(spark, table)),
                  table, buckets=4)
    assert sorted(r.version for r in read_history(spark, table).collect()) == [1, 2]


def test_snapshot_swap_keeps_the_table_and_old_readers(spark):
    table = "hist_swap"
    ensure_history(spark, table, buckets=4)
    log = spark.createDataFrame(
        [(i, i % 3, 1 + i % 5, "UP", "d", "m", True, "2024-01-01 00:00:00") for i in range(30)],
        "event_id long, target_id long, version int, direction string, description string, "
        "md5_checksum string, success boolean, executed_at string") \
        .withColumn("executed_at", F.col("executed_at").cast("timestamp_ntz"))
    write_history(spark, hist.fold_history(log, read_history(spark, table)), table)
    first = read_history(spark, table)
    n_first = first.count()
    loc_first = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first().data_type
    write_history(spark, hist.fold_history(log.withColumn("version", F.col("version") + 10), first), table)
    info = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    assert info["Type"] == "EXTERNAL" and info["Num Buckets"] == "4" and info["Location"] != loc_first
    assert read_history(spark, table).count() == 2 * n_first
    assert first.count() == n_first  # a reader planned on the old snapshot still finds its files


def test_checksum_of_a_file_that_is_not_utf8(spark, tmpdir_path):
    import hashlib
    raw = "CRÉER TABLE café;".encode("latin-1")  # not valid UTF-8
    with open(os.path.join(tmpdir_path, "V001_latin.sql"), "wb") as fh:
        fh.write(raw)
    _write(tmpdir_path, "V002_plain.sql", "SELECT 1")
    got = {r.version: r.md5_checksum for r in load_scripts(classify_files(
        read_script_files(spark, {"p": [tmpdir_path]}))).collect()}
    assert got == {1: hashlib.md5(raw).hexdigest(), 2: hashlib.md5(b"SELECT 1").hexdigest()}


def test_locations_as_a_relation(spark, tmpdir_path):
    """Roots scanned once, folders met by a join: sub-folders, shared, silent and unlisted folders."""
    import os

    from evolve.sources.files import read_script_files, read_script_roots, silent_locations
    texts = {"a/V1_x.sql": "one", "a/sub/V2_y.sql": "two", "a/notes.md": "no", "b/V1_z.sql": "é", "c/V9_unlisted.sql": "nine"}
    for name, text in texts.items():
        os.makedirs(os.path.join(tmpdir_path, os.path.dirname(name)), exist_ok=True)
        with open(os.path.join(tmpdir_path, name), "w", encoding="utf-8") as f:
            f.write(text)
    os.makedirs(os.path.join(tmpdir_path, "empty"))
    listed = [("p", f"{tmpdir_path}/a"), ("p", f"file://{tmpdir_path}//a/sub/"), ("q", f"{tmpdir_path}/b/"),
              ("r", f"{tmpdir_path}/b"), ("r", f"{tmpdir_path}/empty"), ("r", f"{tmpdir_path}/missing"), ("q", f"{tmpdir_path}/b")]
    locations = spark.createDataFrame(listed, "project string, location string")
    files = read_script_roots(spark, [tmpdir_path], locations)
    rows = lambda df: sorted((r.project, r.file_name, r.content) for r in df.collect())
    assert rows(files) == [("p", "V1_x.sql", "one"), ("p", "V2_y.sql", "two"), ("q", "V1_z.sql", "é"), ("r", "V1_z.sql", "é")]
    assert sorted(map(tuple, silent_locations(spark, files, locations).collect())) == [
        ("r", f"{tmpdir_path}/empty"), ("r", f"{tmpdir_path}/missing")]
    # the same as the folder lists of a single project
    plain = read_script_files(spark, {"p": [f"{tmpdir_path}/a", f"{tmpdir_path}/a/sub"]})
    assert rows(plain) == [r for r in rows(files) if r[0] == "p"]
    # the scan that meets the folders reads names alone
    plan = read_script_roots(spark, [tmpdir_path], locations)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan binaryFile.*?ReadSchema: (\S+)", plan)
    assert sorted(scans) == ["struct<path:string,content:binary>", "struct<path:string>"], plan
