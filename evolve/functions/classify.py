"""File-name classification of script folders (column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evolve.schemas import MAX_HOOK_ORDER, MAX_VERSION

# File-name patterns, one per kind.  Group 1 is the version of a
# migration, the order of a hook or the name of a template; *_VERSION hooks
# carry the version in group 2.
PATTERNS = {
    "UP": r"^V(\d+)_([^.]+)\.sql$",
    "DOWN": r"^V(\d+)_([^.]+)\.down\.sql$",
    "REPEATABLE": r"^R(\d+)_([^.]+)\.sql$",
    "REPEATABLE_DOWN": r"^R(\d+)_([^.]+)\.down\.sql$",
    "BEFORE": r"^B(\d+)_([^.]+)\.sql$",
    "BEFORE_EACH": r"^BE(\d+)_([^.]+)\.sql$",
    "BEFORE_VERSION": r"^BV(\d+)_(\d+)_([^.]+)\.sql$",
    "AFTER": r"^A(\d+)_([^.]+)\.sql$",
    "AFTER_EACH": r"^AE(\d+)_([^.]+)\.sql$",
    "AFTER_VERSION": r"^AV(\d+)_(\d+)_([^.]+)\.sql$",
    "TEMPLATE": r"^([^.]+)\.template\.sql$",
}
MIGRATION_KINDS = ("UP", "DOWN")
VERSIONED_HOOKS = ("BEFORE_VERSION", "AFTER_VERSION")
HOOK_KINDS = ("REPEATABLE", "REPEATABLE_DOWN", "BEFORE", "BEFORE_EACH", "BEFORE_VERSION",
              "AFTER", "AFTER_EACH", "AFTER_VERSION")

# Fixed value: the parse error text of an out-of-range number.
MSG_RANGE = 'strconv.ParseUint: parsing "%s": value out of range'


# The eleven patterns share one shape: a letter prefix, a number, "_", a name
# without dots, an optional ".down", ".sql" (versioned hooks carry a second
# number at the front of the name).  One regex splits a file name into these
# parts, so a name is scanned once instead of once per pattern; the kind then
# follows from the parts.  tests/test_classify.py checks that the result
# equals matching the eleven patterns one by one.
SHAPE = r"^(BV|AV|BE|AE|V|R|B|A)(\d+)_([^.]+)(\.down)?\.sql$"
VERSIONED_NAME = r"^(\d+)_([^.]+)$"
PREFIX_KIND = {"V": "UP", "R": "REPEATABLE", "B": "BEFORE", "BE": "BEFORE_EACH", "BV": "BEFORE_VERSION",
               "A": "AFTER", "AE": "AFTER_EACH", "AV": "AFTER_VERSION"}
DOWN_KIND = {"V": "DOWN", "R": "REPEATABLE_DOWN"}


_SEP = "\u0000"  # cannot occur in a file name


def _parts(name: Column) -> Column:
    """Split a name into its shape parts with one regex evaluation."""
    joined = F.regexp_replace(name, SHAPE, _SEP.join(["$1", "$2", "$3", "$4", "x"]))
    a = F.split(joined, _SEP)
    ok = F.size(a) == 5
    rest = F.when(ok, a[2]).otherwise(F.lit(""))
    second = F.split(F.regexp_replace(rest, VERSIONED_NAME, "$1" + _SEP + "$2" + _SEP + "x"), _SEP)
    vok = F.size(second) == 3
    return F.struct(
        F.when(ok, a[0]).otherwise(F.lit("")).alias("_prefix"),
        F.when(ok, a[1]).alias("_number"),
        rest.alias("_rest"),
        (ok & (a[3] != "")).alias("_down"),
        F.when(vok, second[0]).otherwise(F.lit("")).alias("_second"),
        F.when(vok, second[1]).alias("_second_rest"),
        F.regexp_extract(name, PATTERNS["TEMPLATE"], 1).alias("_template"),
    )


def _kind(p) -> Column:
    prefix, down = p["_prefix"], p["_down"]
    expr = F.when(p["_template"] != "", F.lit("TEMPLATE"))
    for pre, kind in DOWN_KIND.items():
        expr = expr.when((prefix == pre) & down, F.lit(kind))
    expr = expr.when(down, F.lit(None))
    for pre, kind in PREFIX_KIND.items():
        cond = prefix == pre
        if kind in VERSIONED_HOOKS:
            cond = cond & (p["_second"] != "")
        expr = expr.when(cond, F.lit(kind))
    return expr


def kind_of(name: Column) -> Column:
    """Kind of a file name, NULL when no pattern matches (the file is ignored)."""
    parts = _parts(name)
    return _kind({f: parts[f] for f in ("_prefix", "_down", "_second", "_template")})


def classify_files(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Add kind, parsed numbers and range checks to a listing of files.

    Output columns added: ``kind``, ``category`` (migration / hook / template),
    ``version`` (migrations and *_VERSION hooks), ``hook_order`` (hooks),
    ``description`` (migrations and hooks; template name for templates),
    the raw digit strings ``number_text`` / ``version_text`` and ``valid``
    (every parsed number in its range).  Files matching no pattern are dropped.
    """
    # The parts come out of a 1:1 generator (LATERAL VIEW inline): filters on
    # anything derived from them stop there instead of copying the parse.
    parts = ["_prefix", "_number", "_rest", "_down", "_second", "_second_rest", "_template"]
    df = files.select("*", F.inline(F.array(_parts(F.col(name_col)))))
    p = {c: F.col(c) for c in parts}
    df = df.withColumn("kind", _kind(p)).where(F.col("kind").isNotNull())
    kind = F.col("kind")
    versioned = kind.isin(*VERSIONED_HOOKS)
    is_mig = kind.isin(*MIGRATION_KINDS)
    is_hook = kind.isin(*HOOK_KINDS)
    is_tpl = kind == "TEMPLATE"
    df = df.select(
        *[c for c in df.columns if c not in parts],
        F.when(is_mig, "migration").when(is_hook, "hook").otherwise("template").alias("category"),
        F.when(~is_tpl, p["_number"]).alias("number_text"),
        F.when(versioned, p["_second"]).alias("version_text"),
        F.when(versioned, p["_second_rest"]).when(is_tpl, p["_template"]).otherwise(p["_rest"])
        .alias("description"),
    )
    num = F.col("number_text").try_cast("bigint")
    ver = F.col("version_text").try_cast("bigint")
    num_ok = num.isNotNull() & (num <= F.when(is_mig, MAX_VERSION).otherwise(MAX_HOOK_ORDER))
    ver_ok = F.col("version_text").isNull() | (ver.isNotNull() & (ver <= MAX_VERSION))
    return df.select(
        *[c for c in df.columns if c not in ("number_text", "version_text")],
        F.when(is_mig & num_ok, num).when(versioned & ver_ok, ver).cast("int").alias("version"),
        F.when(is_hook & num_ok, num).cast("int").alias("hook_order"),
        "number_text", "version_text",
        (is_tpl | (num_ok & ver_ok)).alias("valid"),
    )


def invalid_files(classified: DataFrame) -> DataFrame:
    """Files whose version or order does not fit its field.

    A hook's order is checked before its version; the message is the parse
    error of the number that failed.  Any such file makes its project's load
    fail, whatever the run flags select.
    """
    kind = F.col("kind")
    is_mig = kind.isin(*MIGRATION_KINDS)
    num = F.col("number_text").try_cast("bigint")
    num_ok = num.isNotNull() & (num <= F.when(is_mig, MAX_VERSION).otherwise(MAX_HOOK_ORDER))
    field = F.when(~num_ok & is_mig, "version").when(~num_ok, "order").otherwise("version")
    bad_text = F.when(num_ok, F.col("version_text")).otherwise(F.col("number_text"))
    return (classified.where(~F.col("valid"))
            .select("project", "file_name", "kind", field.alias("field"), bad_text.alias("value_text"),
                    F.format_string(MSG_RANGE, bad_text).alias("message")))
