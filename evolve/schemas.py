"""Fixed schemas of the library's tables."""

from pyspark.sql import types as T

# Limits of the file-name fields and of the stored version.
MAX_VERSION = 65535          # versions are parsed as 16-bit unsigned numbers
MAX_HOOK_ORDER = 255         # hook orders are parsed as 8-bit unsigned numbers
MAX_STORED_VERSION = 32767   # the history column is a SMALLINT

HISTORY = T.StructType([
    T.StructField("target_id", T.LongType(), False),
    T.StructField("version", T.IntegerType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("md5_checksum", T.StringType(), False),
    T.StructField("success", T.BooleanType(), False),
    T.StructField("executed_at", T.TimestampNTZType(), False),
    T.StructField("repaired_at", T.TimestampNTZType(), True),
])

LOG = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("target_id", T.LongType(), False),
    T.StructField("version", T.IntegerType(), False),
    T.StructField("direction", T.StringType(), False),   # UP | DOWN, or a hook type
    T.StructField("description", T.StringType(), True),
    T.StructField("md5_checksum", T.StringType(), True),
    T.StructField("success", T.BooleanType(), False),
    T.StructField("executed_at", T.TimestampNTZType(), False),
])

# One row per script (migration) of a project.
SCRIPTS = T.StructType([
    T.StructField("project", T.StringType(), False),
    T.StructField("direction", T.StringType(), False),   # UP | DOWN
    T.StructField("version", T.IntegerType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("file_name", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("md5_checksum", T.StringType(), True),  # UP only
])

HOOKS = T.StructType([
    T.StructField("project", T.StringType(), False),
    T.StructField("hook_type", T.StringType(), False),
    T.StructField("hook_order", T.IntegerType(), False),
    T.StructField("hook_version", T.IntegerType(), True),  # BEFORE_VERSION / AFTER_VERSION only
    T.StructField("file_name", T.StringType(), False),
    T.StructField("content", T.StringType(), True),
])

TARGETS = T.StructType([
    T.StructField("target_id", T.LongType(), False),
    T.StructField("project", T.StringType(), False),
    T.StructField("down", T.BooleanType(), False),
    T.StructField("destination", T.IntegerType(), True),
])

PROBLEMS = T.StructType([
    T.StructField("target_id", T.LongType(), False),
    T.StructField("stage", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("version", T.IntegerType(), True),
    T.StructField("message", T.StringType(), False),
])
