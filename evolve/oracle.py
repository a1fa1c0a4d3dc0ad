"""Oracle SQL (DuckDB dialect) for every registered query.

Each statement derives the fixtures of ``evolve.fixtures`` as CTEs over the
pre-registered views and states the expected result independently of the
Spark code (windows where Spark uses aggregates, NOT EXISTS where Spark uses
anti joins, ...).  Column names equal the Spark query's.
"""

from __future__ import annotations

# --- fixtures as CTEs ------------------------------------------------------

# Every document, event and conversation turn takes part (see evolve.fixtures).

_SCRIPTS = """
sources AS (
  SELECT source, count(*) AS n_docs, row_number() OVER (ORDER BY source) - 1 AS idx, count(*) OVER () AS n_src
  FROM documents GROUP BY source),
scripts AS (
  SELECT source || '/' || CAST(rn // 10000 AS VARCHAR) AS project, 'UP' AS direction,
         CAST(rn % 10000 + 1 AS INTEGER) AS version, source AS description,
         printf('V%03d_%s.sql', CAST(rn % 10000 + 1 AS INTEGER), source) AS file_name,
         text AS content, md5(text) AS md5_checksum
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn FROM documents) d)"""


def _assigned(name: str, key: str, table: str) -> str:
    """CTE: the project dealt to each key of a table, and its number of scripts."""
    return f"""
{name} AS (
  SELECT k.{key}, s.source || '/' || CAST(b AS VARCHAR) AS project,
         least(10000, s.n_docs - 10000 * b) AS size
  FROM (SELECT DISTINCT {key} FROM {table}) k JOIN sources s ON s.idx = k.{key} % s.n_src,
       LATERAL (SELECT (k.{key} // s.n_src) % CAST(ceil(s.n_docs / 10000.0) AS BIGINT) AS b) l)"""


_LOG = _assigned("dealt", "user_id", "events") + """,
log AS (
  SELECT e.event_id, e.user_id AS target_id, s.version,
         CASE WHEN e.event_id % 5 = 0 THEN 'DOWN' ELSE 'UP' END AS direction,
         s.description,
         CASE WHEN e.value > 60 THEN md5(concat(s.content, '#old')) ELSE s.md5_checksum END AS md5_checksum,
         e.event_type <> 'error' AS success, e.ts AS executed_at
  FROM events e JOIN dealt p ON p.user_id = e.user_id
  JOIN scripts s ON s.project = p.project
   AND s.version = 1 + (CAST(json_extract(e.props, '$.k') AS BIGINT) * 7919 + e.event_id) % p.size)"""

_HISTORY = """
history AS (
  SELECT target_id, version, description, md5_checksum, success, executed_at,
         CAST(NULL AS TIMESTAMP) AS repaired_at
  FROM (SELECT *, row_number() OVER (PARTITION BY target_id, version
                                     ORDER BY executed_at DESC, event_id DESC) AS rn
        FROM log WHERE NOT (direction = 'DOWN' AND NOT success) AND version <= 32767) x
  WHERE rn = 1 AND direction = 'UP')"""

_TARGETS = """
targets AS (
  SELECT user_id AS target_id, project, user_id % 6 >= 3 AS down,
         CAST(CASE user_id % 6 WHEN 1 THEN size * 9 // 10 WHEN 2 THEN size * 6 // 5 WHEN 3 THEN size * 2 // 5
              WHEN 5 THEN size * 19 // 20 END AS INTEGER) AS destination
  FROM dealt)"""

_HOOKS = """
hooks(hook_type, hook_order, hook_version, file_name) AS (
  VALUES ('BEFORE', 1, NULL, 'b1'), ('BEFORE', 2, NULL, 'b2'), ('BEFORE_EACH', 1, NULL, 'be1'),
         ('BEFORE_VERSION', 1, 8, 'bv1'), ('AFTER_VERSION', 1, 8, 'av1'), ('AFTER_EACH', 1, NULL, 'ae1'),
         ('AFTER', 1, NULL, 'a1'), ('REPEATABLE', 1, NULL, 'r1'))"""

_MINI = _SCRIPTS + "," + _assigned("convs", "conv_id", "conversations") + """,
mini_scripts AS (
  SELECT project, version, description, md5_checksum FROM scripts
  UNION ALL SELECT project || '-gappy', version, description, md5_checksum FROM scripts WHERE version <> 4),
mini_targets AS (
  SELECT conv_id AS target_id, CASE WHEN conv_id % 4 = 0 THEN project || '-gappy' ELSE project END AS project
  FROM convs),
mini_history AS (
  SELECT c.conv_id AS target_id, c.version, coalesce(d.description, 'lost')
           || CASE WHEN length(c.text) % 31 = 0 THEN '_old' ELSE '' END AS description,
         CASE WHEN length(c.text) % 23 = 0 THEN md5(c.text)
              ELSE coalesce(d.md5_checksum, md5(concat(c.text, '#lost'))) END AS md5_checksum,
         length(c.text) % 29 <> 0 AS success
  FROM (SELECT t.*, p.project AS base, CAST(t.turn + 1 + CASE WHEN length(t.text) % 19 = 0 THEN p.size + 1000
               ELSE 0 END AS INTEGER) AS version
        FROM conversations t JOIN convs p ON p.conv_id = t.conv_id) c
  LEFT JOIN scripts d ON d.project = c.base AND d.version = c.version)"""

_FILES = """
files AS (
  SELECT project, doc_id, rn, lang, file_name, content,
         project || '/d' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '/' || file_name AS path
  FROM (
  SELECT source AS project, doc_id, rn, lang, text AS content,
    CASE doc_id % 16
      WHEN 1 THEN 'R' || printf('%03d', rn * 7) || '_' || lang || '.sql'
      WHEN 2 THEN 'R' || printf('%03d', rn * 7) || '_' || lang || '.down.sql'
      WHEN 3 THEN 'B' || printf('%03d', rn * 7) || '_' || lang || '.sql'
      WHEN 4 THEN 'BE' || printf('%03d', rn * 7) || '_' || lang || '.sql'
      WHEN 5 THEN 'BV' || printf('%03d', rn * 7) || '_' || printf('%03d', rn) || '_' || lang || '.sql'
      WHEN 6 THEN 'A' || printf('%03d', rn * 7) || '_' || lang || '.sql'
      WHEN 7 THEN 'AE' || printf('%03d', rn * 7) || '_' || lang || '.sql'
      WHEN 8 THEN 'AV' || printf('%03d', rn * 7) || '_' || printf('%03d', rn) || '_' || lang || '.sql'
      WHEN 9 THEN 'notes.md'
      WHEN 10 THEN lang || '.template.sql'
      WHEN 11 THEN 'V70000_' || lang || '.sql'
      WHEN 12 THEN 'V' || printf('%03d', rn) || '_' || lang || '.down.sql'
      ELSE 'V' || printf('%03d', rn) || '_' || lang || '.sql' END AS file_name
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS rn
        FROM documents) d) f)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


MAIN = (_SCRIPTS, _LOG, _HISTORY, _TARGETS)


# --- the statements ---------------------------------------------------------------

SQL: dict[str, str] = {}

SQL["fold_history"] = _with(*MAIN) + "SELECT * FROM history"

SQL["unrecorded"] = _with(_SCRIPTS, _LOG) + """
SELECT event_id, target_id, version + 32763 AS version, direction, success,
       printf('version %d is out of range, the highest recorded version is 32767', version + 32763) AS reason
FROM log WHERE event_id % 7 = 0 AND version > 4"""

SQL["latest_version"] = _with(*MAIN) + """
SELECT t.target_id,
       CAST(COALESCE((SELECT max(h.version) FROM history h
                      WHERE h.target_id = t.target_id AND h.success), 0) AS INTEGER) AS latest_version
FROM targets t"""

SQL["failing"] = _with(*MAIN) + """
SELECT target_id, version, description, md5_checksum FROM history WHERE NOT success"""


def _check_ctes(h: str, s: str, t: str, p: str = "") -> str:
    """Gap / drift / problem CTEs over history ``h``, UP scripts ``s`` and
    targets ``t`` (all names of earlier CTEs); ``p`` prefixes the CTE names."""
    return f""",
{p}checked AS (
  SELECT hh.*, tt.project FROM {h} hh JOIN {t} tt ON tt.target_id = hh.target_id
  WHERE tt.project IN (SELECT project FROM {s})),
{p}breaks AS (
  SELECT target_id, version, expected FROM (
    SELECT target_id, version,
           COALESCE(lag(version) OVER (PARTITION BY target_id ORDER BY version) + 1, 1) AS expected
    FROM {p}checked) x
  WHERE version <> expected),
{p}drift AS (
  SELECT c.target_id, c.project, c.version, c.description, c.md5_checksum FROM {p}checked c
  WHERE c.success AND NOT EXISTS (
    SELECT 1 FROM {s} ss WHERE ss.project = c.project AND ss.version = c.version
      AND ss.description = c.description AND ss.md5_checksum = c.md5_checksum)),
{p}lgaps AS (
  SELECT project, CAST(expected AS INTEGER) AS expected, version AS got FROM (
    SELECT project, version,
           COALESCE(lag(version) OVER (PARTITION BY project ORDER BY version) + 1, 1) AS expected
    FROM {s}) x
  WHERE version <> expected),
{p}problems AS (
  SELECT target_id, 1 AS stage, 'failing' AS kind, version,
         printf('found an unsucceeded migration: %d', version) AS message
  FROM {h} WHERE NOT success AND target_id IN (SELECT target_id FROM {t})
  UNION ALL
  SELECT tt.target_id, 2, 'local_gap', g.got, printf('expected version %d got %d', g.expected, g.got)
  FROM {p}lgaps g JOIN {t} tt ON tt.project = g.project
  UNION ALL
  SELECT target_id, 3, 'history_gap', CAST(expected AS INTEGER), printf('missing version %d', expected)
  FROM {p}breaks
  UNION ALL
  SELECT target_id, 3, 'drift', version,
         printf('invalid migration found: version: %d, description: %s, md5_checksum: %s.'
                || ' Please check your local migration and changes', version, description, md5_checksum)
  FROM {p}drift)
"""


_MAIN_CHECKS = _with(*MAIN) [:-1] + _check_ctes("history", "scripts", "targets")

SQL["history_gaps"] = _MAIN_CHECKS + """
SELECT target_id, CAST(expected AS INTEGER) AS missing_version, printf('missing version %d', expected) AS message
FROM breaks"""

SQL["history_gap_ranges"] = _MAIN_CHECKS + """
SELECT target_id, CAST(expected AS INTEGER) AS gap_from, CAST(version - 1 AS INTEGER) AS gap_to FROM breaks"""

# Missing versions below a target's highest one, grouped into runs.
def _missing_runs(h: str) -> str:
    return f"""
, top AS (SELECT target_id, max(version) AS top FROM {h} GROUP BY target_id),
missing AS (
  SELECT t.target_id, v FROM top t, LATERAL (SELECT unnest(generate_series(1, t.top)) AS v) s
  WHERE NOT EXISTS (SELECT 1 FROM {h} h WHERE h.target_id = t.target_id AND h.version = v))
SELECT target_id, CAST(min(v) AS INTEGER) AS gap_from, CAST(max(v) AS INTEGER) AS gap_to
FROM (SELECT *, v - row_number() OVER (PARTITION BY target_id ORDER BY v) AS run FROM missing) m
GROUP BY target_id, run"""


SQL["gap_ranges_by_words"] = _with(*MAIN)[:-1] + _missing_runs("history")
SQL["gap_ranges_merged"] = _with(_MINI)[:-1] + _missing_runs("mini_history")
SQL["latest_by_words"] = SQL["latest_version"]

_SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808 THEN CAST({0} AS HUGEINT) - 18446744073709551616 ELSE {0} END AS BIGINT)"
SQL["version_words"] = _with(*MAIN)[:-1] + f"""
, bits AS (
  SELECT target_id, CAST(version // 64 AS INTEGER) AS word, sum(DISTINCT CAST(2 AS HUGEINT) ** (version % 64)) AS p,
         coalesce(sum(DISTINCT CAST(2 AS HUGEINT) ** (version % 64)) FILTER (WHERE success), 0) AS s
  FROM history GROUP BY ALL)
SELECT target_id, word, {_SIGNED.format("CAST(p AS HUGEINT)")} AS present,
       {_SIGNED.format("CAST(s AS HUGEINT)")} AS succeeded FROM bits"""

SQL["drift"] = _MAIN_CHECKS + """
SELECT target_id, version, description, md5_checksum FROM drift"""

def _reasons(checks: str, s: str) -> str:
    return checks + f"""
SELECT d.target_id, d.version, d.description, d.md5_checksum,
       CASE WHEN NOT EXISTS (SELECT 1 FROM {s} s WHERE s.project = d.project AND s.version = d.version)
              THEN 'missing'
            WHEN NOT EXISTS (SELECT 1 FROM {s} s WHERE s.project = d.project AND s.version = d.version
                             AND s.description = d.description) THEN 'description'
            ELSE 'checksum' END AS reason,
       printf('invalid migration found: version: %d, description: %s, md5_checksum: %s.'
              || ' Please check your local migration and changes', d.version, d.description, d.md5_checksum)
         AS message
FROM drift d"""


SQL["drift_detail"] = _reasons(_MAIN_CHECKS, "scripts")

SQL["status"] = _MAIN_CHECKS + """
SELECT t.target_id,
       CAST(COALESCE((SELECT max(version) FROM history h WHERE h.target_id = t.target_id AND h.success), 0)
            AS INTEGER) AS latest_version,
       CAST((SELECT count(*) FROM breaks b WHERE b.target_id = t.target_id)
            + (SELECT count(*) FROM drift d WHERE d.target_id = t.target_id) AS BIGINT) AS mismatches,
       CAST((SELECT count(*) FROM history h WHERE h.target_id = t.target_id AND NOT h.success) AS BIGINT)
         AS failing
FROM targets t"""

_MINI_CHECKS = _with(_MINI)[:-1] + _check_ctes("mini_history", "mini_scripts", "mini_targets")

SQL["drift_reasons"] = _reasons(_MINI_CHECKS, "mini_scripts")

SQL["gate"] = _MINI_CHECKS + """
, firsts AS (SELECT target_id, min(stage) AS stage FROM problems GROUP BY target_id)
SELECT t.target_id, t.project, CAST(COALESCE(f.stage, 0) AS INTEGER) AS stage,
       CAST((SELECT count(*) FROM problems p WHERE p.target_id = t.target_id AND p.stage = f.stage) AS BIGINT)
         AS problems
FROM mini_targets t LEFT JOIN firsts f ON f.target_id = t.target_id"""

SQL["all_problems"] = _MINI_CHECKS + """
SELECT target_id, CAST(stage AS INTEGER) AS stage, kind, CAST(version AS INTEGER) AS version, message FROM problems"""

SQL["gate_problems"] = _MINI_CHECKS + """
SELECT p.target_id, CAST(p.stage AS INTEGER) AS stage, p.kind, CAST(p.version AS INTEGER) AS version, p.message
FROM problems p
WHERE p.stage = (SELECT min(q.stage) FROM problems q WHERE q.target_id = p.target_id)"""

# --- script folders ------------------------------------------------------------

_PAT = {
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
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(file_name, '{p}') THEN '{k}'" for k, p in _PAT.items()) + " END"


def _grp(idx_by_kind):
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_extract(file_name, '{_PAT[k]}', {i})"
                                   for k, i in idx_by_kind.items()) + " END"


_FIRST = _grp({k: 1 for k in _PAT if k != "TEMPLATE"})
_SECOND = _grp({"BEFORE_VERSION": 2, "AFTER_VERSION": 2})
_DESC = _grp({**{k: 2 for k in _PAT if k not in ("BEFORE_VERSION", "AFTER_VERSION", "TEMPLATE")},
              "BEFORE_VERSION": 3, "AFTER_VERSION": 3, "TEMPLATE": 1})

_CLASSIFIED = _FILES + """,
kinds AS (SELECT *, """ + _KIND + """ AS kind FROM files),
parsed AS (
  SELECT *, """ + _FIRST + """ AS number_text, """ + _SECOND + """ AS version_text, """ + _DESC + """ AS description
  FROM kinds WHERE kind IS NOT NULL),
checked AS (
  SELECT *,
    CASE WHEN kind IN ('UP', 'DOWN') THEN 'migration' WHEN kind = 'TEMPLATE' THEN 'template' ELSE 'hook' END
      AS category,
    TRY_CAST(number_text AS BIGINT) <= CASE WHEN kind IN ('UP', 'DOWN') THEN 65535 ELSE 255 END AS num_ok,
    version_text IS NULL OR TRY_CAST(version_text AS BIGINT) <= 65535 AS ver_ok
  FROM parsed),
classified AS (
  SELECT project, doc_id, file_name, path, content, kind, category, description,
    CAST(CASE WHEN category = 'migration' AND num_ok THEN TRY_CAST(number_text AS BIGINT)
              WHEN kind IN ('BEFORE_VERSION', 'AFTER_VERSION') AND ver_ok THEN TRY_CAST(version_text AS BIGINT)
         END AS INTEGER) AS version,
    CAST(CASE WHEN category = 'hook' AND num_ok THEN TRY_CAST(number_text AS BIGINT) END AS INTEGER) AS hook_order,
    number_text, version_text,
    kind = 'TEMPLATE' OR (COALESCE(num_ok, false) AND COALESCE(ver_ok, false)) AS valid
  FROM checked),
migs AS (
  SELECT project, kind AS direction, version, description, file_name, path, content
  FROM classified WHERE category = 'migration' AND valid),
hks AS (
  SELECT project, kind AS hook_type, hook_order, version AS hook_version, file_name, path
  FROM classified WHERE category = 'hook' AND valid)"""

SQL["classify_files"] = "WITH " + _CLASSIFIED + """
SELECT project, file_name, path, kind, category, version, hook_order, description, valid FROM classified"""

SQL["invalid_files"] = "WITH " + _CLASSIFIED + """
SELECT project, file_name, kind,
  CASE WHEN COALESCE(TRY_CAST(number_text AS BIGINT) <= CASE WHEN kind IN ('UP','DOWN') THEN 65535 ELSE 255 END,
                     false) THEN 'version'
       WHEN kind IN ('UP', 'DOWN') THEN 'version' ELSE 'order' END AS field,
  CASE WHEN COALESCE(TRY_CAST(number_text AS BIGINT) <= CASE WHEN kind IN ('UP','DOWN') THEN 65535 ELSE 255 END,
                     false) THEN version_text ELSE number_text END AS value_text,
  printf('strconv.ParseUint: parsing "%s": value out of range',
    CASE WHEN COALESCE(TRY_CAST(number_text AS BIGINT) <= CASE WHEN kind IN ('UP','DOWN') THEN 65535 ELSE 255 END,
                       false) THEN version_text ELSE number_text END) AS message
FROM classified WHERE NOT valid"""

SQL["select_scripts"] = "WITH " + _CLASSIFIED + """
SELECT project, direction, version, description, path FROM migs WHERE direction = 'UP'"""

SQL["select_hooks_up"] = "WITH " + _CLASSIFIED + """
SELECT project, hook_type, hook_order, hook_version, path FROM hks WHERE hook_type <> 'REPEATABLE_DOWN'"""

SQL["select_hooks_down"] = "WITH " + _CLASSIFIED + """
SELECT project, hook_type, hook_order, hook_version, path FROM hks WHERE hook_type = 'REPEATABLE_DOWN'"""

SQL["ordered_scripts"] = "WITH " + _CLASSIFIED + """
SELECT project, direction, version, path,
  CAST(row_number() OVER (PARTITION BY project, direction
       ORDER BY CASE WHEN direction = 'UP' THEN version ELSE -version END, path) AS INTEGER) AS position
FROM migs"""

SQL["ordered_hooks"] = "WITH " + _CLASSIFIED + """
SELECT project, hook_type, hook_order, path,
  CAST(row_number() OVER (PARTITION BY project, hook_type ORDER BY hook_order, path) AS INTEGER) AS position
FROM hks"""

SQL["local_gaps"] = "WITH " + _CLASSIFIED + """
SELECT project, CAST(expected AS INTEGER) AS expected, version AS got,
       printf('expected version %d got %d', expected, version) AS message
FROM (SELECT project, version,
             COALESCE(lag(version) OVER (PARTITION BY project ORDER BY version, path) + 1, 1) AS expected
      FROM migs WHERE direction = 'UP') x
WHERE version <> expected"""

SQL["next_version"] = "WITH " + _CLASSIFIED + """
SELECT project, CAST(latest AS INTEGER) AS latest_local, CAST(latest + 1 AS INTEGER) AS next_version,
       printf('V%03d_%s.sql', latest + 1, 'next_change') AS new_file_name,
       printf('V%03d_%s.down.sql', latest + 1, 'next_change') AS new_down_file_name, has_invalid
FROM (SELECT project, COALESCE(max(CASE WHEN kind = 'UP' AND valid THEN version END), 0) AS latest,
             bool_or(kind = 'UP' AND NOT valid) AS has_invalid
      FROM classified GROUP BY project) x"""

SQL["expand_templates"] = """
SELECT source AS project, doc_id,
  regexp_replace(text || ' {{sig, ' || source || ' , x}} {{ sig,z,y}} {{nope}}',
                 '\\{\\{\\s*sig\\s*,\\s*([^,}]*?)\\s*,\\s*([^,}]*?)\\s*\\}\\}', '<\\1/\\2>', 'g') AS content
FROM documents"""

SQL["checksum"] = "WITH " + _CLASSIFIED + """,
tpl AS (
  SELECT project, description AS name, arg_min(content, path) AS body
  FROM classified WHERE kind = 'TEMPLATE' GROUP BY project, description),
used AS (
  SELECT m.*, m.content || ' {{' || f.lang || ', ' || m.project || '}}' AS used_content,
         '{{' || f.lang || ', ' || m.project || '}}' AS raw, f.lang
  FROM migs m JOIN files f ON f.path = m.path
  WHERE m.direction = 'UP')
SELECT u.project, u.path, u.version,
  md5(CASE WHEN t.body IS NULL THEN u.used_content
           ELSE replace(u.used_content, u.raw, replace(t.body, '$1', u.project)) END) AS md5_checksum
FROM used u LEFT JOIN tpl t ON t.project = u.project AND t.name = u.lang"""

# --- planning ------------------------------------------------------------------


def _plan_ctes(skip_tens: bool) -> str:
    skip = "WHERE version % 10 <> 0" if skip_tens else ""
    return _with(*MAIN, _HOOKS)[:-1] + f""",
down_scripts AS (
  SELECT project, 'DOWN' AS direction, version, description,
         printf('V%03d_%s.down.sql', version, description) AS file_name
  FROM scripts {skip}),
all_scripts AS (
  SELECT project, direction, version, description, file_name FROM scripts
  UNION ALL SELECT * FROM down_scripts),
stats AS (
  SELECT project, count(*) FILTER (WHERE direction = 'UP') AS n_up,
         count(*) FILTER (WHERE direction = 'DOWN') AS n_down,
         max(version) FILTER (WHERE direction = 'UP') AS max_up
  FROM all_scripts GROUP BY project),
lat AS (
  SELECT t.target_id, CAST(COALESCE(max(h.version) FILTER (WHERE h.success), 0) AS INTEGER) AS latest_version
  FROM targets t LEFT JOIN history h ON h.target_id = t.target_id GROUP BY t.target_id),
resolved AS (
  SELECT t.target_id, t.project, t.down, l.latest_version,
         CAST(CASE WHEN t.down THEN COALESCE(t.destination, 0) ELSE COALESCE(t.destination, s.max_up) END
              AS INTEGER) AS destination,
         CASE WHEN t.down THEN COALESCE(s.n_down, 0) < 1 ELSE COALESCE(s.n_up, 0) < 1 END AS no_scripts
  FROM targets t JOIN lat l ON l.target_id = t.target_id LEFT JOIN stats s ON s.project = t.project),
acts AS (
  SELECT target_id, project, down, latest_version, destination,
    CASE WHEN no_scripts THEN 'no_scripts'
         WHEN latest_version = destination THEN 'up_to_date'
         WHEN NOT down AND destination < latest_version THEN 'up_below_current'
         WHEN down AND destination > latest_version THEN 'down_above_current'
         ELSE 'run' END AS action
  FROM resolved),
pend_up AS (
  SELECT a.target_id, a.project, s.version, s.file_name FROM acts a
  JOIN all_scripts s ON s.project = a.project AND s.direction = 'UP'
   AND s.version > a.latest_version AND s.version <= a.destination
  WHERE a.action = 'run' AND NOT a.down),
pend_down AS (
  SELECT a.target_id, a.project, a.destination, s.version, s.file_name FROM acts a
  JOIN all_scripts s ON s.project = a.project AND s.direction = 'DOWN'
   AND s.version > a.destination AND s.version <= a.latest_version
  WHERE a.action = 'run' AND a.down)
"""


SQL["run_action"] = _plan_ctes(False) + """
SELECT target_id, down, latest_version, destination, action FROM acts"""

SQL["pending_up"] = _plan_ctes(False) + "SELECT target_id, version FROM pend_up"

SQL["pending_down"] = _plan_ctes(False) + """
SELECT p.target_id, p.version,
       EXISTS (SELECT 1 FROM history h WHERE h.target_id = p.target_id AND h.version = p.version) AS applied
FROM pend_down p"""

SQL["missing_down"] = _plan_ctes(True) + """
SELECT h.target_id, h.version FROM history h JOIN acts a ON a.target_id = h.target_id
WHERE a.action = 'run' AND a.down AND h.version > a.destination AND h.version <= a.latest_version
  AND NOT EXISTS (SELECT 1 FROM down_scripts d WHERE d.project = a.project AND d.version = h.version)"""

SQL["missing_down_by_words"] = SQL["missing_down"]

SQL["plan_up"] = _plan_ctes(False) + """,
steps AS (
  SELECT a.target_id, 0 AS blk, CAST(NULL AS INTEGER) AS version, CAST(NULL AS VARCHAR) AS sk, 0 AS phase,
         h.hook_order AS ord, 'BEFORE' AS kind, h.file_name AS name
  FROM acts a JOIN hooks h ON h.hook_type = 'BEFORE' WHERE a.action = 'run' AND NOT a.down
  UNION ALL
  SELECT p.target_id, 1, p.version, p.file_name, 1, h.hook_order, 'REPEATABLE', h.file_name
  FROM pend_up p JOIN hooks h ON h.hook_type = 'REPEATABLE' WHERE p.version > 1
  UNION ALL
  SELECT p.target_id, 1, p.version, p.file_name, 2, h.hook_order, 'BEFORE_EACH', h.file_name
  FROM pend_up p JOIN hooks h ON h.hook_type = 'BEFORE_EACH'
  UNION ALL
  SELECT p.target_id, 1, p.version, p.file_name, 3, h.hook_order, 'BEFORE_VERSION', h.file_name
  FROM pend_up p JOIN hooks h ON h.hook_type = 'BEFORE_VERSION' AND h.hook_version = p.version
  UNION ALL
  SELECT p.target_id, 1, p.version, p.file_name, 4, 0, 'UP', p.file_name FROM pend_up p
  UNION ALL
  SELECT p.target_id, 1, p.version, p.file_name, 5, h.hook_order, 'AFTER_VERSION', h.file_name
  FROM pend_up p JOIN hooks h ON h.hook_type = 'AFTER_VERSION' AND h.hook_version = p.version
  UNION ALL
  SELECT p.target_id, 1, p.version, p.file_name, 6, h.hook_order, 'AFTER_EACH', h.file_name
  FROM pend_up p JOIN hooks h ON h.hook_type = 'AFTER_EACH'
  UNION ALL
  SELECT a.target_id, 2, NULL, NULL, 0, h.hook_order, 'AFTER', h.file_name
  FROM acts a JOIN hooks h ON h.hook_type = 'AFTER' WHERE a.action = 'run' AND NOT a.down)
SELECT target_id,
       CAST(row_number() OVER (PARTITION BY target_id
            ORDER BY blk, version NULLS FIRST, sk NULLS FIRST, phase, ord, name) AS INTEGER) AS step,
       kind, CAST(version AS INTEGER) AS version, name
FROM steps"""

SQL["plan_down"] = _plan_ctes(True) + """,
steps AS (
  SELECT target_id, version, file_name AS sk, 0 AS phase, 0 AS ord, 'DOWN' AS kind, file_name AS name
  FROM pend_down
  UNION ALL
  SELECT target_id, version, file_name, 1, 1, 'REPEATABLE_DOWN', 'rd1'
  FROM pend_down WHERE version > destination + 1)
SELECT target_id,
       CAST(row_number() OVER (PARTITION BY target_id ORDER BY version DESC, sk, phase, ord, name) AS INTEGER)
         AS step,
       kind, CAST(version AS INTEGER) AS version, name
FROM steps"""

# --- history mutations and effective steps ------------------------------------------

_HALVES = """,
first_half AS (SELECT * FROM log WHERE executed_at < TIMESTAMP '2024-01-16 00:00:00'),
second_half AS (SELECT * FROM log WHERE executed_at >= TIMESTAMP '2024-01-16 00:00:00'),
base AS (
  SELECT target_id, version, description, md5_checksum, success, executed_at, CAST(NULL AS TIMESTAMP) AS repaired_at
  FROM (SELECT *, row_number() OVER (PARTITION BY target_id, version ORDER BY executed_at DESC, event_id DESC) rn
        FROM first_half WHERE NOT (direction = 'DOWN' AND NOT success) AND version <= 32767) x
  WHERE rn = 1 AND direction = 'UP')
"""

SQL["apply_ups"] = _with(*MAIN)[:-1] + _HALVES + """,
ups AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, version
                                              ORDER BY executed_at DESC, event_id DESC) AS rn
                 FROM second_half WHERE direction = 'UP' AND version <= 32767) x WHERE rn = 1)
SELECT u.target_id, u.version, u.description, u.md5_checksum, u.success, u.executed_at, b.repaired_at
FROM ups u LEFT JOIN base b ON b.target_id = u.target_id AND b.version = u.version
UNION ALL
SELECT b.* FROM base b
WHERE NOT EXISTS (SELECT 1 FROM ups u WHERE u.target_id = b.target_id AND u.version = b.version)"""

SQL["apply_rollbacks"] = _with(*MAIN)[:-1] + _HALVES + """
SELECT b.* FROM base b
WHERE NOT EXISTS (SELECT 1 FROM second_half d WHERE d.direction = 'DOWN' AND d.success
                  AND d.target_id = b.target_id AND d.version = b.version)"""

# the second batch over a stored history ``base``: last attempts of the batch, else the stored row
_SECOND_OVER = """,
batch AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, version
                                              ORDER BY executed_at DESC, event_id DESC) AS rn,
                        bool_or(direction = 'DOWN') OVER (PARTITION BY target_id, version) AS cleared
                 FROM second_half WHERE NOT (direction = 'DOWN' AND NOT success) AND version <= 32767) x
  WHERE rn = 1)
SELECT b.* FROM {base} b
WHERE NOT EXISTS (SELECT 1 FROM batch n WHERE n.target_id = b.target_id AND n.version = b.version)
UNION ALL
SELECT n.target_id, n.version, n.description, n.md5_checksum, n.success, n.executed_at,
       CASE WHEN NOT n.cleared THEN b.repaired_at END AS repaired_at
FROM batch n LEFT JOIN {base} b ON b.target_id = n.target_id AND b.version = n.version
WHERE n.direction = 'UP'"""

SQL["fold_incremental"] = _with(*MAIN)[:-1] + _HALVES + _SECOND_OVER.format(base="base")


def _repaired(h: str, at: str, reset: bool) -> str:
    """CTEs ``wanted`` and ``repaired``: history ``h`` after a repair at ``at``."""
    existing = "true" if reset else "h.success"
    return f""",
wanted AS (SELECT t.target_id, s.version, s.description, s.md5_checksum
           FROM targets t JOIN scripts s ON s.project = t.project WHERE s.version <= 32767),
repaired AS (
SELECT COALESCE(h.target_id, w.target_id) AS target_id, COALESCE(h.version, w.version) AS version,
  COALESCE(w.description, h.description) AS description,
  COALESCE(w.md5_checksum, h.md5_checksum) AS md5_checksum,
  CASE WHEN w.version IS NULL THEN h.success WHEN h.version IS NULL THEN true ELSE {existing} END AS success,
  COALESCE(h.executed_at, TIMESTAMP '{at}') AS executed_at,
  CASE WHEN w.version IS NULL THEN h.repaired_at
       WHEN h.version IS NULL THEN TIMESTAMP '{at}'
       WHEN w.description <> h.description OR w.md5_checksum <> h.md5_checksum THEN TIMESTAMP '{at}'
       ELSE h.repaired_at END AS repaired_at
FROM {h} h FULL OUTER JOIN wanted w ON w.target_id = h.target_id AND w.version = h.version)"""


SQL["fold_after_repair"] = (_with(*MAIN)[:-1] + _HALVES + _repaired("base", "2024-01-16 00:00:00", True)
                            + _SECOND_OVER.format(base="repaired"))


def _repair(reset: bool) -> str:
    return _with(*MAIN)[:-1] + _repaired("history", "2024-02-01 00:00:00", reset) + "\nSELECT * FROM repaired"


def _repair_difference(h: str, before: str, reset: bool) -> str:
    """The rows of a repair that aren't in the history before it."""
    return before + _repaired(h, "2024-02-01 00:00:00", reset) + f"""
SELECT * FROM repaired EXCEPT
SELECT target_id, version, description, md5_checksum, success, executed_at, repaired_at FROM {h}"""


# The history after an earlier repair of every second target.
_HALF_REPAIRED = """,
early_wanted AS (SELECT t.target_id, s.version, s.description, s.md5_checksum
                 FROM targets t JOIN scripts s ON s.project = t.project WHERE t.target_id % 2 = 0),
half_repaired AS (
SELECT COALESCE(h.target_id, w.target_id) AS target_id, COALESCE(h.version, w.version) AS version,
  COALESCE(w.description, h.description) AS description, COALESCE(w.md5_checksum, h.md5_checksum) AS md5_checksum,
  CASE WHEN w.version IS NULL THEN h.success ELSE true END AS success,
  COALESCE(h.executed_at, TIMESTAMP '2024-01-20 00:00:00') AS executed_at,
  CASE WHEN w.version IS NOT NULL AND (h.version IS NULL OR w.md5_checksum <> h.md5_checksum)
       THEN TIMESTAMP '2024-01-20 00:00:00' ELSE h.repaired_at END AS repaired_at
FROM history h FULL OUTER JOIN early_wanted w ON w.target_id = h.target_id AND w.version = h.version)"""

SQL["repair_changes_reset"] = _repair_difference("history", _with(*MAIN)[:-1], True)
SQL["repair_changes_keep"] = _repair_difference("half_repaired", _with(*MAIN)[:-1] + _HALF_REPAIRED, False)
SQL["stored_history"] = SQL["imported_history"] = SQL["fold_history"]

SQL["repair_reset"] = _repair(True)
SQL["repair_keep"] = _repair(False)

_HOOK_LOG = """,
hook_log AS (
  SELECT event_id * 2 AS event_id, target_id, version, direction, description, md5_checksum, success, executed_at
  FROM log
  UNION ALL
  SELECT event_id * 2 + 1, target_id, version, 'AFTER_EACH', 'ae1', NULL, event_id % 11 <> 0, executed_at FROM log)"""


def _failfast(log: str) -> str:
    return f"""
SELECT event_id, target_id, version, direction, success, executed_at FROM (
  SELECT *, COALESCE(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (
              PARTITION BY target_id, CAST(executed_at AS DATE) ORDER BY executed_at, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fails_before
  FROM {log}) x
WHERE fails_before = 0"""


def _atomic(log: str) -> str:
    return f"""
  SELECT * EXCLUDE (fails) FROM (
  SELECT *, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (
              PARTITION BY target_id, CAST(executed_at AS DATE)) AS fails
  FROM {log}) x
  WHERE fails = 0"""


SQL["effective_failfast"] = _with(*MAIN) + _failfast("log")
SQL["effective_atomic"] = (_with(*MAIN)[:-1] + ", kept AS (" + _atomic("log") + """)
SELECT event_id, target_id, version, direction, success, executed_at FROM kept""")
SQL["effective_hooks"] = _with(*MAIN)[:-1] + _HOOK_LOG + _failfast("hook_log")
SQL["fold_hooks"] = _with(*MAIN)[:-1] + _HOOK_LOG + ", kept AS (" + _atomic("hook_log") + """)
SELECT target_id, version, description, md5_checksum, success, executed_at, CAST(NULL AS TIMESTAMP) AS repaired_at
FROM (SELECT *, row_number() OVER (PARTITION BY target_id, version ORDER BY executed_at DESC, event_id DESC) AS rn
      FROM kept WHERE direction = 'UP' OR (direction = 'DOWN' AND success)) x
WHERE rn = 1 AND direction = 'UP'"""

# --- table changes -----------------------------------------------------------------

SQL["migrate_orders_up"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS band,
       o_orderpriority AS priority
FROM orders WHERE o_orderstatus <> 'P'"""

SQL["migrate_orders_down"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS band
FROM orders WHERE o_orderstatus <> 'P'"""

SQL["migrate_lineitem_up"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_returnflag, l_linestatus, l_shipdate,
       l_extendedprice * (1 - l_discount) AS net,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
FROM lineitem WHERE l_quantity > 0 AND l_returnflag <> 'R'"""

SQL["run_action_gated"] = _MINI_CHECKS + """
, firsts AS (SELECT target_id, min(stage) AS stage FROM problems GROUP BY target_id),
lat AS (
  SELECT t.target_id, CAST(COALESCE(max(h.version) FILTER (WHERE h.success), 0) AS INTEGER) AS latest_version
  FROM mini_targets t LEFT JOIN mini_history h ON h.target_id = t.target_id GROUP BY t.target_id),
mx AS (SELECT project, max(version) AS max_up FROM mini_scripts GROUP BY project)
SELECT t.target_id, l.latest_version, CAST(m.max_up AS INTEGER) AS destination,
  CASE WHEN m.max_up IS NULL THEN 'no_scripts'
       WHEN f.stage IS NOT NULL THEN 'blocked'
       WHEN l.latest_version = m.max_up THEN 'up_to_date'
       WHEN m.max_up < l.latest_version THEN 'up_below_current'
       ELSE 'run' END AS action
FROM mini_targets t JOIN lat l ON l.target_id = t.target_id
LEFT JOIN mx m ON m.project = t.project LEFT JOIN firsts f ON f.target_id = t.target_id"""

# --- script folders, with the projects whose load fails ------------------------------

# Every folder whole and, as '-sound', without its out-of-range files; every file ends with a template use.

_LOADED = _CLASSIFIED + """,
folders AS (
  SELECT project, path, kind, category, version, hook_order, description, valid, number_text, version_text,
         content || raw AS content, raw, lang, source FROM (
    SELECT c.*, f.lang, ' {{' || f.lang || ', ' || c.project || '}}' AS raw, c.project AS source
    FROM classified c JOIN files f ON f.path = c.path) x
  UNION ALL
  SELECT c.project || '-sound', c.path, kind, category, version, hook_order, description, valid, number_text,
         version_text, c.content || ' {{' || f.lang || ', ' || c.project || '}}',
         ' {{' || f.lang || ', ' || c.project || '}}', f.lang, c.project
  FROM classified c JOIN files f ON f.path = c.path WHERE valid),
bodies AS (
  SELECT project, description AS name, arg_min(content, path) AS body FROM folders
  WHERE kind = 'TEMPLATE' GROUP BY project, description),
invalid AS (SELECT project, count(*) AS n FROM folders WHERE NOT valid GROUP BY project),
loaded AS (
  SELECT f.* REPLACE (CASE WHEN b.body IS NULL THEN f.content
                           ELSE replace(f.content, trim(f.raw), replace(b.body, '$1', f.source)) END AS content)
  FROM folders f LEFT JOIN bodies b ON b.project = f.project AND b.name = f.lang
  WHERE f.valid AND f.project NOT IN (SELECT project FROM invalid))"""

SQL["load_scripts"] = "WITH " + _LOADED + """
SELECT project, kind AS direction, version, path, CAST(length(content) AS INTEGER) AS n_chars,
       CASE WHEN kind = 'UP' THEN md5(content) END AS md5_checksum
FROM loaded WHERE category = 'migration'"""

SQL["load_hooks"] = "WITH " + _LOADED + """
SELECT project, kind AS hook_type, hook_order, version AS hook_version, path, CAST(length(content) AS INTEGER) AS n_chars
FROM loaded WHERE category = 'hook' AND kind NOT IN ('REPEATABLE_DOWN', 'AFTER_EACH')"""

_FOLDERS = _with(*MAIN)[:-1] + "," + _LOADED + """,
fscripts AS (
  SELECT project, version, description, md5(content) AS md5_checksum FROM loaded WHERE kind = 'UP'),
ftargets AS (
  SELECT target_id, split_part(project, '/', 1)
                    || CASE target_id // 3 % 4 WHEN 2 THEN '-sound' WHEN 3 THEN '-none' ELSE '' END AS project
  FROM targets),
flat AS (
  SELECT t.target_id, t.project, CAST(COALESCE(max(h.version) FILTER (WHERE h.success), 0) AS INTEGER) AS latest_version
  FROM ftargets t LEFT JOIN history h ON h.target_id = t.target_id GROUP BY t.target_id, t.project),
fmax AS (SELECT project, CAST(max(version) AS INTEGER) AS max_up FROM fscripts GROUP BY project)"""

SQL["run_action_loaded"] = _FOLDERS + """
SELECT l.target_id, l.project, l.latest_version, m.max_up AS destination,
  CASE WHEN i.n > 0 THEN 'load_failed' WHEN m.max_up IS NULL THEN 'no_scripts'
       WHEN l.latest_version = m.max_up THEN 'up_to_date'
       WHEN m.max_up < l.latest_version THEN 'up_below_current' ELSE 'run' END AS action
FROM flat l LEFT JOIN invalid i ON i.project = l.project LEFT JOIN fmax m ON m.project = l.project"""

_FOLDER_CHECKS = _FOLDERS + _check_ctes("history", "fscripts", "ftargets", "f")

# With the gate: a project whose load failed, then the validation stages.
SQL["run_action_gate_loaded"] = _FOLDER_CHECKS + """,
fprob AS (SELECT target_id, min(stage) AS stage FROM fproblems GROUP BY target_id)
SELECT l.target_id, l.project, l.latest_version, m.max_up AS destination,
  CASE WHEN i.n > 0 THEN 'load_failed' WHEN m.max_up IS NULL THEN 'no_scripts'
       WHEN p.stage IS NOT NULL THEN 'blocked'
       WHEN l.latest_version = m.max_up THEN 'up_to_date'
       WHEN m.max_up < l.latest_version THEN 'up_below_current' ELSE 'run' END AS action
FROM flat l LEFT JOIN invalid i ON i.project = l.project LEFT JOIN fmax m ON m.project = l.project
LEFT JOIN fprob p ON p.target_id = l.target_id"""

SQL["gate_loaded"] = _FOLDER_CHECKS + """
, per AS (SELECT target_id, stage, count(*) AS n FROM fproblems GROUP BY target_id, stage),
fst AS (SELECT target_id, min(stage) AS stage FROM per GROUP BY target_id)
SELECT t.target_id, t.project, CAST(CASE WHEN i.n > 0 THEN -1 ELSE COALESCE(f.stage, 0) END AS INTEGER) AS stage,
       CAST(CASE WHEN i.n > 0 THEN i.n ELSE COALESCE(p.n, 0) END AS BIGINT) AS problems
FROM ftargets t LEFT JOIN invalid i ON i.project = t.project LEFT JOIN fst f ON f.target_id = t.target_id
LEFT JOIN per p ON p.target_id = f.target_id AND p.stage = f.stage"""

SQL["status_loaded"] = _FOLDER_CHECKS + """
SELECT l.target_id, l.latest_version,
  (SELECT count(*) FROM fbreaks b WHERE b.target_id = l.target_id)
    + (SELECT count(*) FROM fdrift d WHERE d.target_id = l.target_id) AS mismatches,
  (SELECT count(*) FROM history h WHERE h.target_id = l.target_id AND NOT h.success) AS failing,
  EXISTS (SELECT 1 FROM invalid i WHERE i.project = l.project) AS load_failed
FROM flat l"""

SQL["gate_problems_loaded"] = _FOLDER_CHECKS + """,
every AS (
  SELECT target_id, stage, kind, version, message FROM fproblems
  WHERE target_id NOT IN (SELECT t.target_id FROM ftargets t JOIN invalid i ON i.project = t.project)
  UNION ALL
  SELECT t.target_id, -1, 'load', NULL,
         printf('strconv.ParseUint: parsing "%s": value out of range',
                CASE WHEN f.category = 'hook' AND TRY_CAST(f.number_text AS BIGINT) <= 255 THEN f.version_text
                     ELSE f.number_text END)
  FROM ftargets t JOIN folders f ON f.project = t.project WHERE NOT f.valid)
SELECT e.target_id, CAST(e.stage AS INTEGER) AS stage, e.kind, CAST(e.version AS INTEGER) AS version, e.message
FROM every e WHERE e.stage = (SELECT min(o.stage) FROM every o WHERE o.target_id = e.target_id)"""

SQL["all_problems_loaded"] = _FOLDER_CHECKS + """
SELECT target_id, CAST(stage AS INTEGER) AS stage, kind, CAST(version AS INTEGER) AS version, message FROM fproblems
UNION ALL
SELECT t.target_id, -1, 'load', NULL,
       printf('strconv.ParseUint: parsing "%s": value out of range',
              CASE WHEN f.category = 'hook' AND TRY_CAST(f.number_text AS BIGINT) <= 255 THEN f.version_text
                   ELSE f.number_text END)
FROM ftargets t JOIN folders f ON f.project = t.project WHERE NOT f.valid"""
