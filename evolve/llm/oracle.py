"""DuckDB SQL of the text queries that SQL can express, by query name.

The other queries need a tokenizer, a compressor, a page parser or a regular
expression engine's spans; tests/llm holds them against brute force.
"""

from __future__ import annotations

from evolve.llm.quality_rules import RULES, STANDARD, SYMBOLS, UPPER

SQL: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

# Links by a self-join on shared shingles; components by smallest reachable id.
SQL["op1_ngram_join"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 3),
      lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS class FROM sets),
reps AS (SELECT class, n, min(doc_id) AS rep FROM sizes WHERE n > 0 GROUP BY class, n),
items AS (
  SELECT doc_id, n, unnest(s) AS shingle FROM sets JOIN sizes USING (doc_id)
  WHERE doc_id IN (SELECT rep FROM reps)),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n - count(*) AS united, count(*) AS shared
  FROM items x JOIN items y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * united),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS node, b AS other FROM edges
  UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
component AS (SELECT node, least(node, min(other)) AS id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles,
       CAST(coalesce(c.id, r.rep, s.doc_id) AS BIGINT) AS component_id
FROM sizes s LEFT JOIN reps r ON r.class = s.class LEFT JOIN component c ON c.node = r.rep"""

SQL["op3_line_dedup"] = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{UPPER}', '{UPPER.lower()}') AS k FROM lines),
holders AS (SELECT k, min(doc_id) AS first_holder FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT l.*, length(l.k) >= 10 AND l.doc_id > h.first_holder AS gone
  FROM keyed l LEFT JOIN holders h ON h.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, false)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id"""

# floor(1024 * x) products; the ten best by score, then vec_id.
SQL["op7_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10"""

_FAILED = " | ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))

SQL["op10_quality_rules"] = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
triples AS (
  SELECT doc_id, i, w[i:i + 2] AS t
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) > 2)),
twice AS (SELECT doc_id, t FROM triples GROUP BY doc_id, t HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM triples SEMI JOIN twice USING (doc_id, t))
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)),
                             lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM words JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, CAST({_FAILED} AS BIGINT) AS failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, (failed & {STANDARD.mask | 3}) = 0 AS kept, failed
FROM judged"""
assert SYMBOLS == "#*$%&|<>"  # the class above


# Every phrase of a piece by position, counted per language.
SQL["op12_collocations"] = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words),
phrases AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM spots, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM phrases WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM phrases WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r,
         (CAST(2000000 AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[s.i:s.i + z.size - 1], ' ') AS phrase, max(a) AS around
  FROM candidates, (SELECT unnest([2, 3]) AS size) z, (SELECT unnest([1, 2, 3]) AS i) s
  WHERE z.size < k AND s.i + z.size - 1 <= k GROUP BY ALL),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, encode(w.phrase)) AS rank
  FROM lowest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE i.around IS NULL OR 100 * CAST(i.around AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

SQL["op13_url_filters"] = rf"""
WITH split AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
                            '{UPPER}', '{UPPER.lower()}') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path,
         row_number() OVER () AS row FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fitting AS (
  SELECT row, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM split JOIN rules ON starts_with(path, rule_path)
       AND (host = rule_host OR ends_with(host, '.' || rule_host)) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fitting USING (row)"""
