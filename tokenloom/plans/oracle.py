"""DuckDB statements that compute the same answers as ``plans/catalog.py``.

They are written independently from the Spark jobs: plain SQL over the driver's views, using
the textbook (single-level, sequential-order) form of each rule.
"""

from __future__ import annotations

from tokenloom.plans.catalog import (ADMISSION_LIMIT, AS_OF, EXEMPT_SOURCES, GLOBAL_CONFIG, PROJECT_LIMIT,
                                     RETRIEVAL_LIMIT)

USAGE_CTE = """
usage AS (
  SELECT event_id,
         CAST(ts AS TIMESTAMP) AS ts,
         CAST(floor(value) AS BIGINT) AS tokens,
         'user/' || CAST(user_id AS VARCHAR) AS path,
         COALESCE(event_type, 'unknown') AS source,
         'p' || CAST(user_id AS VARCHAR) AS project,
         CAST(ts AS DATE) AS day
  FROM events
),
rec AS (SELECT * FROM usage WHERE tokens > 0)
"""


def _status_select(scope: str, lim: str) -> str:
    used = "COALESCE(d.tokens_used, 0)"
    return f"""
  SELECT {scope}
         strftime(s.day, '%Y-%m-%d') AS day,
         CAST({used} AS BIGINT) AS tokens_used,
         CAST({lim} AS BIGINT) AS daily_limit,
         CAST(greatest(0, {lim} - {used}) AS BIGINT) AS remaining,
         CASE WHEN {lim} <> 0 THEN ({used} / {lim}) * 100 ELSE 0.0 END AS percentage,
         {used} >= {lim} AS blocked,
         CASE WHEN {used} >= {lim}
              THEN printf('Daily token limit reached (%d / %d).', {used}, {lim}) END AS message,
         CASE WHEN (CASE WHEN {lim} > 0 THEN ({used} / {lim}) * 100 ELSE 0.0 END) > 90 THEN 'red'
              WHEN (CASE WHEN {lim} > 0 THEN ({used} / {lim}) * 100 ELSE 0.0 END) > 75 THEN 'yellow'
              ELSE 'green' END AS severity"""


ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["budget_status_daily"] = f"""
WITH {USAGE_CTE},
daily AS (SELECT day, SUM(tokens) AS tokens_used FROM rec GROUP BY day),
spine AS (
  SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM rec
)
{_status_select('', '200000')}
FROM spine s LEFT JOIN daily d ON s.day = d.day
"""

ORACLE_SQL["budget_admission"] = f"""
WITH {USAGE_CTE}
SELECT event_id,
       strftime(day, '%Y-%m-%d') AS day,
       tokens,
       CAST(COALESCE(SUM(greatest(tokens, 0)) OVER (
            PARTITION BY day ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before,
       CAST({ADMISSION_LIMIT} AS BIGINT) AS daily_limit,
       COALESCE(SUM(greatest(tokens, 0)) OVER (
            PARTITION BY day ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {ADMISSION_LIMIT} AS admitted
FROM usage
"""

ORACLE_SQL["budget_severity"] = f"""
WITH {USAGE_CTE},
daily AS (SELECT project, day, SUM(tokens) AS tokens_used FROM rec GROUP BY project, day),
spine AS (
  SELECT project, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
  FROM rec GROUP BY project
)
{_status_select('s.project,', str(PROJECT_LIMIT))}
FROM spine s LEFT JOIN daily d ON s.project = d.project AND s.day = d.day
"""

ORACLE_SQL["usage_by_source"] = f"""
WITH {USAGE_CTE}
SELECT strftime(day, '%Y-%m-%d') AS day, source,
       CAST(SUM(tokens) AS BIGINT) AS tokens,
       COUNT(*) AS requests,
       CAST(GROUPING_ID(strftime(day, '%Y-%m-%d'), source) AS INTEGER) AS level
FROM rec
GROUP BY ROLLUP (strftime(day, '%Y-%m-%d'), source)
"""

ORACLE_SQL["budget_status_as_of"] = f"""
WITH {USAGE_CTE},
s AS (SELECT DISTINCT project, DATE '{AS_OF[:10]}' AS day FROM usage),
d AS (SELECT project, SUM(tokens) AS tokens_used FROM rec
      WHERE day = DATE '{AS_OF[:10]}' AND ts <= TIMESTAMP '{AS_OF}' GROUP BY project)
{_status_select('s.project,', str(PROJECT_LIMIT))}
FROM s LEFT JOIN d ON s.project = d.project
"""

# one request after another: the shared total of a day grows by admitted requests only
ORACLE_SQL["budget_limits"] = f"""
WITH RECURSIVE {USAGE_CTE},
q AS (
  SELECT event_id, project, day, tokens, source = '{EXEMPT_SOURCES[0]}' AS exempt,
         CASE CAST(substr(project, 2) AS BIGINT) % 3 WHEN 0 THEN {ADMISSION_LIMIT} ELSE (CAST(substr(project, 2) AS BIGINT) % 3) * 1500 + 500 END AS lim,
         row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS rn
  FROM usage
),
r AS (
  SELECT day, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS used_before, CAST(NULL AS BOOLEAN) AS admitted
  FROM q GROUP BY day
  UNION ALL
  SELECT q.day, q.rn, r.used + CASE WHEN NOT q.exempt AND r.used < q.lim THEN greatest(q.tokens, 0) ELSE 0 END,
         q.event_id, r.used, q.exempt OR r.used < q.lim
  FROM r JOIN q ON q.day = r.day AND q.rn = r.rn + 1
)
SELECT r.event_id, q.project, strftime(q.day, '%Y-%m-%d') AS day, q.tokens, r.used_before, CAST(q.lim AS BIGINT) AS daily_limit, r.admitted
FROM r JOIN q ON q.event_id = r.event_id
"""

# --- corpus --------------------------------------------------------------------------------
SPACE = (r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
BREAKS = r"[\x{000A}\x{000B}\x{000C}\x{001C}\x{001D}\x{001E}\x{0085}\x{2028}\x{2029}]"
PRETOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"


def splitlines(x: str) -> str:
    """Python splitlines() of an LF-normalised text, as a DuckDB list."""
    parts = f"string_split_regex({x}, '{BREAKS}')"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = '' THEN []::VARCHAR[] "
            f"WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)")


def tokens(x: str) -> str:
    return f"CAST(COALESCE(len(regexp_extract_all({x}, '{PRETOKEN}')), 0) AS BIGINT)"


CORPUS_CTE = r"""
corpus AS (
  SELECT doc_id AS src_id,
         source AS project,
         source || '/' || lang || '/'
           || ['src', 'lib', 'docs', 'node_modules', '.cache', 'build', 'pkg'][doc_id % 7 + 1]
           || '/doc' || CAST(doc_id AS VARCHAR)
           || ['.py', '.md', '.txt', '.js', '.ts', '.tsx', '.jsx', '.PY', '.png'][doc_id % 9 + 1] AS path,
         regexp_replace(text, '\r\n?', chr(10), 'g') AS content,
         CASE WHEN text IS NULL THEN 'undecodable' ELSE 'ok' END AS status
  FROM documents
)
"""

ORACLE_SQL["doc_fingerprints"] = f"""
WITH {CORPUS_CTE}
SELECT path, sha256(path) AS doc_id, sha256(content) AS content_sha,
       CAST(len({splitlines('content')}) AS BIGINT) AS n_lines,
       CAST(length(content) AS BIGINT) AS n_chars
FROM corpus
"""

ORACLE_SQL["indexable_files"] = f"""
WITH {CORPUS_CTE},
parts AS (
  SELECT *, string_split(path, '/') AS p FROM corpus
),
named AS (
  SELECT *, p[-1] AS name, p[1:len(p) - 1] AS dirs,
         lower(regexp_extract(p[-1], '(?s)^.+(\\.[^./]+)$', 1)) AS ext
  FROM parts
)
SELECT project, path, name, ext, sha256(path) AS doc_id, CAST(length(content) AS BIGINT) AS n_chars
FROM named
WHERE status = 'ok'
  AND ext IN ('.py', '.js', '.ts', '.jsx', '.tsx', '.md', '.txt')
  AND name NOT IN ('node_modules', '.git', '__pycache__', 'venv', '.env')
  AND NOT list_has_any(dirs, ['node_modules', '.git', '__pycache__', 'venv', '.env'])
  AND len(list_filter(dirs, lambda d: starts_with(d, '.'))) = 0
"""

ORACLE_SQL["indexed_count"] = f"""
WITH {CORPUS_CTE},
f AS (
  SELECT status, lower(regexp_extract(string_split(path, '/')[-1], '(?s)^.+(\\.[^./]+)$', 1)) IN ('.py', '.js', '.ts', '.jsx', '.tsx', '.md', '.txt')
         AND string_split(path, '/')[-1] NOT IN ('node_modules', '.git', '__pycache__', 'venv', '.env')
         AND NOT list_has_any(string_split(path, '/')[1:-2], ['node_modules', '.git', '__pycache__', 'venv', '.env'])
         AND NOT regexp_matches('/' || array_to_string(string_split(path, '/')[1:-2], '/'), '/\\.') AS fits
  FROM corpus
)
SELECT COUNT(*) FILTER (WHERE fits AND status = 'ok') AS indexed, COUNT(*) FILTER (WHERE fits AND status <> 'ok') AS unreadable,
       COUNT(*) FILTER (WHERE NOT fits) AS skipped
FROM f
"""

ORACLE_SQL["token_counts"] = f"""
WITH {CORPUS_CTE}
SELECT path, CASE WHEN status = 'ok' THEN {tokens('content')} ELSE CAST(0 AS BIGINT) END AS tokens
FROM corpus
"""


ORACLE_SQL["strip_comments"] = f"""
WITH {CORPUS_CTE},
s AS (
  SELECT path,
         array_to_string(list_filter({splitlines("regexp_replace(content, '#[^\\n]*', '', 'g')")},
                                     lambda l: regexp_matches(l, '[^{SPACE}]')), chr(10)) AS text
  FROM corpus
)
SELECT path, text, {tokens('text')} AS tokens FROM s
"""

ORACLE_SQL["conversation_tokens"] = f"""
SELECT conv_id, role, CAST(SUM({tokens('text')}) AS BIGINT) AS tokens, COUNT(*) AS turns
FROM conversations GROUP BY conv_id, role
"""

# --- reference search ----------------------------------------------------------------------


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def ref_tail(files: str) -> str:
    """Lines, symbols and matches over a table (path, content)."""
    return f"""
scanned AS (
  SELECT path, {splitlines('content')} AS l FROM {files}
  WHERE NOT list_has_any(string_split(path, '/'),
                         ['.git', 'node_modules', '__pycache__', 'venv', '.venv', 'dist', 'build'])
    AND lower(regexp_extract(string_split(path, '/')[-1], '(?s)^.+(\\.[^./]+)$', 1)) NOT IN
        ('.sqlite', '.db', '.pyc', '.png', '.jpg', '.exe', '.dll', '.zip', '.tar', '.gz')
),
lines AS (
  SELECT path, CAST(generate_subscripts(l, 1) AS INTEGER) AS n, unnest(l) AS line FROM scanned
),
syms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\w+')) AS symbol FROM benchmark),
m AS (
  SELECT s.symbol AS query_id, s.symbol, l.path, l.n, l.line
  FROM lines l JOIN syms s ON contains(l.line, s.symbol)
)
"""


REF_CTE = f"{CORPUS_CTE.strip()},{ref_tail('corpus')}"

ORACLE_SQL["reference_lines"] = f"""
WITH {REF_CTE}
SELECT query_id, path, n, {py_strip('line')} AS display, length({py_strip('line')}) > 120 AS is_long FROM m
"""

ORACLE_SQL["multi_symbol_references"] = f"""
WITH {REF_CTE}
SELECT query_id, path, COUNT(*) AS n_matches, CAST(min(n) AS INTEGER) AS first_line,
       CAST(max(n) AS INTEGER) AS last_line,
       CAST(SUM({tokens("printf('  Line %d: %s', n, " + py_strip('line') + ")")}) AS BIGINT) AS tokens
FROM m GROUP BY query_id, path
"""

ORACLE_SQL["reference_words"] = f"""
WITH {REF_CTE}
SELECT query_id, path, COUNT(*) AS n_matches, CAST(min(n) AS INTEGER) AS first_line,
       CAST(max(n) AS INTEGER) AS last_line,
       CAST(SUM({tokens("printf('  Line %d: %s', n, " + py_strip('line') + ")")}) AS BIGINT) AS tokens
FROM m WHERE regexp_matches(line, '(^|\\W)' || symbol || '(\\W|$)') GROUP BY query_id, path
"""

ORACLE_SQL["reference_capped"] = f"""
WITH {REF_CTE},
files AS (SELECT query_id, path, COUNT(*) AS c FROM m GROUP BY query_id, path),
runs AS (
  SELECT *, COALESCE(SUM(c + 1) OVER (PARTITION BY query_id ORDER BY path
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS excl
  FROM files
),
rows_out AS (
  SELECT query_id, path, 0 AS n, 'File: ' || path AS text, false AS is_long, excl <= 100 AS within_cap FROM runs
  UNION ALL
  SELECT m.query_id, m.path, m.n, printf('  Line %d: %s', m.n, {py_strip('m.line')}) AS text, length({py_strip('m.line')}) > 120, r.excl <= 100
  FROM m JOIN runs r ON m.query_id = r.query_id AND m.path = r.path
  UNION ALL
  SELECT query_id, NULL, 0, '... [Too many results, truncated] ...', false, true
  FROM runs WHERE excl <= 100 GROUP BY query_id HAVING max(excl + c + 1) > 100
  UNION ALL
  SELECT symbol, NULL, 0, printf('No references found for ''%s''.', symbol), false, true
  FROM syms WHERE symbol NOT IN (SELECT query_id FROM files)
)
SELECT query_id, path, CAST(n AS INTEGER) AS n, text, {tokens('text')} AS tokens, is_long, within_cap FROM rows_out
"""

# --- vector index and change feed ------------------------------------------------------------
VEC_CTE = f"""
{CORPUS_CTE.strip()},
vec AS (
  SELECT COALESCE(c.project, 'global') AS project,
         sha256(COALESCE(c.path, 'vec/' || CAST(e.vec_id AS VARCHAR))) AS doc_id,
         c.path, c.content, e.embedding, e.label
  FROM embeddings e LEFT JOIN corpus c ON c.src_id = e.vec_id
),
batch AS (
  SELECT c.project, sha256(c.path) AS doc_id, c.path, c.content, e.embedding, e.label
  FROM corpus c LEFT JOIN embeddings e ON c.src_id = e.vec_id
  WHERE c.status = 'ok'
    AND lower(regexp_extract(string_split(c.path, '/')[-1], '(?s)^.+(\\.[^./]+)$', 1))
        IN ('.py', '.js', '.ts', '.jsx', '.tsx', '.md', '.txt')
    AND string_split(c.path, '/')[-1] NOT IN ('node_modules', '.git', '__pycache__', 'venv', '.env')
    AND NOT list_has_any(string_split(c.path, '/')[1:-2], ['node_modules', '.git', '__pycache__', 'venv', '.env'])
    AND len(list_filter(string_split(c.path, '/')[1:-2], lambda d: starts_with(d, '.'))) = 0
),
upserted AS (
  SELECT * FROM vec WHERE doc_id NOT IN (SELECT doc_id FROM batch)
  UNION ALL
  SELECT * FROM batch
),
changes AS (
  SELECT CASE WHEN d.doc_id IS NULL THEN 'missing/' || CAST(ev.user_id AS VARCHAR) ELSE d.source || '/' || d.lang || '/'
           || ['src', 'lib', 'docs', 'node_modules', '.cache', 'build', 'pkg'][d.doc_id % 7 + 1]
           || '/doc' || CAST(d.doc_id AS VARCHAR)
           || ['.py', '.md', '.txt', '.js', '.ts', '.tsx', '.jsx', '.PY', '.png'][d.doc_id % 9 + 1] END AS path,
         CASE ev.event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS op,
         CASE WHEN ev.event_type <> 'error'
              THEN regexp_replace(d.text, '\\r\\n?', chr(10), 'g') || chr(10) || '# rev ' || CAST(ev.event_id AS VARCHAR)
         END AS content,
         CAST(ev.ts AS TIMESTAMP) AS ts,
         ev.event_id AS seq
  FROM events ev LEFT JOIN documents d ON ev.user_id = d.doc_id
),
last_change AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS rn FROM changes
  ) WHERE rn = 1
)
"""

PER_FILE = f"""
SELECT query_id, path, COUNT(*) AS n_matches, CAST(min(n) AS INTEGER) AS first_line,
       CAST(max(n) AS INTEGER) AS last_line,
       CAST(SUM({tokens("printf('  Line %d: %s', n, " + py_strip('line') + ")")}) AS BIGINT) AS tokens
FROM m GROUP BY query_id, path
"""
ORACLE_SQL["references_after_sync"] = f"""
WITH {VEC_CTE.strip()},
merged AS (
  SELECT c.path, CASE WHEN l.path IS NULL THEN c.content WHEN l.op <> 'deleted' THEN l.content END AS content
  FROM corpus c LEFT JOIN last_change l ON c.path = l.path
),
{ref_tail('merged').strip()}
{PER_FILE}
"""

INDEX_OUT = ("project, doc_id, path, sha256(content) AS content_sha, CAST(COALESCE(label, -1) AS INTEGER) AS label, "
             "embedding IS NOT NULL AS has_embedding")

CENTROID = """
SELECT g AS query_id, list(m ORDER BY i) AS qv FROM (
  SELECT g, i, avg(CAST(x AS DOUBLE)) AS m FROM (
    SELECT {key} AS g, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM vec
  ) GROUP BY g, i
) GROUP BY g
"""

L2SQ = "list_sum(list_transform(generate_series(1, len(v.embedding)), lambda j: (v.embedding[j] - q.qv[j]) * (v.embedding[j] - q.qv[j])))"

ORACLE_SQL["knn_single"] = f"""
WITH {VEC_CTE},
q AS ({CENTROID.format(key="(label * 0)")})
SELECT doc_id, path, round(d, 6) AS distance FROM (
  SELECT v.doc_id, v.path, {L2SQ} AS d FROM vec v, q
) ORDER BY d, doc_id LIMIT 5
"""

ORACLE_SQL["knn_batch"] = f"""
WITH {VEC_CTE},
q AS ({CENTROID.format(key="label")}),
d AS (SELECT q.query_id, v.doc_id, v.path, {L2SQ} AS d FROM vec v, q)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, doc_id, path, round(d, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS rank FROM d)
WHERE rank <= 5
"""
ORACLE_SQL["knn_pruned"] = ORACLE_SQL["knn_batch"]

_DOT = "list_sum(list_transform(generate_series(1, len({a})), lambda j: CAST({a}[j] AS DOUBLE) * {b}[j]))"
_METRICS = {
    "l2sq": L2SQ,
    "ip": "1.0 - " + _DOT.format(a="v.embedding", b="q.qv"),
    "cosine": "1.0 - " + _DOT.format(a="v.embedding", b="q.qv") + " / (sqrt(" + _DOT.format(a="v.embedding", b="v.embedding")
              + ") * sqrt(" + _DOT.format(a="q.qv", b="q.qv") + "))",
}
for _m, _d in _METRICS.items():
    ORACLE_SQL[f"knn_index_{_m}"] = f"""
WITH {VEC_CTE},
q AS ({CENTROID.format(key="label")}),
idx AS (SELECT doc_id, path, embedding FROM upserted WHERE embedding IS NOT NULL
        UNION ALL SELECT sha256(doc_id || '#2'), path, embedding FROM upserted WHERE embedding IS NOT NULL),
d AS (SELECT q.query_id, v.doc_id, v.path, round({_d}, 12) AS d FROM idx v, q)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, doc_id, path, round(d, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS rank FROM d)
WHERE rank <= 5
"""

ORACLE_SQL["index_upsert"] = f"""
WITH {VEC_CTE}
SELECT {INDEX_OUT} FROM upserted
"""

ORACLE_SQL["index_delete"] = f"""
WITH {VEC_CTE}
SELECT {INDEX_OUT} FROM upserted
WHERE doc_id NOT IN (SELECT sha256(path) FROM last_change WHERE op = 'deleted')
"""

ORACLE_SQL["index_versions"] = f"""
WITH {VEC_CTE}
SELECT 0 AS version, {INDEX_OUT} FROM vec
UNION ALL
SELECT 1 AS version, {INDEX_OUT} FROM upserted
UNION ALL
SELECT 2 AS version, {INDEX_OUT} FROM upserted WHERE doc_id NOT IN (SELECT sha256(path) FROM last_change WHERE op = 'deleted')
"""

ORACLE_SQL["latest_change"] = f"""
WITH {VEC_CTE}
SELECT path, op, seq, sha256(content) AS content_sha FROM last_change
"""

ORACLE_SQL["index_sync"] = f"""
WITH {VEC_CTE},
valid AS (
  SELECT * FROM changes
  WHERE lower(regexp_extract(string_split(path, '/')[-1], '(?s)^.+(\\.[^./]+)$', 1))
        IN ('.py', '.js', '.ts', '.jsx', '.tsx', '.md', '.txt')
    AND len(list_filter(string_split(path, '/'),
            lambda p: (p IN ('node_modules', '.git', '__pycache__', 'venv', '.env') OR starts_with(p, '.'))
                      AND p <> 'workspace' AND p <> '.')) = 0
),
lastv AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS rn FROM valid
  ) WHERE rn = 1
),
ups AS (SELECT sha256(path) AS doc_id, path, content FROM lastv WHERE op <> 'deleted'),
dels AS (SELECT sha256(path) AS doc_id FROM lastv WHERE op = 'deleted'),
changed AS (
  SELECT COALESCE(v.project, regexp_extract(u.path, '^([^/]*)', 1)) AS project, u.doc_id, u.path, u.content,
         v.embedding, v.label
  FROM ups u LEFT JOIN vec v ON u.doc_id = v.doc_id
  WHERE v.content IS NULL OR sha256(v.content) <> sha256(u.content)
),
merged AS (
  SELECT * FROM vec WHERE doc_id NOT IN (SELECT doc_id FROM changed)
  UNION ALL
  SELECT * FROM changed
)
SELECT {INDEX_OUT} FROM merged WHERE doc_id NOT IN (SELECT doc_id FROM dels)
"""

# --- tree, project roots, config ---------------------------------------------------------------
PAGES_CTE = r"""
pp AS (
  SELECT * FROM (
    SELECT regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^?#]*)', 2), '/+$', '') AS path,
           ends_with(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^?#]*)', 2), '/') AS is_dir,
           lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
           contains(url, '?') AS has_query
    FROM pages
  ) WHERE path <> ''
),
ex AS (SELECT string_split(path, '/') AS p, len(string_split(path, '/')) AS n, is_dir AS leaf_dir FROM pp),
nd AS (
  SELECT array_to_string(p[1:k], '/') AS path, p[1:k] AS parts, CAST(k AS INTEGER) AS depth,
         (k < n OR leaf_dir) AS is_dir
  FROM (SELECT p, n, leaf_dir, unnest(generate_series(1, n)) AS k FROM ex)
),
node AS (SELECT path, first(parts) AS parts, first(depth) AS depth, bool_or(is_dir) AS is_dir FROM nd GROUP BY path),
kept AS (
  SELECT * FROM node
  WHERE NOT list_has_any(CASE WHEN is_dir THEN parts ELSE parts[1:depth - 1] END,
        ['.git', 'node_modules', '__pycache__', 'venv', '.venv', 'env', '.env', 'dist', 'build',
         'coverage', '.pytest_cache', '.idea', '.vscode'])
),
keyed AS (
  SELECT *, parts[-1] AS name,
         CASE WHEN depth > 1 THEN array_to_string(parts[1:depth - 1], '/') ELSE '' END AS parent,
         {'is_file': NOT is_dir, 'lname': lower(parts[-1]), 'name': parts[-1]} AS key
  FROM kept
),
flag AS (
  SELECT k.*, k.key = m.mk AS is_last
  FROM keyed k JOIN (SELECT parent, max(key) AS mk FROM keyed GROUP BY parent) m ON k.parent = m.parent
),
anc AS (
  SELECT path, depth, k, array_to_string(parts[1:k], '/') AS anc
  FROM (SELECT path, depth, parts, unnest(generate_series(1, depth)) AS k FROM flag)
),
rend AS (
  SELECT a.path,
         COALESCE(string_agg(CASE WHEN f.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY a.k)
                  FILTER (WHERE a.k < a.depth), '')
           || max(CASE WHEN a.k = a.depth THEN (CASE WHEN f.is_last THEN '└── ' ELSE '├── ' END) || f.name END) AS line,
         list(f.key ORDER BY a.k) AS sort_key
  FROM anc a JOIN flag f ON f.path = a.anc
  GROUP BY a.path
)
"""

ORACLE_SQL["tree_nodes"] = f"""
WITH {PAGES_CTE}
SELECT path, depth, name, is_dir, is_last FROM flag
"""

ORACLE_SQL["tree_listing"] = f"""
WITH {PAGES_CTE}
SELECT CAST(0 AS BIGINT) AS line_no, 'site/' AS line
UNION ALL
SELECT CAST(row_number() OVER (ORDER BY sort_key) AS BIGINT) AS line_no, line FROM rend
"""

ORACLE_SQL["project_root_join"] = f"""
WITH {PAGES_CTE},
files AS (SELECT DISTINCT path FROM pp WHERE NOT is_dir),
mk AS (
  SELECT DISTINCT dir, kind FROM (
    SELECT string_split(path, '/')[1] AS dir, 'git' AS kind FROM pp WHERE scheme = 'https'
    UNION ALL
    SELECT array_to_string(string_split(path, '/')[1:2], '/') AS dir, 'project' AS kind
    FROM pp WHERE has_query AND len(string_split(path, '/')) >= 3
  )
),
fd AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files),
an AS (
  SELECT dir, array_to_string(string_split(dir, '/')[1:k], '/') AS anc
  FROM (SELECT dir, unnest(generate_series(1, len(string_split(dir, '/')))) AS k
        FROM (SELECT DISTINCT dir FROM fd WHERE dir <> ''))
),
best AS (
  SELECT dir, anc AS root FROM (
    SELECT a.dir, a.anc, row_number() OVER (PARTITION BY a.dir ORDER BY (m.kind = 'project') DESC, length(a.anc) DESC) AS rn
    FROM an a JOIN mk m ON m.dir = a.anc
  ) WHERE rn = 1
)
SELECT fd.path, b.root, COALESCE(b.root, 'global') AS project FROM fd LEFT JOIN best b ON fd.dir = b.dir
"""

ORACLE_SQL["config_merge"] = r"""
WITH pl AS (
  SELECT 'p' || CAST(user_id AS VARCHAR) AS project,
         CASE user_id % 5 WHEN 1 THEN props || ' trailing' WHEN 2 THEN '{"daily_limit": 1, ' || substr(props, 2) ELSE props END AS json FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
  ) WHERE rn = 1
),
pkv AS (
  SELECT project, key, json_extract_string(json, '$."' || key || '"') AS value, 2 AS layer
  FROM (SELECT project, json, unnest(json_keys(json)) AS key FROM pl WHERE json_valid(json))
),
d AS (
  SELECT * FROM (VALUES ('daily_limit', '200000'),
                        ('exclude_patterns', '["node_modules",".git","__pycache__","venv",".env"]')) t(key, value)
),
g AS (SELECT key, json_extract_string('""" + GLOBAL_CONFIG + r"""', '$."' || key || '"') AS value
      FROM (SELECT unnest(json_keys('""" + GLOBAL_CONFIG + r"""')) AS key)),
gkv AS (
  SELECT pl.project, g.key, g.value, 1 AS layer FROM pl CROSS JOIN g
  WHERE NOT EXISTS (SELECT 1 FROM pkv WHERE pkv.project = pl.project AND pkv.key = g.key)
),
dkv AS (
  SELECT pl.project, d.key, d.value, 0 AS layer FROM pl CROSS JOIN d
  WHERE NOT EXISTS (SELECT 1 FROM pkv WHERE pkv.project = pl.project AND pkv.key = d.key) AND d.key NOT IN (SELECT key FROM g)
),
allkv AS (SELECT * FROM pkv UNION ALL SELECT * FROM gkv UNION ALL SELECT * FROM dkv)
SELECT a.project, a.key, a.value, CAST(a.layer AS INTEGER) AS layer,
       (pl.json IS NOT NULL AND NOT json_valid(pl.json)) AS bad_layer
FROM allkv a JOIN pl ON a.project = pl.project
"""

# --- synthetic code corpus: outlines and blocks in closed form ---------------------------------
from tokenloom.plans import code_corpus as _CC  # noqa: E402  (template text = input derivation)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SQL_SLOTS = {
    "K": "CAST(p_partkey AS VARCHAR)",
    "S": "CAST(p_size AS VARCHAR)",
    "NAME": "replace(p_name, ' ', '_')",
    "TYPE": "lower(p_type)",
    "CENTS": "CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR)",
    "DEC": ("(CASE p_partkey % 3 WHEN 0 THEN " + _q(_CC.DEC_PROPERTY) + " WHEN 1 THEN "
            + _q("    @cache(\n        maxsize=") + " || CAST(p_size AS VARCHAR) || " + _q(")\n") + " ELSE '' END)"),
    "NEST": "(CASE WHEN p_partkey % 4 = 0 THEN " + _q(_CC.NEST) + " ELSE '' END)",
}


def _render_sql(template: str) -> str:
    return "(" + " || ".join(_q(t) if kind == "lit" else _SQL_SLOTS[t] for kind, t in _CC.tokens_of(template)) + ")"


NL = "chr(10)"
K = "CAST(p_partkey AS VARCHAR)"
BRAND = "lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'))"
PY_PATH = f"('code/' || {BRAND} || '/part_' || {K} || '.py')"
JS_PATH = f"('web/' || {BRAND} || '/part' || {K} || CASE WHEN p_partkey % 2 = 1 THEN '.ts' ELSE '.js' END)"
MSG = "printf('# Function ''%s'' could not be extracted accurately. Use raw read or check name.', {})"

PY_OUTLINE = (f"('def make_' || {K} || '(size=' || CAST(p_size AS VARCHAR) || '): ...' || {NL}"
              f" || 'class Part' || {K} || '(object): ...' || {NL}"
              f" || 'def __init__(self, size): ...' || {NL}"
              f" || (CASE p_partkey % 3 WHEN 0 THEN '@property' || {NL}"
              f"      WHEN 1 THEN '@cache(' || {NL} || 'maxsize=' || CAST(p_size AS VARCHAR) || ')' || {NL} ELSE '' END)"
              f" || 'def price(self, ...' || {NL}"
              f" || 'async def fetch(self): return ' || {K} || ' ...' || {NL}"
              f" || 'def big_' || {K} || '(): ...')")

JS_OUTLINE = (f"('export function price' || {K} || '(qty) {{ ...' || {NL}"
              f" || 'class Part' || {K} || ' extends Base {{ ...' || {NL}"
              f" || 'constructor(size) {{ ...' || {NL}"
              f" || 'async load(id) {{ ...' || {NL}"
              f" || 'get label() {{ return \"' || replace(p_name, ' ', '_') || '\"; }} ...' || {NL}"
              f" || 'export const make' || {K} || ' = (size) => new Part' || {K} || '(size); ...' || {NL}"
              f" || 'items.forEach((item) => {{ ...' || {NL}"
              f" || 'export const Card' || {K} || ' = ({{ ...' || {NL}"
              f" || 'abstract class Shape' || {K} || ' {{ area(): number {{ return ' || CAST(p_size AS VARCHAR) || '; }} }} ...' || {NL}"
              f" || 'class Box' || {K} || '<T> {{ ...' || {NL} || 'put( ...' || {NL} || 'id<U>(x: U): U {{ return x; }} ...' || {NL}"
              f" || 'const one' || {K} || ' = () => 1; const two' || {K} || ' = (a = (2)) => a; ...' || {NL}"
              f" || 'const one' || {K} || ' = () => 1; const two' || {K} || ' = (a = (2)) => a; ...')")

CENTS = "CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR)"
PY_PRICE_BLOCK = (f"((CASE p_partkey % 3 WHEN 0 THEN '    @property' || {NL}"
                  f"   WHEN 1 THEN '    @cache(' || {NL} || '        maxsize=' || CAST(p_size AS VARCHAR) || ')' || {NL}"
                  f"   ELSE '' END)"
                  f" || '    def price(self,' || {NL} || '              qty=1):' || {NL}"
                  f" || (CASE WHEN p_partkey % 4 = 0 THEN '        def helper(x):' || {NL} || '            return x' || {NL}"
                  f"     ELSE '' END)"
                  f" || '        return qty * ' || {CENTS})")
PY_HELPER_BLOCK = f"('        def helper(x):' || {NL} || '            return x')"
JS_LOAD_BLOCK = (f"('async load(id) {{' || {NL} || '    const url = `/parts/${{id}}?q={{`;' || {NL}"
                 f" || '    return fetch(url);' || {NL} || '  }}')")
JS_PRICE_BLOCK = (f"('function price' || {K} || '(qty) {{' || {NL} || '  const inner = (x) => x * 2;' || {NL}"
                  f" || '  return qty * ' || {CENTS} || ';' || {NL} || '}}')")

JS_PUT_BLOCK = (f"('put(' || {NL} || '    item: T,' || {NL} || '    times = limit(' || CAST(p_size AS VARCHAR) || '),' || {NL}"
                f" || '  ): void {{ this.items.push(item); }}')")
JS_CARD_BLOCK = (f"('Card' || {K} || ' = ({{' || {NL} || '  size,' || {NL} || '}}) => {{' || {NL}"
                 f" || '  return [size].map((x) => x + ' || CAST(p_size AS VARCHAR) || ');' || {NL} || '}}')")

ORACLE_SQL["outline_python"] = f"""
SELECT path, text, {tokens('text')} AS tokens, true AS balanced
FROM (SELECT {PY_PATH} AS path, {PY_OUTLINE} AS text FROM part)
"""

ORACLE_SQL["outline_js"] = f"""
SELECT path, text, {tokens('text')} AS tokens, true AS balanced
FROM (SELECT {JS_PATH} AS path, {JS_OUTLINE} AS text FROM part)
"""

ORACLE_SQL["function_blocks"] = f"""
WITH r AS (
  SELECT {PY_PATH} AS path, 'price' AS name, {PY_PRICE_BLOCK} AS block FROM part
  UNION ALL
  SELECT {PY_PATH}, 'helper', CASE WHEN p_partkey % 4 = 0 THEN {PY_HELPER_BLOCK} END FROM part
  UNION ALL
  SELECT {PY_PATH}, 'Part' || {K}, NULL FROM part
  UNION ALL
  SELECT {JS_PATH}, 'load', {JS_LOAD_BLOCK} FROM part
  UNION ALL
  SELECT {JS_PATH}, 'price' || {K}, {JS_PRICE_BLOCK} FROM part
  UNION ALL
  SELECT {JS_PATH}, 'missing', NULL FROM part
  UNION ALL
  SELECT {JS_PATH}, 'put', {JS_PUT_BLOCK} FROM part
  UNION ALL
  SELECT {JS_PATH}, 'Card' || {K}, {JS_CARD_BLOCK} FROM part
  UNION ALL
  SELECT {JS_PATH}, 'two' || {K}, 'two' || {K} || ' = (a = (2)) => a' FROM part
)
SELECT path, name, COALESCE(block, {MSG.format('name')}) AS text,
       CASE WHEN block IS NOT NULL THEN {tokens('block')} ELSE CAST(0 AS BIGINT) END AS tokens,
       block IS NOT NULL AS found
FROM r
"""

ORACLE_SQL["reduction_report"] = f"""
WITH f AS (
  SELECT '.py' AS ext, 'py_outline' AS stage, {tokens(_render_sql(_CC.PY_TEMPLATE))} AS raw_tokens,
         {tokens(PY_OUTLINE)} AS reduced FROM part
  UNION ALL
  SELECT CASE WHEN p_partkey % 2 = 1 THEN '.ts' ELSE '.js' END, 'js_outline',
         {tokens(_render_sql(_CC.JS_TEMPLATE))}, {tokens(JS_OUTLINE)} FROM part
)
SELECT ext, stage, COUNT(*) AS files, CAST(SUM(raw_tokens) AS BIGINT) AS raw_tokens,
       CAST(SUM(reduced) AS BIGINT) AS reduced_tokens,
       SUM(reduced) / SUM(raw_tokens) AS ratio
FROM f GROUP BY ext, stage
"""

# Full retrieval: the reduced view of a prose file is its comment-strip view, except that a
# '.py' file (no definitions in prose) has the empty outline.
ORACLE_SQL["knn_retrieval"] = f"""
WITH {VEC_CTE},
q AS ({CENTROID.format(key="label")}),
d AS (SELECT q.query_id, v.doc_id, v.path, v.content, {L2SQ} AS d FROM vec v, q),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS rank FROM d)
  WHERE rank <= 7
),
v AS (
  SELECT t.*,
         CASE WHEN t.path IS NULL THEN 'snippet'
              WHEN ends_with(t.path, '.py') THEN 'py_outline' ELSE 'stripped' END AS stage,
         CASE WHEN t.path IS NULL THEN NULL
              WHEN ends_with(t.path, '.py') THEN ''
              ELSE array_to_string(list_filter({splitlines("regexp_replace(t.content, '#[^\\n]*', '', 'g')")},
                                   lambda l: regexp_matches(l, '[^{SPACE}]')), chr(10)) END AS text
  FROM top t
)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, doc_id, path, stage,
       sha256(text) AS content_sha, rank <= 5 AS within_max,
       CASE WHEN path IS NULL THEN CAST(0 AS BIGINT) ELSE {tokens('text')} END AS tokens,
       CAST(SUM(CASE WHEN path IS NULL THEN CAST(0 AS BIGINT) ELSE {tokens('text')} END)
            OVER (PARTITION BY query_id) AS BIGINT) AS query_tokens
FROM v
"""

_RETRIEVAL = ORACLE_SQL["knn_retrieval"].strip()
ORACLE_SQL["retrieval_admitted"] = f"""
WITH asked AS (SELECT query_id, max(query_tokens) AS tokens FROM ({_RETRIEVAL}) GROUP BY query_id),
run AS (SELECT *, COALESCE(SUM(tokens) OVER (ORDER BY query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM asked)
SELECT query_id AS event_id, CAST(tokens AS BIGINT) AS tokens, 'search' AS source, '2024-03-01' AS day
FROM run WHERE used < {RETRIEVAL_LIMIT} AND tokens > 0
"""

ORACLE_SQL["corpus_views"] = f"""
WITH {CORPUS_CTE},
v AS (
  SELECT path, CASE WHEN status <> 'ok' THEN 'unreadable' WHEN ends_with(path, '.py') THEN 'py_outline' ELSE 'stripped' END AS stage,
         CASE WHEN status <> 'ok' THEN '# could not read file: ' || status WHEN ends_with(path, '.py') THEN ''
              ELSE array_to_string(list_filter({splitlines("regexp_replace(content, '#[^\\n]*', '', 'g')")},
                                   lambda l: regexp_matches(l, '[^{SPACE}]')), chr(10)) END AS text
  FROM corpus
)
SELECT path, stage, sha256(text) AS text_sha, CASE WHEN stage = 'unreadable' THEN CAST(0 AS BIGINT) ELSE {tokens('text')} END AS tokens FROM v
"""
