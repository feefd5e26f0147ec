"""SQL twins of import verification, corpus lookups, policies and requests."""

from __future__ import annotations

from codesieve.functions.text import any_glob
from codesieve.operators import corpus, requests
from codesieve.plans.oracle import rules as R
from codesieve.plans.oracle import spans as OS
from codesieve.plans.oracle.naming import names_in
from codesieve.plans.oracle.review import DIFF_CTE, _chain
from codesieve.plans.oracle.sources import FRAMES_CTE, POLICIES_CTE, arr, lstrip, q, strip, with_files, with_lines
from codesieve.rulebook import dependencies as P

PY = q(P.PY_IMPORT_LINE)
py_name = lambda line: f"split_part(coalesce(nullif(regexp_extract({line}, {PY}, 1), ''), regexp_extract({line}, {PY}, 2)), '.', 1)"
js_specs = lambda line: "list_concat(" + ", ".join(f"regexp_extract_all({line}, {q(f)}, 1)" for f in P.JS_IMPORT_FORMS) + ")"
JS_NAME = """CASE WHEN spec[1] IN ('.', '/', '#') THEN NULL WHEN starts_with(spec, 'node:') THEN spec WHEN starts_with(spec, '@') THEN CASE WHEN contains(spec, '/') THEN split_part(spec, '/', 1) || '/' || split_part(spec, '/', 2) END ELSE split_part(spec, '/', 1) END"""
# Logical lines of Python files: comments and strings gone, lines joined at backslashes and inside strings.
_gap = "[\\s\\x02]"
DYNAMIC = f"(?:\\bimportlib\\.import_module|\\b__import__){_gap}*\\({_gap}*"
LOGICAL_CTES = [*OS.SPAN_CTES[:3], f"""cleaned AS (SELECT t.path, replace(string_agg(CASE WHEN ord = 1 THEN piece WHEN starts_with(tok, '#') THEN substr(piece, len(tok) + 1)
 WHEN regexp_matches(before, {q(DYNAMIC + '$')}) THEN piece ELSE '""' || repeat(chr(2), (len(tok) - len(replace(tok, chr(10), '')))::INTEGER) || substr(piece, len(tok) + 1) END, '' ORDER BY ord), chr(92) || chr(10), ' ' || chr(2)) AS body
 FROM (SELECT *, lag(substr(piece, len(tok) + 1)) OVER (PARTITION BY path ORDER BY ord) AS before FROM toks) t JOIN pyf ON pyf.path = t.path AND py GROUP BY t.path)""",
    """logical AS (SELECT path, line, (1 + coalesce(sum(1 + len(line) - len(replace(line, chr(2), ''))) OVER (PARTITION BY path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS line_no FROM (
 SELECT path, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS ord FROM cleaned))""",
    f"""py_names AS MATERIALIZED (SELECT path, line_no, split_part(name, '.', 1) AS name FROM (SELECT path, line_no, unnest(list_concat(
  flatten(list_transform(regexp_extract_all(line, {q(f"(?:^|[;:]){_gap}*import{_gap}+([0-9A-Za-z_.]+(?:{_gap}+as{_gap}+[0-9A-Za-z_]+)?(?:{_gap}*,{_gap}*[0-9A-Za-z_.]+(?:{_gap}+as{_gap}+[0-9A-Za-z_]+)?)*)")}, 1),
   lambda x: list_transform(string_split(x, ','), lambda y: regexp_extract(y, '[0-9A-Za-z_.]+')))),
  regexp_extract_all(line, {q(f"(?:^|[;:]){_gap}*from{_gap}+([0-9A-Za-z_][0-9A-Za-z_.]*){_gap}+import")}, 1),
  regexp_extract_all(line, {q(DYNAMIC + "[" + chr(34) + chr(39) + "]+([0-9A-Za-z_][0-9A-Za-z_.]*)")}, 1))) AS name FROM logical WHERE contains(line, 'import')) WHERE name <> '')"""]
PY_ROWS = "SELECT path, line_no, name FROM py_names"
JS_ROWS = f"SELECT path, line_no, name FROM (SELECT path, line_no, {JS_NAME} AS name FROM (SELECT path, line_no, unnest({js_specs('line')}) AS spec FROM lines WHERE language IN ('javascript', 'typescript'))) WHERE name IS NOT NULL"
FIRST_CTE = ",\n".join(LOGICAL_CTES) + f",\nfirst_rows AS MATERIALIZED (SELECT path, ecosystem, name, min(line_no)::INTEGER AS line_no FROM (SELECT *, 'python' AS ecosystem FROM ({PY_ROWS}) UNION ALL SELECT *, 'npm' FROM ({JS_ROWS})) GROUP BY 1, 2, 3)"
REGISTRY = [("python", "requests", "exists"), ("python", "numpy", "exists"), ("python", "pyyaml", "exists"), ("python", "mysqlclient", "exists"),
            ("python", "django", "unavailable"), ("npm", "react", "exists"), ("npm", "@scope/pkg", "exists")]
EXCLUDE = ("totally_made_up_1*",)
REG_CTE = "registry(e, n, s) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in REGISTRY) + ")"
pep = lambda x: f"lower(regexp_replace({x}, '[-_.]+', '-', 'g'))"


def classified(rows: str, keys: str, own: str = "false") -> str:
    return f"""SELECT {keys}, ecosystem, name, line_no, status, CASE status WHEN 'exists' THEN CASE ecosystem WHEN 'python' THEN 'PyPI: ' || {pep('name')} ELSE 'npm: ' || name END
 WHEN 'exists-as' THEN 'import name for PyPI distribution ''' || al || '''' WHEN 'missing' THEN CASE ecosystem WHEN 'python' THEN 'no such distribution on PyPI' ELSE 'no such package on the npm registry' END
 WHEN 'invalid-name' THEN CASE ecosystem WHEN 'python' THEN 'not a valid Python module name' ELSE 'not a valid npm package name' END WHEN 'unverifiable' THEN 'registry gave no definitive answer'
 WHEN 'stdlib' THEN 'Python standard library' WHEN 'builtin' THEN 'Node.js built-in module' WHEN 'first-party' THEN 'module provided by this change' WHEN 'excluded' THEN 'matched an exclude glob; not sent to any registry' END AS detail FROM (
SELECT r.*, CASE WHEN regexp_matches(name, {q(any_glob(EXCLUDE))}) THEN 'excluded' WHEN ecosystem = 'python' AND {own} THEN 'first-party'
 WHEN ecosystem = 'python' THEN CASE WHEN name IN {names_in(P.STDLIB)} THEN 'stdlib' WHEN NOT regexp_matches(name, {q(P.PY_MODULE)}) THEN 'invalid-name'
  WHEN a.s = 'exists' THEN 'exists' WHEN a.s = 'unavailable' THEN 'unverifiable' WHEN b.s = 'exists' THEN 'exists-as' WHEN b.s = 'unavailable' THEN 'unverifiable' ELSE 'missing' END
 ELSE CASE WHEN starts_with(name, 'node:') OR name IN {names_in(P.NODE_BUILTINS)} THEN 'builtin' WHEN len(name) > 214 OR NOT regexp_matches(name, {q(P.NPM_NAME)}) THEN 'invalid-name'
  WHEN a.s = 'exists' THEN 'exists' WHEN a.s = 'unavailable' THEN 'unverifiable' ELSE 'missing' END END AS status
FROM (SELECT *, CASE WHEN ecosystem = 'python' THEN {R.mapped('name', P.ALIASES)} END AS al FROM ({rows})) r LEFT JOIN registry a ON a.e = r.ecosystem AND a.n = CASE r.ecosystem WHEN 'python' THEN {pep('r.name')} ELSE r.name END
LEFT JOIN registry b ON b.e = r.ecosystem AND b.n = {pep('r.al')})"""


DIFF_IMPORTS = f"""SELECT diff_id, ecosystem, name, min(line_no)::INTEGER AS line_no FROM (
 SELECT diff_id, line_no, 'python' AS ecosystem, {py_name('text')} AS name FROM al WHERE path LIKE '%.py' AND regexp_matches(text, {PY})
 UNION ALL SELECT diff_id, line_no, 'npm', name FROM (SELECT diff_id, line_no, {JS_NAME} AS name FROM (SELECT diff_id, line_no, unnest({js_specs('text')}) AS spec FROM al
  WHERE regexp_matches(path, '\\.(js|jsx|mjs|cjs|ts|tsx)$'))) WHERE name IS NOT NULL) GROUP BY 1, 2, 3"""
AL_CTE = "al AS MATERIALIZED (SELECT a.diff_id, f.path, a.line_no, a.text FROM added a JOIN fd f ON f.diff_id = a.diff_id AND f.file_no = a.file_no)"
OWN_CTE = """own AS MATERIALIZED (SELECT DISTINCT diff_id, name FROM (SELECT diff_id, unnest([regexp_replace(split_part(path, '/', -1), '\\.py$', ''), CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END]) AS name FROM fd WHERE path LIKE '%.py') WHERE name IS NOT NULL)"""
VERDICT = "CASE WHEN missing > 0 THEN 'FAIL' WHEN undecided > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict"
counts = lambda key, inner: f"SELECT *, {VERDICT} FROM (SELECT {key}, count(*) AS packages, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status IN ('unverifiable', 'invalid-name')) AS undecided FROM ({inner}) GROUP BY {key})"


def sections_cte(name: str, level: int) -> str:
    prefix = "#" * level + " "
    return f"""{name}_l AS (SELECT path, line_no, line, sum(starts_with({lstrip('line')}, '```')::INTEGER) OVER (PARTITION BY path ORDER BY line_no) % 2 = 1 AS fenced FROM lines WHERE language = 'markdown'),
{name}_h AS (SELECT *, NOT fenced AND starts_with(line, {q(prefix)}) AND NOT starts_with(line, {q(prefix + '#')}) AS is_head, sum((NOT fenced AND starts_with(line, {q(prefix)}) AND NOT starts_with(line, {q(prefix + '#')}))::INTEGER) OVER (PARTITION BY path ORDER BY line_no) AS sec FROM {name}_l),
{name} AS MATERIALIZED (SELECT path, sec - 1 AS ord, {strip(f"substr(min(line) FILTER (is_head), {len(prefix) + 1})")} AS heading, coalesce({strip("string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_head)")}, '') AS body FROM {name}_h WHERE sec > 0 GROUP BY path, sec)"""


SECTION_QUERIES = ["preamble", "hive-mind", "power-of-10", "toc", "full", "nothing", "identity"]
_first = lambda prefix: f"(SELECT arg_min(heading, ord) FROM s2 WHERE s2.path = a.path AND starts_with(upper(heading), upper({prefix})))"
_shown = lambda prefix: f"(SELECT '## ' || arg_min(heading, ord) || chr(10) || chr(10) || arg_min(body, ord) FROM s2 WHERE s2.path = a.path AND starts_with(upper(heading), upper({prefix})))"
_toc = " || chr(10) || ".join(f"'- {k}: ' || coalesce({_first(q(p))}, {q(p)})" for k, p in corpus.SECTIONS.items())
SECTION_LOOKUP = f"""SELECT path, section, CASE WHEN content IS NULL THEN 'no-document' WHEN section IN ('full', 'toc') THEN 'found' WHEN prefix IS NULL THEN 'unknown' WHEN shown IS NULL THEN 'missing' ELSE 'found' END AS status,
 CASE WHEN content IS NULL THEN NULL WHEN section = 'full' THEN content WHEN section = 'toc' THEN {_toc} || chr(10) || '- full: the whole document' || coalesce(chr(10) || chr(10) || {_shown("'PREAMBLE'")}, '') ELSE shown END AS text FROM (
 SELECT a.*, {_shown('prefix')} AS shown FROM (SELECT b.*, f.content, {R.mapped(R.mapped('b.section', {**{k: k for k in corpus.SECTIONS}, **corpus.FORMER}), corpus.SECTIONS)} AS prefix FROM (
  SELECT path, unnest([{', '.join(f"{arr(SECTION_QUERIES)}[(doc_id // 10 + {k}) % {len(SECTION_QUERIES)} + 1]" for k in (0, 1, 3))}]) AS section FROM files WHERE language = 'markdown'
  UNION ALL SELECT path || 'x', 'toc' FROM files WHERE language = 'markdown' AND doc_id % 3 = 0) b LEFT JOIN files f ON f.path = b.path AND f.language = 'markdown') a) a"""
AREA_QUERIES = ["7", "quality", "KA-12", "engineering", "security", "nothing"]
NUMBERED = f"list_transform({arr(corpus.AREAS)}, lambda a, i: {{'a': lower(a), 'n': i}})"
AREA = f"""SELECT path, query, number::INTEGER AS number, ambiguous, heading FROM (
 SELECT *, CASE WHEN d <> '' THEN d::INTEGER WHEN len(h) = 1 THEN h[1].n END AS number, d = '' AND len(h) > 1 AS ambiguous FROM (
  SELECT path, query, regexp_extract(query, '\\d+', 0) AS d, list_filter({NUMBERED}, lambda s: contains(s.a, lower(query))) AS h FROM (
   SELECT path, {arr(AREA_QUERIES)}[(doc_id // 10) % {len(AREA_QUERIES)} + 1] AS query FROM files WHERE language = 'markdown'))) LEFT JOIN (
 SELECT path, n AS number, arg_min(heading, ord) AS heading FROM (SELECT *, TRY_CAST(nullif(regexp_extract(heading, '^KA-(\\d+)\\b', 1), '') AS INTEGER) AS n FROM s3) WHERE n IS NOT NULL GROUP BY 1, 2) USING (path, number)"""

RPC = f"""SELECT seq, code::INTEGER AS code, message, id FROM (
SELECT seq, CASE WHEN v IS NULL THEN -32700 WHEN NOT ok THEN -32600 WHEN NOT has_m THEN -32600 WHEN m NOT IN {names_in(requests.METHODS)} THEN -32601
  WHEN json_type(v, '$.params') NOT IN ('OBJECT', 'NULL') AND (v->'$.params') NOT IN ('[]') THEN -32602 WHEN m = 'tools/call' AND (NOT tool_ok OR args_bad) THEN -32602 ELSE 0 END AS code,
 CASE WHEN v IS NULL THEN 'Parse error' WHEN NOT ok THEN 'Not a valid JSON-RPC 2.0 message.' WHEN NOT has_m THEN 'Missing method.' WHEN m NOT IN {names_in(requests.METHODS)} THEN 'Method not found: ' || m
  WHEN json_type(v, '$.params') NOT IN ('OBJECT', 'NULL') AND (v->'$.params') NOT IN ('[]') THEN 'params must be an object.' WHEN m = 'tools/call' AND NOT tool_ok THEN 'Unknown tool: ' || coalesce(v->>'$.params.name', 'None')
  WHEN m = 'tools/call' AND args_bad THEN 'Tool arguments must be an object.' WHEN m = 'initialize' THEN CASE WHEN (v->>'$.params.protocolVersion') IN {names_in(requests.VERSIONS)} THEN (v->>'$.params.protocolVersion') ELSE '{requests.LATEST}' END ELSE m END AS message,
 (v->'$.id')::VARCHAR AS id, v IS NULL OR NOT ok OR NOT has_m OR (v->'$.id') IS NOT NULL AS answered FROM (
 SELECT seq, v, coalesce(v->>'$.jsonrpc' = '2.0', false) AS ok, coalesce(json_type(v, '$.method') = 'VARCHAR', false) AS has_m, (v->>'$.method') AS m,
  coalesce(v->>'$.params.name' IN {names_in(requests.TOOLS)}, false) AS tool_ok, coalesce(json_type(v, '$.params.arguments') NOT IN ('OBJECT', 'NULL'), false) AS args_bad FROM (
  SELECT seq, CASE WHEN json_valid(raw) THEN raw::JSON END AS v FROM frames WHERE trim(raw) <> ''))) WHERE answered"""
POLICY = f"""SELECT config_id, problem, CASE WHEN problem = 'ok' THEN coalesce(v->>'$.require_tests', 'warn') END AS require_tests, CASE WHEN problem = 'ok' THEN coalesce((v->>'$.min_test_trigger_lines')::BIGINT, 5) END AS min_lines FROM (
SELECT config_id, v, CASE WHEN v IS NULL THEN 'invalid JSON' WHEN json_type(v) <> 'OBJECT' THEN 'not an object' WHEN len(list_filter(json_keys(v), lambda k: k NOT IN {names_in(requests.KEYS)})) > 0 THEN 'unknown key'
 WHEN len(list_filter(json_extract(v, '$.exclude[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'exclude' WHEN len(list_filter(json_extract(v, '$.test_globs[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'test_globs'
 WHEN json_type(v, '$.fail_on_review') <> 'BOOLEAN' THEN 'fail_on_review' WHEN (v->>'$.require_tests') NOT IN ('off', 'warn', 'fail') THEN 'require_tests'
 WHEN TRY_CAST(v->>'$.min_test_trigger_lines' AS BIGINT) < 0 THEN 'min_test_trigger_lines' WHEN json_type(v, '$.business_logic') <> 'OBJECT' THEN 'business_logic' ELSE 'ok' END AS problem
FROM (SELECT config_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS v FROM policies))"""


def sql() -> dict[str, str]:
    files_classified = classified("SELECT * FROM first_rows", "path")
    own = "EXISTS (SELECT 1 FROM own o WHERE o.diff_id = r.diff_id AND o.name = r.name)"
    diff_classified = classified(DIFF_IMPORTS, "diff_id", own)
    chain = _chain(AL_CTE, OWN_CTE, REG_CTE)
    return {
        "imports_py": with_lines(f"SELECT path, line_no::INTEGER AS line_no, name FROM ({PY_ROWS})", *LOGICAL_CTES),
        "imports_logical": "WITH " + ",\n".join([OS.python_files_cte(), *LOGICAL_CTES]) + "\n" + PY_ROWS,
        "imports_js": with_lines(f"SELECT path, line_no::INTEGER AS line_no, name FROM ({JS_ROWS})"),
        "first_import": with_lines("SELECT * FROM first_rows", FIRST_CTE),
        "pep503": with_lines(f"SELECT path, name, {pep('name')} AS normal FROM first_rows", FIRST_CTE),
        "js_package": with_lines(f"SELECT path, line_no::INTEGER AS line_no, spec, {JS_NAME} AS package FROM (SELECT path, line_no, unnest({js_specs('line')}) AS spec FROM lines WHERE language IN ('javascript', 'typescript'))"),
        "classify_imports": with_lines(files_classified, FIRST_CTE, REG_CTE),
        "diff_imports": chain + diff_classified,
        "dependency_verdict": chain + counts("diff_id", diff_classified),
        "split_headings": with_lines("SELECT path, 2 AS level, ord::INTEGER AS ord, heading, md5(body) AS body FROM s2 UNION ALL SELECT path, 3, ord::INTEGER, heading, md5(body) FROM s3", sections_cte("s2", 2), sections_cte("s3", 3)),
        "section_lookup": with_lines(SECTION_LOOKUP, sections_cte("s2", 2)),
        "corpus_lookup": with_lines("SELECT path, '## ' || arg_min(heading, ord) || chr(10) || chr(10) || arg_min(body, ord) AS text FROM s2 WHERE starts_with(upper(heading), 'PREAMBLE') GROUP BY path", sections_cte("s2", 2)),
        "corpus_area": with_lines(AREA, sections_cte("s3", 3)),
        "rpc_dispatch": "WITH " + FRAMES_CTE + RPC,
        "config_validate": "WITH " + POLICIES_CTE + POLICY,
    }


__all__ = ["DIFF_CTE", "sql", "with_files"]
