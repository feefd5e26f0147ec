"""SQL twins of the change review, with running counts instead of row-local folds."""

from __future__ import annotations

from codesieve.plans.oracle import spans as OS
from codesieve.plans.oracle import rules as R
from codesieve.plans.oracle.paths import BASE, EXT, GLOBS
from codesieve.plans.oracle.sources import diffs_cte, files_cte, q
from codesieve.rulebook import files as T
from codesieve.rulebook import gate as G

HUNK = "^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@"
DIFF_CTE = f"""dl AS (SELECT diff_id, unnest(string_split(diff, chr(10))) AS raw, generate_subscripts(string_split(diff, chr(10)), 1) AS ord FROM diffs),
df AS (SELECT *, sum(starts_with(raw, 'diff --git ')::INTEGER) OVER (PARTITION BY diff_id ORDER BY ord) - 1 AS file_no FROM dl),
dh AS (SELECT *, sum(regexp_matches(raw, '{HUNK}')::INTEGER) OVER (PARTITION BY diff_id, file_no ORDER BY ord) AS hunk_no FROM df),
dk AS (SELECT *, regexp_matches(raw, '{HUNK}') AS is_head, first_value(raw) OVER (PARTITION BY diff_id, file_no, hunk_no ORDER BY ord) AS head FROM dh),
db AS (SELECT *, CASE WHEN regexp_extract(head, '{HUNK}', 2) = '' THEN 1 ELSE regexp_extract(head, '{HUNK}', 2)::INTEGER END AS old_n,
 CASE WHEN regexp_extract(head, '{HUNK}', 4) = '' THEN 1 ELSE regexp_extract(head, '{HUNK}', 4)::INTEGER END AS new_n, regexp_extract(head, '{HUNK}', 3)::INTEGER AS start_at,
 sum(CASE WHEN is_head OR starts_with(raw, '+') OR starts_with(raw, chr(92)) THEN 0 ELSE 1 END) OVER w AS old_c,
 sum(CASE WHEN is_head OR starts_with(raw, '-') OR starts_with(raw, chr(92)) THEN 0 ELSE 1 END) OVER w AS new_c FROM dk WHERE hunk_no > 0
 WINDOW w AS (PARTITION BY diff_id, file_no, hunk_no ORDER BY ord)),
dlive AS (SELECT *, coalesce(lag(old_c) OVER o, 0) < old_n OR coalesce(lag(new_c) OVER o, 0) < new_n AS live FROM db WINDOW o AS (PARTITION BY diff_id, file_no, hunk_no ORDER BY ord)),
added AS MATERIALIZED (SELECT diff_id, file_no, start_at + new_c - 1 AS line_no, substr(raw, 2) AS text FROM dlive WHERE live AND NOT is_head AND starts_with(raw, '+')),
dheads AS (SELECT diff_id, file_no, ord, raw FROM dk WHERE hunk_no = 0 UNION ALL SELECT diff_id, file_no, ord, raw FROM dlive WHERE NOT live AND NOT is_head),
fd AS MATERIALIZED (SELECT *, CASE WHEN deleted THEN old_path ELSE coalesce(new_path, old_path) END AS path FROM (
 SELECT diff_id, file_no, bool_or(starts_with(raw, 'deleted file mode')) AS deleted,
  CASE WHEN bool_or(starts_with(raw, 'deleted file mode')) THEN 'deleted' WHEN bool_or(starts_with(raw, 'new file mode')) THEN 'added' WHEN bool_or(starts_with(raw, 'rename ')) THEN 'renamed' ELSE 'modified' END AS status,
  bool_or(starts_with(raw, 'Binary files ') OR starts_with(raw, 'GIT binary patch')) AS is_binary,
  regexp_replace(coalesce(arg_max(CASE WHEN starts_with(raw, 'rename from ') THEN substr(raw, 13) ELSE substr(raw, 5) END, ord) FILTER (starts_with(raw, 'rename from ') OR (starts_with(raw, '--- ') AND raw <> '--- /dev/null')),
    any_value(regexp_extract(raw, '^diff --git (.*?) b/', 1)) FILTER (starts_with(raw, 'diff --git '))), '^[ab]/', '') AS old_path,
  regexp_replace(coalesce(arg_max(CASE WHEN starts_with(raw, 'rename to ') THEN substr(raw, 11) ELSE substr(raw, 5) END, ord) FILTER (starts_with(raw, 'rename to ') OR (starts_with(raw, '+++ ') AND raw <> '+++ /dev/null')),
    any_value(regexp_extract(raw, '^diff --git .*? (b/.*)$', 1)) FILTER (starts_with(raw, 'diff --git '))), '^[ab]/', '') AS new_path
 FROM dheads WHERE file_no >= 0 GROUP BY diff_id, file_no)),
rv AS MATERIALIZED (SELECT f.*, coalesce(n_added, 0) AS n_added, first_line, {R.mapped(f'lower({EXT})', T.REVIEW_LANGUAGES)} AS language,
 (regexp_matches(path, {q(GLOBS)}) OR regexp_matches({BASE}, {q(GLOBS)})) AS is_test FROM fd f LEFT JOIN (
 SELECT diff_id, file_no, count(*) AS n_added, min(line_no) AS first_line FROM added GROUP BY 1, 2) a ON a.diff_id = f.diff_id AND a.file_no = f.file_no),
sk AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(path, '^src/core/.*$') THEN 'excluded' WHEN status = 'deleted' THEN 'deleted' WHEN is_binary THEN 'binary' WHEN language IS NULL THEN 'not-code' WHEN n_added = 0 THEN 'no-added-lines' END AS skip FROM rv)"""

# The gate's CTEs read a table called files; here its rows are the added-line fragments.
FRAGMENTS = """SELECT s.diff_id || chr(9) || s.file_no || chr(9) || s.path AS path, s.language, string_agg(a.text, chr(10) ORDER BY a.line_no) AS content
 FROM sk s JOIN added a ON a.diff_id = s.diff_id AND a.file_no = s.file_no WHERE s.skip IS NULL GROUP BY s.diff_id, s.file_no, s.path, s.language"""
# New versions: filler up to the hunk's start, then every line that is not removed.
CONTENTS = """SELECT doc_id AS diff_id, path, array_to_string(list_concat(list_transform(range(CASE WHEN doc_id % 5 = 1 THEN 0 ELSE doc_id % 9 END), lambda i: '# filler'),
 list_transform(list_filter(body, lambda l: NOT starts_with(l, '-')), lambda l: substr(l, 2))), chr(10)) AS content FROM marked"""
WHOLE = """SELECT s.diff_id || chr(9) || s.file_no || chr(9) || s.path AS path, s.language, c.content FROM sk s JOIN contents c ON c.diff_id = s.diff_id AND c.path = s.path WHERE s.skip IS NULL"""


def _gate_over(select: str) -> list[str]:
    return [f"files AS MATERIALIZED ({select})", *OS.gate_ctes()[:-1]]


UNTAG = "split_part(d.path, chr(9), 1)::BIGINT AS diff_id, split_part(d.path, chr(9), 2)::INTEGER AS file_no, split_part(d.path, chr(9), 3) AS path"


def _chain(*ctes: str) -> str:
    base = files_cte().replace("files AS MATERIALIZED", "source_files AS MATERIALIZED", 1)
    diffs = diffs_cte().replace("\nFROM files)", "\nFROM source_files)", 1)
    return "WITH " + ",\n".join([base, diffs, DIFF_CTE, *ctes]) + "\n"


# Files of changes whose new version is at hand are scanned whole, the others as fragments.
AT_HAND = "s.diff_id % 3 <> 2"
BOTH = f"""SELECT path, language, content FROM ({WHOLE} AND {AT_HAND}) UNION ALL SELECT path, language, content FROM ({FRAGMENTS.replace("WHERE s.skip IS NULL", f"WHERE s.skip IS NULL AND NOT EXISTS (SELECT 1 FROM contents c WHERE c.diff_id = s.diff_id AND c.path = s.path AND {AT_HAND})")})"""


def review_ctes(mode: str = "warning") -> list[str]:
    return [f"contents AS MATERIALIZED ({CONTENTS})", *_gate_over(BOTH),
            f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY diff_id, file_no ORDER BY line_no) AS rk FROM added),
whole AS MATERIALIZED (SELECT s.diff_id, s.file_no FROM sk s JOIN contents c ON c.diff_id = s.diff_id AND c.path = s.path WHERE s.skip IS NULL AND {AT_HAND}),
raw_rows AS MATERIALIZED (SELECT f.*, w.diff_id IS NOT NULL AS is_full FROM (SELECT {UNTAG}, d.line_no, d.class, d.finding, d.severity, d.source, d.cwe FROM deduped d) f LEFT JOIN whole w ON w.diff_id = f.diff_id AND w.file_no = f.file_no),
hunk_rows AS MATERIALIZED (SELECT f.diff_id, f.file_no, f.path, a.line_no, f.class, f.finding, f.severity, f.source, f.cwe FROM raw_rows f
 JOIN ranked a ON a.diff_id = f.diff_id AND a.file_no = f.file_no AND ((f.is_full AND a.line_no = f.line_no) OR (NOT f.is_full AND a.rk = f.line_no))),
old_rows AS MATERIALIZED (SELECT f.* FROM raw_rows f WHERE is_full AND NOT EXISTS (SELECT 1 FROM added a WHERE a.diff_id = f.diff_id AND a.file_no = f.file_no AND a.line_no = f.line_no))""",
            f"""policy_rows AS (SELECT diff_id, file_no, path, first_line AS line_no, {q(G.TESTING_CLASS)} AS class, n_added || ' added line(s) outside tests, and the change touches no test file' AS finding,
 {q(mode)} AS severity, {q(G.SOURCE_POLICY)} AS source, NULL::VARCHAR AS cwe FROM sk WHERE skip IS NULL AND NOT is_test AND n_added >= 5
 AND diff_id NOT IN (SELECT diff_id FROM sk WHERE is_test AND n_added > 0))""",
            "finds AS MATERIALIZED (SELECT * FROM hunk_rows UNION ALL SELECT * FROM policy_rows)",
            """fv AS MATERIALIZED (SELECT s.diff_id, s.file_no, s.path, coalesce('skipped-' || s.skip, CASE WHEN h.diff_id IS NOT NULL THEN 'full' ELSE 'hunk' END) AS mode, coalesce(v, 0) AS violations, coalesce(w, 0) AS warnings,
 coalesce(ov, 0) AS old_violations, coalesce(ow, 0) AS old_warnings, CASE WHEN coalesce(v, 0) > 0 THEN 'FAIL' WHEN coalesce(w, 0) > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM sk s
 LEFT JOIN whole h ON h.diff_id = s.diff_id AND h.file_no = s.file_no LEFT JOIN (
 SELECT diff_id, file_no, count(*) FILTER (severity = 'violation') AS v, count(*) FILTER (severity <> 'violation') AS w FROM finds GROUP BY 1, 2) x ON x.diff_id = s.diff_id AND x.file_no = s.file_no LEFT JOIN (
 SELECT diff_id, file_no, count(*) FILTER (severity = 'violation') AS ov, count(*) FILTER (severity <> 'violation') AS ow FROM old_rows GROUP BY 1, 2) o ON o.diff_id = s.diff_id AND o.file_no = s.file_no)""",
            """tot AS MATERIALIZED (SELECT *, CASE WHEN violations > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM (
 SELECT diff_id, sum(violations)::BIGINT AS violations, sum(warnings)::BIGINT AS warnings, count(*) FILTER (mode IN ('hunk', 'full')) AS files_reviewed, count(*) FILTER (mode NOT IN ('hunk', 'full')) AS files_skipped,
 count(*) FILTER (mode IN ('hunk', 'full') AND verdict = 'FAIL') AS files_failed, sum(old_violations)::BIGINT AS pre_existing_violations, sum(old_warnings)::BIGINT AS pre_existing_warnings FROM fv GROUP BY diff_id))"""]


SUMMARY = """CASE verdict WHEN 'FAIL' THEN violations || ' violation(s) among the added lines of ' || files_failed || ' file(s): finish these places before the change is merged.'
 WHEN 'REVIEW' THEN 'nothing must be changed, but look at ' || warnings || ' doubtful line(s) of this change.'
 ELSE 'the rules found nothing on the lines of this change; they do not replace tests and a reader.' END"""
esc = lambda x: f"replace(replace(replace({x}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"
prop = lambda x: f"replace(replace({esc(x)}, ':', '%3A'), ',', '%2C')"
LEVEL = "CASE severity WHEN 'violation' THEN 'error' ELSE 'warning' END"
MESSAGE = "finding || ' [' || source || ']'"
RULE_ID = "'gate.' || trim(regexp_replace(lower(class), '[^a-z0-9]+', '-', 'g'), '-')"
BODY = "'**' || upper(severity) || '** - ' || class || chr(10) || chr(10) || finding || chr(10) || chr(10) || '`engine: ' || source || '`'"


def _json(*pairs: tuple[str, str]) -> str:
    """SQL that writes an object."""
    return "'{' || " + " || ',' || ".join(f"'\"{name}\":' || {value}" for name, value in pairs) + " || '}'"


_text = lambda x: f"to_json({x})::VARCHAR"
REGION = _json(("artifactLocation", _json(("uri", _text("path")))), ("region", _json(("startLine", "greatest(line_no, 1)"))))
LOCATIONS = "'[' || " + _json(("physicalLocation", REGION)) + " || ']'"
PROPERTIES = "'{\"class\":' || " + _text("class") + " || ',\"source\":' || " + _text("source") + " || CASE WHEN cwe IS NULL THEN '' ELSE ',\"cwe\":' || " + _text("cwe") + " END || '}'"
RESULT = _json(("ruleId", _text(RULE_ID)), ("level", _text(LEVEL)), ("message", _json(("text", _text(MESSAGE)))), ("locations", LOCATIONS), ("properties", PROPERTIES))
INDEXED = _json(("ruleId", _text(RULE_ID)), ("ruleIndex", "rule_index"), ("level", _text(LEVEL)), ("message", _json(("text", _text(MESSAGE)))), ("locations", LOCATIONS), ("properties", PROPERTIES))
RULE = "'{\"id\":' || " + _text("rule_id") + " || ',\"name\":' || " + _text("class") + " || ',\"shortDescription\":{\"text\":' || " + _text("class") + " || '},\"properties\":{\"tags\":[\"codesieve\"' || coalesce(tags, '') || ']}}'"
DOCUMENT = f"""SELECT t.diff_id, '{{"$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"codesieve","version":"1.0","rules":['
 || coalesce(rules, '') || ']}}}},"results":[' || coalesce(results, '') || ']}}]}}' AS document FROM tot t
LEFT JOIN (SELECT diff_id, string_agg({RULE}, ',' ORDER BY rule_id) AS rules FROM ids GROUP BY diff_id) r ON r.diff_id = t.diff_id
LEFT JOIN (SELECT f.diff_id, string_agg({INDEXED}, ',' ORDER BY file_no, line_no, f.class, finding) AS results FROM finds f JOIN (SELECT diff_id AS d, class AS c, rule_index FROM ids) ON d = f.diff_id AND c = f.class GROUP BY f.diff_id) x ON x.diff_id = t.diff_id"""
IDS = f"""ids AS MATERIALIZED (SELECT diff_id, class, rule_id, row_number() OVER (PARTITION BY diff_id ORDER BY rule_id) - 1 AS rule_index, tags FROM (
 SELECT diff_id, class, {RULE_ID} AS rule_id, string_agg(DISTINCT ',"' || cwe || '"', '' ORDER BY ',"' || cwe || '"') AS tags FROM finds GROUP BY diff_id, class))"""


def sql() -> dict[str, str]:
    full = _chain(f"contents AS MATERIALIZED ({CONTENTS})", *_gate_over(WHOLE))
    review = _chain(*review_ctes())
    hunks = _chain(*_gate_over(FRAGMENTS), f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY diff_id, file_no ORDER BY line_no) AS rk FROM added),
hunk_rows AS MATERIALIZED (SELECT f.diff_id, f.file_no, f.path, a.line_no, f.class, f.finding, f.severity FROM (
 SELECT {UNTAG}, d.line_no, d.class, d.finding, d.severity FROM deduped d) f JOIN ranked a ON a.diff_id = f.diff_id AND a.file_no = f.file_no AND a.rk = f.line_no)""")
    strict = _chain(*review_ctes("violation"))
    return {
        "parse_diff": _chain() + "SELECT a.diff_id, f.path, a.line_no::INTEGER AS line_no, a.text FROM added a JOIN fd f ON f.diff_id = a.diff_id AND f.file_no = a.file_no",
        "diff_files": _chain() + "SELECT diff_id, file_no::INTEGER AS file_no, path, old_path, status, is_binary, n_added::INTEGER AS n_added FROM rv",
        "skip_reason": _chain() + "SELECT diff_id, path, language, skip FROM sk",
        "map_fragment_lines": hunks + "SELECT diff_id, path, line_no::INTEGER AS line_no, class, finding, severity FROM hunk_rows",
        "coverage_policy": review + "SELECT diff_id, path, line_no::INTEGER AS line_no, class, finding, severity FROM policy_rows",
        "file_verdicts": strict + "SELECT diff_id, file_no::INTEGER AS file_no, path, mode, violations, warnings, old_violations, old_warnings, verdict FROM fv",
        "engines_used": review + """SELECT s.diff_id, CASE WHEN bool_or(s.skip IS NULL) THEN 'stubs,prose,structure' ELSE '' END || CASE WHEN bool_or(s.skip IS NULL AND lower(s.language) IN ('python', 'py', 'python3')) THEN ',python' ELSE '' END AS engines
 FROM sk s GROUP BY s.diff_id""",
        "review_totals": review + "SELECT * FROM tot",
        "attribute_findings": full + f"""SELECT diff_id, path, count(*) FILTER (hit) AS attributed, count(*) FILTER (NOT hit AND severity = 'violation') AS old_violations, count(*) FILTER (NOT hit AND severity <> 'violation') AS old_warnings FROM (
 SELECT f.*, a.line_no IS NOT NULL AS hit FROM (SELECT {UNTAG}, d.line_no, d.severity FROM deduped d) f LEFT JOIN added a ON a.diff_id = f.diff_id AND a.file_no = f.file_no AND a.line_no = f.line_no) GROUP BY 1, 2""",
        "report_annotations": review + f"""SELECT diff_id, '::' || {LEVEL} || ' file=' || {prop('path')} || ',line=' || line_no || ',title=' || {prop('class')} || '::' || {esc(MESSAGE)} AS command FROM finds
UNION ALL SELECT diff_id, '::notice title=codesieve::verdict=' || verdict || ' ' || {esc(SUMMARY)} FROM tot""",
        "sarif_results": review + f"SELECT diff_id, path, {RULE_ID} AS rule_id, {LEVEL} AS level, {MESSAGE} AS message, greatest(line_no, 1)::INTEGER AS start_line, cwe, {RESULT} AS result FROM finds",
        "sarif_document": _chain(*review_ctes(), IDS) + DOCUMENT,
        "sarif_rules": review + f"""SELECT rule_id, name, tags, (row_number() OVER (ORDER BY rule_id) - 1)::INTEGER AS rule_index FROM (SELECT {RULE_ID} AS rule_id, class AS name, coalesce(array_to_string(list_sort(list(DISTINCT cwe) FILTER (cwe IS NOT NULL)), ','), '') AS tags FROM finds GROUP BY class)""",
        "review_payload": review + f"""SELECT t.diff_id, CASE verdict WHEN 'FAIL' THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event, coalesce(i, 0) AS inline, coalesce(o, 0) AS overflow, digest AS comments_digest FROM tot t LEFT JOIN (
 SELECT diff_id, count(*) FILTER (n <= 50) AS i, count(*) FILTER (n > 50) AS o, md5(string_agg(b, chr(10) ORDER BY n) FILTER (n <= 50)) AS digest FROM (
  SELECT diff_id, {BODY} AS b, row_number() OVER (PARTITION BY diff_id ORDER BY file_no, line_no, class, finding) AS n FROM finds) GROUP BY diff_id) c ON c.diff_id = t.diff_id""",
        "report_text": review + f"""SELECT t.diff_id, 'verdict: ' || verdict || chr(10) || {SUMMARY} || chr(10) || chr(10) || coalesce(body || chr(10), '') || chr(10) || 'files reviewed=' || files_reviewed || ' skipped=' || files_skipped || ' violations=' || violations || ' warnings=' || warnings || ' pre-existing=' || pre_existing_violations || 'v/' || pre_existing_warnings || 'w' AS report
FROM tot t LEFT JOIN (SELECT diff_id, string_agg(r, chr(10) ORDER BY file_no, line_no, class, finding) AS body FROM (
 SELECT diff_id, file_no, 0 AS line_no, '' AS class, '' AS finding, path || ' [' || mode || '] -> ' || verdict AS r FROM fv WHERE mode IN ('hunk', 'full')
 UNION ALL SELECT diff_id, file_no, line_no, class, finding, '  ' || path || ':' || line_no || ' ' || upper(severity) || ' ' || class || ': ' || finding || ' (' || source || ')' FROM finds) GROUP BY diff_id) b ON b.diff_id = t.diff_id""",
    }
