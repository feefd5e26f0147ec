"""SQL twins of the derived sources, written for an independent engine."""

from __future__ import annotations

from codesieve.sources import templates as T


def q(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


STRIP_CHARS = "(chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12))"


def strip(x: str) -> str:
    return f"trim({x}, {STRIP_CHARS})"


def lstrip(x: str) -> str:
    return f"ltrim({x}, {STRIP_CHARS})"


def _woven(snippets, prefix) -> str:
    two = "lpad(((doc_id + i - 1) % 18 + 1)::VARCHAR, 2, '0')"
    pick = f"(doc_id * 7 + (i - 1) * 13 + doc_id // 10) % {len(snippets)} + 1"
    body = f"replace(replace(replace({arr(snippets)}[{pick}], '{{n}}', (doc_id % 97)::VARCHAR), '{{j}}', (i - 1)::VARCHAR), '{{k}}', {two})"
    return (f"array_to_string(list_transform(list_concat(string_split(text, chr(10)), "
            f"list_transform(range(doc_id % 6 + 3), lambda z: 'end')), "
            f"lambda l, i: {q(prefix)} || l || chr(10) || {body}), chr(10))")


def files_cte() -> str:
    cases, seen = [], []
    for index, slot in enumerate(T.SLOTS):
        if slot in seen:
            continue
        seen.append(slot)
        same = ", ".join(str(i) for i, s in enumerate(T.SLOTS) if s == slot)
        cases.append(f"WHEN doc_id % 10 IN ({same}) THEN {_woven(slot[1], slot[2])}")
    layer = f"{arr(T.LAYERS)}[(doc_id // 10) % {len(T.LAYERS)} + 1]"
    ext = f"{arr([T.EXTENSIONS.get(s[0], '') for s in T.SLOTS])}[doc_id % 10 + 1]"
    return f"""files AS MATERIALIZED (
SELECT doc_id,
  CASE WHEN doc_id % 10 = 8 THEN 'docs/d' || doc_id || '/' || {arr(T.DOC_NAMES)}[(doc_id // 10) % {len(T.DOC_NAMES)} + 1]
       WHEN doc_id % 10 = 9 THEN 'deploy/m' || doc_id || '/' || {arr(T.MANIFEST_NAMES)}[(doc_id // 10) % {len(T.MANIFEST_NAMES)} + 1]
       WHEN {layer} = 'tests' THEN 'tests/unit/test_f' || doc_id || {ext}
       ELSE 'src/' || {layer} || '/pkg' || (doc_id % 7) || '/f' || doc_id || {ext} END AS path,
  {arr([s[0] for s in T.SLOTS])}[doc_id % 10 + 1] AS language,
  CASE {' '.join(cases)} END AS content
FROM documents)"""


LINES_CTE = """lines AS MATERIALIZED (
SELECT path, language, unnest(string_split(content, chr(10))) AS line,
  generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files)"""


def with_files(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([files_cte(), *ctes]) + "\n" + body


def with_lines(body: str, *ctes: str) -> str:
    return with_files(body, LINES_CTE, *ctes)


def diffs_cte() -> str:
    return """marked AS (
SELECT *, CASE WHEN doc_id % 5 = 1 THEN list_transform(string_split(content, chr(10)), lambda l: '+' || l)
  ELSE list_transform(string_split(content, chr(10)), lambda l, i: [' ', '+', '-'][(doc_id + i - 1) % 3 + 1] || l) END AS body
FROM files),
diffs AS MATERIALIZED (
SELECT doc_id AS diff_id,
 CASE WHEN doc_id % 5 = 1 THEN 'diff --git a/' || path || ' b/' || path || chr(10) || 'new file mode 100644' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/' || path
   ELSE 'diff --git a/' || path || ' b/' || path || chr(10) || 'index 1111111..2222222 100644' || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path END
 || chr(10) || '@@ -' || s || ',' || len(list_filter(body, lambda l: NOT starts_with(l, '+'))) || ' +' || s || ',' || len(list_filter(body, lambda l: NOT starts_with(l, '-'))) || ' @@' || chr(10) || array_to_string(body, chr(10))
 || CASE WHEN doc_id % 4 = 0 THEN replace(replace('~diff --git a/tests/test_c#.py b/tests/test_c#.py~--- a/tests/test_c#.py~+++ b/tests/test_c#.py~@@ -4 +4,2 @@~     assert run()~+    assert done(#)', '#', doc_id::VARCHAR), '~', chr(10)) ELSE '' END
 || replace(replace(CASE doc_id % 3
   WHEN 0 THEN '~diff --git a/img/p#.png b/img/p#.png~new file mode 100644~Binary files /dev/null and b/img/p#.png differ'
   WHEN 1 THEN '~diff --git a/old/g#.py b/old/g#.py~deleted file mode 100644~--- a/old/g#.py~+++ /dev/null~@@ -1,2 +0,0 @@~-import os~--- not a header'
   ELSE '~diff --git a/lib/from#.js b/lib/to#.js~similarity index 90%~rename from lib/from#.js~rename to lib/to#.js~--- a/lib/from#.js~+++ b/lib/to#.js~@@ -7,2 +7,3 @@~ ctx();~+// add code here later~ tail();~\\ No newline at end of file' END,
   '#', doc_id::VARCHAR), '~', chr(10)) AS diff
FROM (SELECT *, CASE WHEN doc_id % 5 = 1 THEN 1 ELSE doc_id % 9 + 1 END AS s FROM marked))"""


FRAMES_CTE = """frames AS MATERIALIZED (
SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN '!' || frame WHEN event_id % 31 = 0 THEN '  ' ELSE frame END AS raw FROM (
SELECT event_id, '{"jsonrpc":"' || CASE WHEN event_id % 19 = 0 THEN '1.0' ELSE '2.0' END || '"' ||
  CASE WHEN event_id % 7 = 0 THEN '' ELSE ',"id":' || event_id END ||
  CASE WHEN event_id % 23 = 0 THEN '' WHEN event_id % 29 = 0 THEN ',"method":5' ELSE ',"method":"' ||
    CASE event_type WHEN 'view' THEN 'initialize' WHEN 'signup' THEN 'tools/list' WHEN 'click' THEN 'tools/call' WHEN 'purchase' THEN 'ping' ELSE 'no/such' END || '"' END ||
  ',"params":' || CASE WHEN event_type = 'view' THEN '{"protocolVersion":"' || ['2024-11-05', '2025-03-26', '1999-01-01'][event_id % 3 + 1] || '"}'
    WHEN event_type = 'click' THEN '{"name":"' || ['scan_code', 'get_corpus', 'nope', 'verify'][user_id % 4 + 1] || '","arguments":' ||
      CASE WHEN event_id % 13 = 0 THEN '"x"' ELSE props END || '}'
    WHEN event_id % 17 = 0 THEN '[1]' ELSE '{}' END || '}' AS frame FROM events))"""

POLICIES_CTE = """policies AS MATERIALIZED (
SELECT event_id AS config_id, CASE event_id % 9
  WHEN 0 THEN '{"exclude":["vendor/*"],"business_logic":' || props || '}'
  WHEN 1 THEN '{"min_test_trigger_lines":' || (event_id % 40) || ',"require_tests":"fail"}'
  WHEN 2 THEN '{"require_tests":"sometimes"}'
  WHEN 3 THEN '{"fail_on_review":true,"test_globs":["qa/*","k' || event_id || '*"]}'
  WHEN 4 THEN '{"min_test_trigger_lines":-' || (event_id % 40 + 1) || '}'
  WHEN 5 THEN props
  WHEN 6 THEN '{"exclude":[1,' || event_id || ']}'
  WHEN 7 THEN '[{' || event_id
  ELSE '{"fail_on_review":"yes"}' END AS raw FROM events)"""
