"""SQL twins of the token spans and of the gate that knows them, on relations in place of arrays."""

from __future__ import annotations

from codesieve.plans.oracle import gate as OG
from codesieve.plans.oracle.sources import arr, files_cte, q
from codesieve.rulebook import gate as G
from codesieve.sources import python_texts as T


def _three(quote: str) -> str:
    body = f"{quote}{{3}}(?:{quote}{{0,2}}(?:[^{quote}\\\\]|\\\\[\\s\\S]))*"
    return f"{body}{quote}{{3}}|{body}{quote}{{0,2}}\\\\?\\z"


def _one(quote: str) -> str:
    return f"{quote}(?:\\\\[\\s\\S]|[^{quote}\\\\\\n])*{quote}?"


TOKEN = "|".join(["#[^\\n]*", _three('"'), _three("'"), _one('"'), _one("'")])
PARENS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
HEAD = (r"(?m)(\A[ \t\n\f\x02]*|^[ \t]*(?:async[ \t]+)?(?:def|class)\b(?:[^\n():]|:[ \t]*[^ \t\n\x02\x03():]|:[ \t]*" + PARENS + "|" + PARENS
        + r")*:[ \t\n\x02]*)\x03")


def python_files_cte() -> str:
    pick = f"(doc_id * 7 + (i - 1) * 13 + doc_id // 10) % {len(T.SNIPPETS)} + 1"
    snippet = f"replace(replace({arr(T.SNIPPETS)}[{pick}], '{{n}}', (doc_id % 97)::VARCHAR), '{{j}}', (i - 1)::VARCHAR)"
    return f"""files AS MATERIALIZED (SELECT doc_id, 'lib/t' || doc_id || '.py' AS path,
 CASE doc_id % 8 WHEN 5 THEN 'javascript' WHEN 6 THEN NULL WHEN 7 THEN ' Python ' ELSE 'python' END AS language,
 CASE WHEN doc_id % 3 = 0 THEN replace({q(T.OPENING)}, '{{n}}', (doc_id % 97)::VARCHAR) ELSE '' END || array_to_string(list_transform(
  list_concat(string_split(text, chr(10)), list_transform(range(doc_id % 6 + 3), lambda z: 'end')), lambda l, i: '# ' || l || chr(10) || {snippet}), chr(10)) AS content FROM documents)"""


IS_PYTHON = f"""CASE WHEN trim(language) <> '' THEN lower(trim(language)) IN ('python', 'py', 'python3')
 ELSE regexp_matches(content, {q('(?m)^[ \\t]*(?:def|class|import|from)[ \\t]+[0-9A-Za-z_]')}) AND NOT regexp_matches(content, {q('(?m)[;{}][ \\t]*$')}) END"""

SPAN_CTES = [
    f"pyf AS MATERIALIZED (SELECT path, coalesce({IS_PYTHON}, false) AS py FROM files)",
    f"""cuts AS (SELECT path, unnest(string_split(regexp_replace(content, {q(TOKEN)}, chr(1) || '\\0', 'g'), chr(1))) AS piece,
 generate_subscripts(string_split(regexp_replace(content, {q(TOKEN)}, chr(1) || '\\0', 'g'), chr(1)), 1) AS ord FROM files)""",
    f"""toks AS MATERIALIZED (SELECT path, ord, piece, CASE WHEN ord > 1 THEN regexp_extract(piece, {q('^(?:' + TOKEN + ')')}, 0) ELSE '' END AS tok,
 coalesce(sum(len(piece)) OVER w, 0) AS start_at, 1 + coalesce(sum(len(piece) - len(replace(piece, chr(10), ''))) OVER w, 0) AS line_at FROM cuts
 WINDOW w AS (PARTITION BY path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    f"""told AS (SELECT path, regexp_replace(regexp_replace(string_agg(CASE WHEN ord = 1 THEN piece WHEN starts_with(tok, '#') THEN chr(2) || substr(piece, len(tok) + 1)
 ELSE chr(3) || substr(piece, len(tok) + 1) END, '' ORDER BY ord), {q(HEAD)}, '\\1' || chr(4), 'g'), '[^\\x02-\\x04]', '', 'g') AS signs FROM toks GROUP BY path)""",
    """pyspans AS MATERIALIZED (SELECT t.path, start_at::INTEGER AS start, (start_at + len(tok))::INTEGER AS stop, line_at::INTEGER AS first_line,
 (line_at + len(tok) - len(replace(tok, chr(10), '')))::INTEGER AS last_line, CASE substr(signs, (ord - 1)::INTEGER, 1) WHEN chr(2) THEN 'comment' WHEN chr(3) THEN 'string' ELSE 'docstring' END AS kind, tok
 FROM toks t JOIN told s ON s.path = t.path WHERE ord > 1)""",
]


def typed_select() -> str:
    kind, flags, severity, cwe, number, message, pattern = G.TYPED_EXCEPT
    facts = f"{q(G.CLASSES[number])} AS class, {q(message)} AS finding, {q(severity)} AS severity, {q(cwe)} AS cwe"
    inner = OG.text_matches(pattern, flags, facts)
    said = lambda n: f"coalesce(regexp_matches(string_split(m.content, chr(10))[({n})::BIGINT], '#[ \\t]*[^ \\t]'), false)"
    return f"""SELECT m.path, m.line_no::INTEGER AS line_no, m.class, m.finding, m.severity, m.cwe FROM ({inner}) m JOIN pyf ON pyf.path = m.path AND py
 WHERE NOT {said('m.line_no')} AND NOT {said('m.line_no + 1')}"""


def prose_select() -> str:
    plain = "NOT EXISTS (SELECT 1 FROM spans s WHERE s.path = m.path AND s.start_at <= m.at_char AND m.at_char < s.end_at)"
    ours = f"""(CASE WHEN pyf.py THEN NOT EXISTS (SELECT 1 FROM pyspans s WHERE s.path = m.path AND s.kind = 'string' AND s.start <= m.at_char AND m.at_char < s.stop)
 ELSE {plain} END)"""
    return OG.prose_select().replace(") m\n", ") m JOIN pyf ON pyf.path = m.path\n").replace(plain, ours)


def stub_select() -> str:
    trigger = q("(?i)" + G.DOCSTRING_TRIGGER)
    return f"""SELECT r.* FROM ({OG.stub_select()}) r JOIN pyf ON pyf.path = r.path WHERE NOT (py AND pattern_type = {q(G.DOCSTRING_RULE)} AND NOT EXISTS (
 SELECT 1 FROM pyspans s WHERE s.path = r.path AND s.kind = 'docstring' AND regexp_matches(s.tok, {trigger}) AND r.line_no BETWEEN s.first_line AND s.last_line))"""


def gate_ctes() -> list[str]:
    plain = OG.gate_ctes()
    return [*SPAN_CTES, f"stub_rows AS MATERIALIZED ({stub_select()})", OG.SPANS_CTE, f"prose_rows AS MATERIALIZED ({prose_select()})", plain[3],
            f"typed_rows AS MATERIALIZED ({typed_select()})",
            plain[4][:-1] + f"\nUNION ALL SELECT path, line_no, class, finding, severity, {q(G.SOURCE_PROSE)}, NULL, NULL, cwe FROM typed_rows)", *plain[5:]]


_fails = lambda rows, test: f"EXISTS (SELECT 1 FROM {rows} r WHERE r.path = f.path AND {test})"
BENCHMARK = f"""SELECT engines, count(*) AS n_files, count(*) FILTER (expected AND hit) AS caught, count(*) FILTER (expected AND NOT hit) AS missed, count(*) FILTER (NOT expected AND hit) AS false_alarms,
 count(*) FILTER (NOT expected AND NOT hit) AS passed, round(100 * count(*) FILTER (expected = hit) / count(*), 6) AS correct_pct FROM (
 SELECT array_to_string(list_filter([CASE WHEN i & 1 > 0 THEN 'stubs' END, CASE WHEN i & 2 > 0 THEN 'prose' END, CASE WHEN i & 4 > 0 THEN 'structure' END, CASE WHEN i & 8 > 0 THEN 'python' END], lambda x: x IS NOT NULL), ',') AS engines,
  quality = 0 AS expected, (i & 1 > 0 AND e1) OR (i & 2 > 0 AND e2) OR (i & 4 > 0 AND e3) AS hit FROM range(1, 16) t(i), (
  SELECT quality, {_fails('(' + OG.adapter_select() + ')', "r.severity = 'violation'")} AS e1, {_fails('prose_rows', "r.severity = 'violation'")} AS e2, {_fails('structure_rows', "r.severity = 'violation'")} AS e3
  FROM files f JOIN labels l ON l.doc_id = f.doc_id WHERE quality IS NOT NULL)) GROUP BY engines"""


def sql() -> dict[str, str]:
    own = lambda body, *ctes: "WITH " + ",\n".join([python_files_cte(), *ctes]) + "\n" + body
    whole = lambda body: "WITH " + ",\n".join([files_cte(), *gate_ctes()]) + "\n" + body
    out = "SELECT DISTINCT path, line_no, class, finding, severity, {} AS source, cwe FROM ({})"
    documented = f"SELECT * FROM ({OG.adapter_select()}) WHERE path IN (SELECT path FROM files)"
    return {
        "string_spans": own("SELECT path, start, stop, first_line, last_line, kind FROM pyspans WHERE kind <> 'comment'", *SPAN_CTES),
        "python_or_not": own("SELECT path, py AS python FROM pyf", SPAN_CTES[0]),
        "suppress_in_strings": own(out.format(q(G.SOURCE_PROSE), prose_select()), *SPAN_CTES, OG.SPANS_CTE),
        "verify_docstrings": own(out.format(q(G.SOURCE_STUBS), documented),
                                 *SPAN_CTES, f"stub_rows AS MATERIALIZED (SELECT * FROM ({stub_select()}) WHERE pattern_type = {q(G.DOCSTRING_RULE)})"),
        "suppress_commented": own(out.format(q(G.SOURCE_PROSE), typed_select()), SPAN_CTES[0]),
        "rule_benchmark": whole(BENCHMARK),
        "gate_findings": whole("SELECT * FROM deduped"),
        "gate_verdicts": whole("SELECT * FROM verdict_rows"),
    }



