"""SQL twins of the stub rules and the gate."""

from __future__ import annotations

from codesieve.operators import stubs as stub_ops
from codesieve.plans.oracle import rules as R
from codesieve.plans.oracle.sources import q, strip, with_files
from codesieve.rulebook import gate as G
from codesieve.rulebook import stubs as S

TRIPLE_DOC = r"\x02[^\x02]*?(?:TODO|FIXME|placeholder|not implemented)[^\x02]*?\x02"
EMPTY_CATCH = (r"catch\s*(?:\([^)]*\))?\s*\{[\s\n]*"
               r"(?:/\*[^*]{0,120}(?:\*+[^*/][^*]{0,120}){0,6}\*+/|//[^\n]*)?[\s\n]*\}")


def text_matches(pattern: str, flags: str, facts: str, text: str = "content", where: str = "true",
                 keep: str = "path, language, content") -> str:
    """One row per match with its line, from pieces between match starts."""
    marked = f"regexp_replace({text}, {R.pattern(pattern, flags)}, chr(1) || '\\0', 'g')"
    return f"""SELECT * FROM (SELECT *, 1 + coalesce(sum(nl) OVER (PARTITION BY path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no,
  {facts} FROM (SELECT *, len(piece) - len(replace(piece, chr(10), '')) AS nl FROM (
  SELECT {keep}, unnest(string_split({marked}, chr(1))) AS piece, generate_subscripts(string_split({marked}, chr(1)), 1) AS ord
  FROM files WHERE contains({marked}, chr(1))))) WHERE ord > 1 AND {where}"""


def stub_select(families=S.FAMILIES) -> str:
    parts = []
    for family in families:
        for rule in family:
            facts = (f"{q(stub_ops.pattern_type(family, rule))} AS pattern_type, {q(rule.severity)} AS severity, "
                     f"{rule.confidence}::DOUBLE AS confidence, {q(stub_ops.description(family, rule))} AS description, "
                     f"{q(family.facts['suggestion'])} AS suggestion")
            pattern, text, where = rule.pattern, "content", "true"
            if rule.name == "docstring_todo":
                pattern = TRIPLE_DOC
                text = f"replace(replace(content, {q(chr(34) * 3)}, chr(2)), {q(chr(39) * 3)}, chr(2))"
            if family is S.PASSTHROUGH:
                pattern = pattern.replace(r"\1", r"(\w+)")
                anchored = R.pattern("^" + pattern, family.flags)
                where = f"regexp_extract(piece, {anchored}, 1) = regexp_extract(piece, {anchored}, 2)"
            if family is S.MOCK_NAME:
                where = "NOT contains(left(lower(content), 100), 'test')"
            parts.append("SELECT path, line_no::INTEGER AS line_no, pattern_type, severity, confidence, description, suggestion FROM ("
                         + text_matches(pattern, family.flags, facts, text, where) + ")")
    return "\nUNION ALL\n".join(parts)


LITERAL = "\"(?:\\\\[\\s\\S]|[^\"\\\\\\n])*(?:\"|\\\\$)?|'(?:\\\\[\\s\\S]|[^'\\\\\\n])*(?:'|\\\\$)?|`(?:\\\\[\\s\\S]|[^`\\\\])*(?:`|\\\\$)?"

# Quoted literals as character spans, from pieces between literal starts.
SPANS_CTE = f"""spans AS MATERIALIZED (
SELECT path, start_at, start_at + len(regexp_extract(piece, {q('^(?:' + LITERAL + ')')}, 0)) AS end_at FROM (
 SELECT path, ord, piece, coalesce(sum(len(piece)) OVER (PARTITION BY path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM (
  SELECT path, unnest(string_split(regexp_replace(content, {q(LITERAL)}, chr(1) || '\\0', 'g'), chr(1))) AS piece,
   generate_subscripts(string_split(regexp_replace(content, {q(LITERAL)}, chr(1) || '\\0', 'g'), chr(1)), 1) AS ord FROM files)) WHERE ord > 1)"""


def prose_select() -> str:
    parts = []
    for kind, flags, severity, cwe, number, message, pattern in G.PROSE_RULES:
        facts = (f"{q(G.CLASSES[number])} AS class, {q(message)} AS finding, {q(severity)} AS severity, {q(cwe)} AS cwe, "
                 "coalesce(sum(len(piece)) OVER (PARTITION BY path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_char")
        inner = text_matches(pattern, flags, facts)
        parts.append(f"""SELECT m.path, m.line_no::INTEGER AS line_no, m.class, m.finding, m.severity, m.cwe FROM ({inner}) m
 WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.path = m.path AND s.start_at <= m.at_char AND m.at_char < s.end_at)""")
    return "\nUNION ALL\n".join(parts)


def structural_select() -> str:
    parts = []
    for kind, flags, severity, cwe, number, message, pattern in G.STRUCTURAL_RULES:
        if "catch" in pattern:
            pattern = EMPTY_CATCH
        facts = f"{q(G.CLASSES[number])} AS class, {q(message)} AS finding, {q(severity)} AS severity, {q(cwe)} AS cwe"
        parts.append(f"SELECT path, line_no::INTEGER AS line_no, class, finding, severity, cwe FROM ({text_matches(pattern, flags, facts)})")
    return "\nUNION ALL\n".join(parts)


def class_case(kind: str = "pattern_type") -> str:
    whens = " ".join(f"WHEN starts_with({kind}, {q(p)}) THEN {q(G.CLASSES[n])}" for p, n in G.CLASS_BY_PREFIX)
    return f"CASE {whens} ELSE {q(G.CLASSES[G.DEFAULT_CLASS])} END"


def cwe_case(kind: str = "pattern_type") -> str:
    return "CASE " + " ".join(f"WHEN starts_with({kind}, {q(p)}) THEN {q(c)}" for p, c in G.CWE_BY_PREFIX) + " END"


SEVERITY_CASE = ("CASE WHEN severity IN ('CRITICAL', 'HIGH') OR (severity = 'MEDIUM' AND confidence >= 0.85) "
                 "THEN 'violation' ELSE 'warning' END")


def adapter_select() -> str:
    return f"""SELECT path, line_no, {class_case()} AS class, description AS finding, {SEVERITY_CASE} AS severity,
 {q(G.SOURCE_STUBS)} AS source, round(confidence, 2) AS confidence, suggestion, {cwe_case()} AS cwe FROM stub_rows"""


def gate_ctes() -> tuple[str, ...]:
    return (f"stub_rows AS MATERIALIZED ({stub_select()})", SPANS_CTE,
            f"prose_rows AS MATERIALIZED ({prose_select()})", f"structure_rows AS MATERIALIZED ({structural_select()})",
            f"""united AS ({adapter_select()}
UNION ALL SELECT path, line_no, class, finding, severity, {q(G.SOURCE_PROSE)}, NULL, NULL, cwe FROM prose_rows
UNION ALL SELECT path, line_no, class, finding, severity, {q(G.SOURCE_PROSE)}, NULL, NULL, cwe FROM structure_rows)""",
            """deduped AS MATERIALIZED (
SELECT path, line_no, class, finding, severity, source, confidence, suggestion, cwe FROM (
 SELECT *, row_number() OVER (PARTITION BY path, line_no, class, finding ORDER BY (severity <> 'violation'), source, confidence) AS rn FROM united) WHERE rn = 1)""",
            """verdict_rows AS (
SELECT path, violations, warnings, CASE WHEN violations > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM (
 SELECT f.path, count(*) FILTER (d.severity = 'violation') AS violations, count(*) FILTER (d.severity = 'warning') AS warnings
 FROM files f LEFT JOIN deduped d ON d.path = f.path GROUP BY f.path))""")


def sql() -> dict[str, str]:
    out = {f"mock_{key}": with_files(stub_select((family,))) for key, family in STUB_KEYS.items()}
    out["stub_types"] = with_files(f"""SELECT pattern_type, {class_case()} AS class, {cwe_case()} AS cwe, count(*) AS n
FROM ({stub_select()}) GROUP BY 1, 2, 3""")
    out["gate_adapter"] = with_files(adapter_select(), f"stub_rows AS ({stub_select()})")
    out["prose_rules"] = with_files(prose_select(), SPANS_CTE)
    out["structural_rules"] = with_files(structural_select())
    out["dedupe_findings"] = with_files("SELECT * FROM deduped", *gate_ctes())
    out["scan_verdict"] = with_files("SELECT * FROM verdict_rows", *gate_ctes())
    out["class_by_prefix"] = out.pop("stub_types")
    return out


STUB_KEYS = {"placeholder": S.PLACEHOLDER, "stub": S.STUB, "success": S.ALWAYS_SUCCESS, "print": S.PRINT_ONLY,
             "fake": S.FAKE_DATA, "passthrough": S.PASSTHROUGH, "todo": S.TODO, "names": S.MOCK_NAME}
__all__ = ["sql", "STUB_KEYS", "strip"]
