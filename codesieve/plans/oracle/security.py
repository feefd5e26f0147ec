"""SQL twins of the security families."""

from __future__ import annotations

from codesieve.plans.oracle import rules as R
from codesieve.plans.oracle.sources import LINES_CTE, with_lines
from codesieve.rulebook import security as S


def family_select(family) -> str:
    facts = family.facts
    where = [f"NOT {R.comment('security')}"]
    guard = None
    if facts.get("languages"):
        where.append("language IN (" + ", ".join(map(R.q, facts["languages"])) + ")")
    if family is S.INSECURE_RANDOM:
        where.append("(" + " OR ".join(f"contains(lower(line), {R.q(w)})" for w in S.RANDOM_CONTEXT_WORDS) + ")")
    if family is S.HARDCODED_SECRET:
        def guard(rule):
            matched = f"regexp_extract(line, {R.pattern(rule.pattern, 'i')}, 0)"
            value = f"lower(regexp_extract({matched}, {R.q('[' + chr(34) + chr(39) + ']([^' + chr(34) + chr(39) + ']+)[' + chr(34) + chr(39) + ']')}, 1))"
            return "NOT (" + " OR ".join(f"contains({value}, {R.q(w)})" for w in S.TEST_VALUE_WORDS) + ")"
    severity = R.severities(family) if family.rules[0].severity else R.q(facts["severity"])
    cvss = R.mapped(severity, facts["cvss_by_severity"]) if "cvss_by_severity" in facts else str(facts["cvss"])
    advice = R.q(facts["suggestion"])
    if "suggestion_by_rule" in facts:
        advice = R.mapped(R.names(family), facts["suggestion_by_rule"], facts["suggestion"])
    shown = R.context()
    if family is S.HARDCODED_SECRET:
        quoted = R.q("[" + chr(34) + chr(39) + "][^" + chr(34) + chr(39) + "]*[" + chr(34) + chr(39) + "]")
        shown = f"left(regexp_replace({R.strip('line')}, {quoted}, '***', 'g'), 50) || '...[REDACTED]'"
    return f"""SELECT path, line_no::INTEGER AS line_no, {R.q(family.name)} AS finding_type, {R.names(family)} AS rule,
  {severity} AS severity, {R.confidences(family)} AS confidence, {R.q(facts['cwe'])} AS cwe, {R.q(facts['owasp'])} AS owasp,
  ({cvss})::DOUBLE AS cvss, {shown} AS context, {advice} AS suggestion
FROM (SELECT *, {R.first_match(family, guard=guard)} AS i FROM lines WHERE {' AND '.join(where)}) WHERE i IS NOT NULL"""


def all_families(families=S.FAMILIES) -> str:
    return "\nUNION ALL\n".join(family_select(f) for f in families)


def sql() -> dict[str, str]:
    out = {f"sec_{f.name}": with_lines(family_select(f)) for f in S.FAMILIES}
    out["sec_all"] = with_lines(all_families())
    return out


__all__ = ["LINES_CTE", "all_families", "family_select", "sql"]
