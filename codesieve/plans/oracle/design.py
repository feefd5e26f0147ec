"""SQL twins of antipattern, architecture, document and emoji operators."""

from __future__ import annotations

from codesieve.plans.oracle import rules as R
from codesieve.plans.oracle.gate import text_matches
from codesieve.plans.oracle.naming import ascii_words, names_in
from codesieve.plans.oracle.sources import arr, lstrip, q, strip, with_files, with_lines
from codesieve.rulebook import design as D
from codesieve.rulebook import emoji as E

BASE = "split_part(path, '/', -1)"
MANIFEST = f"{BASE} IN {names_in(D.DEPENDENCY_FILES)}"


def bleeding(name: str) -> str:
    return (f"CASE WHEN {name} IN {names_in(D.BLEEDING_CRITICAL)} THEN 'CRITICAL' WHEN {name} IN {names_in(D.BLEEDING_HIGH)} "
            "THEN 'HIGH' ELSE 'MEDIUM' END")


def first_of(family, where: str, severity: str, advice: dict, default: str) -> str:
    name = R.names(family)
    return f"""SELECT path, line_no::INTEGER AS line_no, {name} AS subcategory, {severity} AS severity, {R.confidences(family)} AS confidence,
 {R.context()} AS context, {R.mapped(name, advice, default)} AS suggestion FROM (SELECT *, {R.first_match(family)} AS i FROM lines WHERE {where}) WHERE i IS NOT NULL"""


VERSIONS = first_of(D.UNSTABLE_VERSIONS, f"{MANIFEST} AND NOT {R.prefixed(strip('line'), ('#', '//'))}",
                    bleeding(R.names(D.UNSTABLE_VERSIONS)), D.BLEEDING_SUGGESTIONS, D.BLEEDING_DEFAULT)
EXPERIMENTAL = first_of(D.EXPERIMENTAL_APIS, f"NOT {MANIFEST}", bleeding(R.names(D.EXPERIMENTAL_APIS)),
                        D.BLEEDING_SUGGESTIONS, D.BLEEDING_DEFAULT)
DOMAIN = first_of(D.DOMAIN_NUMBERS, f"NOT {R.comment('antipattern')}", "'MEDIUM'", D.DOMAIN_SUGGESTIONS,
                  "Extract magic number to named constant.")


def text_family(family, low=(), overrides=None) -> str:
    parts = []
    for rule in family:
        pattern, where = (overrides or {}).get(rule.name, (rule.pattern, "true"))
        facts = (f"{q(rule.name)} AS subcategory, {q('LOW' if rule.name in low else 'MEDIUM')} AS severity, "
                 f"{rule.confidence}::DOUBLE AS confidence, {q(D.GOLD_PLATING_SUGGESTIONS[rule.name])} AS suggestion")
        parts.append("SELECT path, line_no::INTEGER AS line_no, subcategory, severity, confidence, suggestion FROM ("
                     + text_matches(pattern, family.flags, facts, where=where) + ")")
    return "\nUNION ALL\n".join(parts)


DELEGATE = r"def\s+(\w+)\s*\(self,\s*\*args,\s*\*\*kwargs\)\s*:\s*\n\s*return\s+self\.\w+\.(\w+)\s*\(\*args"
ABSTRACTION = text_family(D.ABSTRACTION, overrides={"pass_through_delegation": (
    DELEGATE, f"regexp_extract(piece, {q('^' + DELEGATE)}, 1) = regexp_extract(piece, {q('^' + DELEGATE)}, 2)")}) + f"""
UNION ALL SELECT path, 1, 'pattern_overload', 'HIGH', least(0.85, 0.5 + n * 0.05)::DOUBLE, 'Consider if all these patterns are necessary. Simplify where possible.'
FROM (SELECT path, {R.count('content', D.PATTERN_KEYWORDS)} AS n FROM files) WHERE n > 5"""

# Without lookahead: a factory is single when no named implementation follows it.
OVER = text_family(D.OVER_ENGINEERING, overrides={
    "single_factory": (r"class\s+Abstract\w*Factory\b",
                       "NOT regexp_matches(rest, '(?s)^class\\s+Abstract\\w*Factory\\b.*(Concrete|Impl|Default)\\w*Factory')"),
    "single_strategy": (r"class\s+\w*Strategy\b.*\n", "true")})
OVER = OVER.replace("SELECT *, len(piece) - len(replace(piece, chr(10), '')) AS nl",
                    "SELECT *, len(piece) - len(replace(piece, chr(10), '')) AS nl, "
                    "string_agg(piece, '') OVER (PARTITION BY path ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest")

FLAGS = f"""SELECT path, d::INTEGER AS definitions, c::INTEGER AS checks FROM (SELECT path, {R.count('content', D.FLAG_DEFINITION, 'i')} AS d,
 {R.count('content', D.FLAG_CHECK, 'i')} AS c FROM files) WHERE d + c > 0"""
FLAG_OVERLOAD = f"""SELECT path, definitions, checks, CASE WHEN definitions + checks > 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 least(0.82, 0.5 + (definitions + checks) * 0.02)::DOUBLE AS confidence FROM ({FLAGS}) WHERE definitions + checks > 10"""


def anti_all() -> str:
    pick = lambda inner, kind, category: (f"SELECT path, line_no, {q(kind)} AS antipattern, {q(category)} AS category, subcategory, severity, confidence FROM ({inner})")
    flags = f"SELECT path, 1 AS line_no, 'feature_flag_overload' AS subcategory, severity, confidence FROM ({FLAG_OVERLOAD})"
    parts = [pick(VERSIONS, "bleeding_edge", "organizational"), pick(EXPERIMENTAL, "bleeding_edge", "organizational")]
    parts += [pick(x, "gold_plating", "design") for x in (OVER, DEAD, PREMATURE, ABSTRACTION, flags)]
    return "\nUNION ALL\n".join([*parts, pick(DOMAIN, "magic_numbers", "programming")])


DEAD = text_family(D.DEAD_CODE, ("commented_code",))
PREMATURE = text_family(D.PREMATURE_OPTIMIZATION, D.LOW_OPTIMIZATIONS)

# --- architecture -------------------------------------------------------------
CLASSES_CTE = f"""py AS (SELECT path, line_no, line, len(line) - len({lstrip('line')}) AS ind, {strip('line')} <> '' AS full_line,
 count(*) OVER (PARTITION BY path) AS n_lines FROM lines WHERE language = 'python'),
heads AS (SELECT path, line_no, line, n_lines, regexp_extract(line, {q(D.PYTHON_CLASS)}, 1) AS name, regexp_extract(line, {q(D.PYTHON_CLASS)}, 2) AS bases
 FROM py WHERE regexp_matches(line, {q(D.PYTHON_CLASS)})),
ends AS (SELECT h.*, coalesce((SELECT min(p.line_no) FROM py p WHERE p.path = h.path AND p.line_no > h.line_no AND p.full_line AND p.ind = 0), n_lines + 1) - 1 AS last_line FROM heads h),
class_rows AS MATERIALIZED (SELECT e.path, e.line_no, e.name, len(list_filter(list_transform(string_split(e.bases, ','), lambda b: {strip('b')}), lambda b: b <> '')) AS bases,
 e.last_line - e.line_no + 1 AS loc,
 (SELECT string_agg(p.line, chr(10) ORDER BY p.line_no) FROM py p WHERE p.path = e.path AND p.line_no BETWEEN e.line_no AND e.last_line) AS body FROM ends e),
class_m AS MATERIALIZED (SELECT path, line_no, name, {R.count('body', D.PYTHON_METHOD, 'm')} AS methods, {R.count('body', r'self\.(\w+)\s*=')} AS attributes, bases,
 len(list_distinct(list_filter(regexp_extract_all(body, '([\\p{{L}}\\p{{N}}_]+)\\s*\\(', 1), lambda w: regexp_matches(w, '^\\p{{Lu}}') AND w NOT IN ('True', 'False', 'None')))) AS dependencies, loc FROM class_rows)"""
CLASS_METRICS = """SELECT path, line_no::INTEGER AS line_no, name, methods::INTEGER AS methods, attributes::INTEGER AS attributes, bases::INTEGER AS bases,
 dependencies::INTEGER AS dependencies, loc::INTEGER AS loc FROM class_m"""


def god(methods: int, attributes: int, loc: int) -> str:
    return f"""SELECT path, line_no::INTEGER AS line_no, name, v::INTEGER AS violations, CASE WHEN v >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(least(0.92, c), 9)::DOUBLE AS confidence FROM (
 SELECT *, (methods > {methods})::INTEGER + (attributes > {attributes})::INTEGER + (loc > {loc})::INTEGER AS v,
  0.5 + 0.15 * (methods > {methods})::INTEGER + 0.1 * (attributes > {attributes})::INTEGER + 0.15 * (loc > {loc})::INTEGER AS c FROM class_m) WHERE v > 0"""


IMPORTS_CTE = f"""imps AS MATERIALIZED (
SELECT path, line_no, CASE WHEN m <> '' THEN m ELSE {strip(f"split_part(regexp_extract(line, {q(D.PYTHON_IMPORT)}, 2), ',', 1)")} END AS module FROM (
 SELECT *, regexp_extract(line, {q(D.PYTHON_IMPORT)}, 1) AS m FROM lines WHERE language = 'python' AND regexp_matches(line, {q(D.PYTHON_IMPORT)}))
UNION ALL SELECT path, line_no, unnest(regexp_extract_all(line, {q(D.SCRIPT_IMPORT)}, 1)) FROM lines WHERE language IN ('javascript', 'typescript'))"""


def coupling(imports: int, dependencies: int) -> str:
    return f"""SELECT path, 1 AS line_no, 'high_import_count' AS kind, count(*) AS n, 'MEDIUM' AS severity, 0.68::DOUBLE AS confidence FROM imps GROUP BY path HAVING count(*) > {imports}
UNION ALL SELECT path, line_no::INTEGER, 'tight_coupling', dependencies, 'HIGH', 0.75 FROM class_m WHERE dependencies > {dependencies}"""


SOLID = f"""SELECT path, line_no::INTEGER AS line_no, 'long_parameter_list' AS kind, name, n::INTEGER AS n, 0.7::DOUBLE AS confidence FROM (
 SELECT path, line_no, regexp_extract(line, {q(D.PYTHON_METHOD)}, 1) AS name, len(list_filter(list_transform(string_split(regexp_extract(line, {q(D.PYTHON_METHOD)}, 2), ','), lambda p: {strip('p')}), lambda p: p NOT IN ('', 'self'))) AS n
 FROM lines WHERE language = 'python' AND regexp_matches(line, {q(D.PYTHON_METHOD)})) WHERE n > 7
UNION ALL SELECT path, line_no::INTEGER, 'deep_inheritance', name, bases::INTEGER, 0.72 FROM class_m WHERE bases > 4"""

RANKS = "(VALUES " + ", ".join(f"({q(n)}, {r}, {i})" for i, (n, r) in enumerate(D.LAYER_RANKS.items())) + ") AS r(layer, rank, ord)"
LAYERS = f"""SELECT p.path, p.line_no::INTEGER AS line_no, p.layer, p.imported, 'HIGH' AS severity, 0.8::DOUBLE AS confidence FROM (
 SELECT path, line_no, module, (SELECT arg_min(layer, ord) FROM {RANKS} WHERE list_contains(string_split(lower(path), '/'), layer)) AS layer,
  (SELECT arg_min(layer, ord) FROM {RANKS} WHERE list_contains(string_split(lower(module), '.'), layer)) AS imported FROM imps) p
JOIN {RANKS.replace('AS r(', 'AS a(')} ON a.layer = p.layer JOIN {RANKS.replace('AS r(', 'AS b(')} ON b.layer = p.imported WHERE b.rank < a.rank"""
MISUSE = f"""SELECT path, 'unsafe_singleton' AS kind, 'MEDIUM' AS severity, 0.72::DOUBLE AS confidence FROM files WHERE language = 'python' AND contains(content, '_instance = None')
 AND NOT contains(lower(content), 'threading') AND NOT contains(content, 'Lock')
UNION ALL SELECT path, 'service_locator', 'MEDIUM', 0.65 FROM files WHERE {R.has('content', D.SERVICE_LOCATOR, 'i')}"""
CONCRETE = f"SELECT path, line_no::INTEGER AS line_no, module, 'LOW' AS severity, 0.6::DOUBLE AS confidence FROM imps WHERE {R.has('module', D.CONCRETE_MODULES)}"


def arch_all() -> str:
    return f"""SELECT path, line_no, 'god_class' AS kind, severity, confidence FROM ({god(15, 20, 500)})
UNION ALL SELECT path, line_no, kind, severity, confidence FROM ({coupling(20, 8)})
UNION ALL SELECT path, line_no, kind, 'MEDIUM', confidence FROM ({SOLID})
UNION ALL SELECT path, line_no, 'layer_violation', severity, confidence FROM ({LAYERS})
UNION ALL SELECT path, 1, kind, severity, confidence FROM ({MISUSE})
UNION ALL SELECT path, line_no, 'concrete_dependency', severity, confidence FROM ({CONCRETE})"""


# --- documents ---------------------------------------------------------------
DOC_CTE = f"""docs AS MATERIALIZED (SELECT path, content, CASE {' '.join(f"WHEN regexp_matches({BASE}, {q('(?i)' + r[3])}) THEN {i}" for i, r in enumerate(D.DEV_DOC_NAMES, 1))} END AS i
 FROM files WHERE lower(regexp_extract({BASE}, '^.+(\\.[^.]+)$', 1)) IN {names_in(D.DEV_DOC_SUFFIXES)} AND {BASE} NOT IN {names_in(D.STANDARD_FILES)}
 AND NOT ({' OR '.join(f"contains(path, {q(d)})" for d in D.STANDARD_DOC_DIRS)}) AND NOT list_has_any(string_split(path, '/'), {arr(D.IGNORED_DIRS)})),
doc_names AS (SELECT path, {arr([r[0] for r in D.DEV_DOC_NAMES])}[i] AS doc_type, {arr([r[1] for r in D.DEV_DOC_NAMES])}[i] AS severity, {arr([r[2] for r in D.DEV_DOC_NAMES])}[i] AS reason FROM docs WHERE i IS NOT NULL),
doc_scores AS (SELECT path, matched, round(CASE WHEN matched > 4 THEN least(1.0, least(1.0, top + 0.1) + 0.1) WHEN matched > 2 THEN least(1.0, top + 0.1) ELSE top END, 9)::DOUBLE AS score FROM (
 SELECT path, greatest({', '.join(f"CASE WHEN {R.has('content', r.pattern, 'im')} THEN {r.confidence} ELSE 0 END" for r in D.DEV_DOC_CONTENT)}) AS top,
  {' + '.join(f"{R.has('content', r.pattern, 'im')}::INTEGER" for r in D.DEV_DOC_CONTENT)} AS matched FROM docs WHERE i IS NULL)),
doc_issues AS MATERIALIZED (SELECT path, doc_type, severity, CASE severity WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence, reason FROM doc_names
UNION ALL SELECT path, 'dev_content', CASE WHEN score > 0.7 THEN 'MEDIUM' ELSE 'LOW' END, score, 'Content patterns suggest this is a development/planning document' FROM doc_scores WHERE score > 0.5)"""
IGNORE = f"""SELECT entry, min(path) AS first_path, count(*) AS n FROM (SELECT path, CASE WHEN doc_type LIKE 'implementation\\_%' ESCAPE '\\' THEN 'IMPLEMENTATION*.md'
 WHEN doc_type = 'architecture_doc' THEN 'ARCHITECTURE.md' WHEN doc_type IN ('quick_setup', 'dev_setup', 'local_setup') THEN '*SETUP*.md' WHEN doc_type = 'deep_dive' THEN '*DEEP_DIVE*.md'
 WHEN doc_type IN ('draft_doc', 'wip_doc') THEN '*DRAFT*.md' || chr(10) || '*WIP*.md' ELSE {BASE} END AS entry FROM doc_issues) GROUP BY entry"""

# --- emoji ----------------------------------------------------------------------
EMO = q(E.char_class())
EMOJI_CTE = f"""emo_pieces AS (SELECT path, language, line_no, line, unnest(string_split(m, chr(1))) AS piece, generate_subscripts(string_split(m, chr(1)), 1) AS ord FROM (
 SELECT *, regexp_replace(line, {EMO}, chr(1) || '\\0', 'g') AS m FROM lines WHERE regexp_matches(line, {EMO}))),
emo AS MATERIALIZED (SELECT path, language, line_no, line, len(before) AS col_no, before, emoji, 'U+' || lpad(upper(to_hex(ord(emoji))), greatest(4, len(to_hex(ord(emoji))))::INTEGER, '0') AS code_point,
 CASE WHEN {R.comment('emoji')} THEN 'comment'
  WHEN language = 'python' AND ((len(before) - len(replace(before, {q(chr(34) * 3)}, ''))) // 3 % 2 = 1 OR (len(before) - len(replace(before, {q(chr(39) * 3)}, ''))) // 3 % 2 = 1) THEN 'docstring'
  WHEN regexp_matches(regexp_replace(regexp_replace(before, '\\\\[\\s\\S]', '', 'g'), '"[^"]*"|''[^'']*''', '', 'g'), '["'']') THEN 'string'
  WHEN regexp_matches(before, 'f["''][^"'']*$') THEN 'string' ELSE 'code' END AS context,
 {R.mapped('emoji', {c: r[1] for c, r in E.WEIGHTED.items()}, 'other')} AS category,
 CASE WHEN emoji IN {names_in(E.WEIGHTED)} THEN {R.mapped('emoji', {c: r[2] for c, r in E.WEIGHTED.items()})} WHEN emoji IN {names_in(E.HUMAN)} THEN 0.3 ELSE 0.5 END AS score,
 emoji IN {names_in(E.WEIGHTED)} AS weighted, emoji IN {names_in(E.HUMAN)} AS human FROM (
 SELECT path, language, line_no, line, ord, left(piece, 1) AS emoji, string_agg(piece, '') OVER (PARTITION BY path, line_no ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM emo_pieces) WHERE ord > 1)"""
EMO_METRICS_CTE = """emo_lines AS (SELECT path, line_no, count(*) AS n FROM emo GROUP BY 1, 2),
emo_m AS MATERIALIZED (SELECT e.path, emojis, emoji_lines, clusters, weighted, human, score, in_comment, in_docstring, in_string, in_code, total_lines FROM (
 SELECT path, count(*) AS emojis, count(*) FILTER (weighted) AS weighted, count(*) FILTER (human) AS human, sum(score) AS score, count(*) FILTER (context = 'comment') AS in_comment,
  count(*) FILTER (context = 'docstring') AS in_docstring, count(*) FILTER (context = 'string') AS in_string, count(*) FILTER (context = 'code') AS in_code FROM emo GROUP BY path) e
 JOIN (SELECT path, count(*) AS emoji_lines, count(*) FILTER (n >= 3) AS clusters FROM emo_lines GROUP BY path) l ON l.path = e.path
 JOIN (SELECT path, count(*) AS total_lines FROM lines GROUP BY path) t ON t.path = e.path),
emo_conf AS MATERIALIZED (SELECT *, greatest(0, least(1, least(emojis / total_lines * 15, 0.25) + CASE WHEN in_code > 0 THEN 0.45 + in_code * 0.05 ELSE 0 END
 + CASE WHEN in_comment > 0 THEN 0.05 + in_comment * 0.02 ELSE 0 END + CASE WHEN clusters > 0 THEN 0.15 + clusters * 0.05 ELSE 0 END
 + least(weighted * 0.03, 0.15) - least(human * 0.02, 0.1)))::DOUBLE AS confidence FROM emo_m)"""
EMO_METRICS = """SELECT path, emojis, emoji_lines, clusters, in_comment, in_docstring, in_string, in_code, total_lines::INTEGER AS total_lines, round(score / emojis, 9)::DOUBLE AS mean_score,
 round(confidence, 9) AS confidence, CASE WHEN in_code > 0 THEN 'CRITICAL' WHEN clusters > 0 THEN 'HIGH' WHEN emojis / total_lines > 0.15 OR emojis > 10 THEN 'HIGH'
 WHEN emojis / total_lines > 0.08 OR emojis > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM emo_conf"""


def sql() -> dict[str, str]:
    return {
        "ant_versions": with_lines(VERSIONS), "ant_experimental": with_lines(EXPERIMENTAL), "ant_magic": with_lines(DOMAIN),
        "ant_over_engineering": with_files(OVER), "ant_dead_code": with_files(DEAD), "ant_premature": with_files(PREMATURE),
        "ant_abstraction": with_files(ABSTRACTION), "ant_flags": with_files(FLAGS),
        "class_metrics": with_lines(CLASS_METRICS, CLASSES_CTE), "god_classes": with_lines(god(1, 1, 8), CLASSES_CTE),
        "coupling": with_lines(coupling(4, 1), CLASSES_CTE, IMPORTS_CTE), "solid_params": with_lines(SOLID, CLASSES_CTE),
        "layer_violations": with_lines(LAYERS, IMPORTS_CTE), "pattern_misuse": with_files(MISUSE),
        "concrete_deps": with_lines(CONCRETE, IMPORTS_CTE),
        "dev_doc_names": with_files("SELECT path, doc_type, severity, CASE severity WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence, reason FROM doc_names", DOC_CTE),
        "dev_doc_content": with_files("SELECT path, matched::INTEGER AS matched, score FROM doc_scores", DOC_CTE),
        "dev_doc_ignore": with_files(IGNORE, DOC_CTE),
        "dev_doc_summary": with_files("SELECT doc_type, count(*) AS total, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM doc_issues GROUP BY doc_type", DOC_CTE),
        "emoji_matches": with_lines("SELECT path, line_no::INTEGER AS line_no, col_no::INTEGER AS col_no, emoji, code_point, context, category FROM emo", EMOJI_CTE),
        "emoji_categories": with_lines("SELECT category, count(*) AS n FROM emo GROUP BY category", EMOJI_CTE),
        "emoji_clusters": with_lines("SELECT path, line_no::INTEGER AS line_no, count(*)::INTEGER AS n FROM emo GROUP BY 1, 2 HAVING count(*) >= 3", EMOJI_CTE),
        "emoji_indicators": with_lines("""SELECT path, line_no::INTEGER AS line_no, n, CASE WHEN c THEN 'CRITICAL' WHEN n > 3 THEN 'HIGH' WHEN n > 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 least(n * 2.5, 12)::DOUBLE AS weight FROM (SELECT path, line_no, count(*) AS n, bool_or(context = 'code') AS c FROM emo GROUP BY 1, 2)""", EMOJI_CTE),
        "emoji_metrics": with_lines(EMO_METRICS, EMOJI_CTE, EMO_METRICS_CTE),
    }


__all__ = ["ascii_words", "sql"]
