"""SQL twins of naming, number, flag and function-size operators."""

from __future__ import annotations

from codesieve.plans.oracle import rules as R
from codesieve.plans.oracle.sources import LINES_CTE, STRIP_CHARS, arr, lstrip, q, strip, with_files, with_lines
from codesieve.rulebook import style as Y

D3, S3 = chr(34) * 3, chr(39) * 3


def unescaped(delimiter: str) -> str:
    text = f"replace(line, chr(92) || {q(delimiter)}, '')"
    return f"((len({text}) - len(replace({text}, {q(delimiter)}, ''))) // 3)"


MASKED_CTE = f"""counted AS (
SELECT *, {unescaped(D3)} AS cd, {unescaped(S3)} AS cs,
 CASE WHEN contains(line, '/*') AND NOT contains(line, '*/') THEN 1 WHEN contains(line, '*/') THEN 0 END AS ev FROM lines),
masked AS MATERIALIZED (
SELECT path, language, line_no, line,
 CASE WHEN language IN ('python', 'javascript', 'typescript') THEN coalesce(sum(cd) OVER w, 0) % 2 = 1 OR coalesce(sum(cs) OVER w, 0) % 2 = 1 OR cd > 0 OR cs > 0
  WHEN language IN ('java', 'csharp', 'go', 'rust', 'c', 'cpp') THEN ev IS NOT NULL OR coalesce(last_value(ev IGNORE NULLS) OVER w, 0) = 1
  ELSE false END AS in_docstring
FROM counted WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

QUOTES = f"(len(line) - len(replace(line, chr(39), '')) + len(line) - len(replace(line, chr(34), '')))"


def ascii_words(text: str) -> str:
    """Lower-cased text whose accented letters can be part of no identifier."""
    return f"regexp_replace({text}, '[\\x{{80}}-\\x{{24F}}]', 'Q', 'g')"


def identifiers(text: str) -> str:
    whens, done = [], {}
    for lang, pattern in Y.IDENTIFIERS.items():
        done.setdefault(pattern.replace("a-zA-Z0-9", "a-z0-9"), []).append(lang)
    for pattern, langs in done.items():
        whens.append(f"WHEN language IN ({', '.join(map(q, langs))}) THEN regexp_extract_all({ascii_words(text)}, {q(pattern)}, 1)")
    return f"CASE {' '.join(whens)} ELSE regexp_extract_all({ascii_words(text)}, {q(Y.DEFAULT_IDENTIFIER)}, 1) END"


def in_string(line: str, col: str) -> str:
    before = f"regexp_replace(left({line}, {col}), '\\\\[\\s\\S]', '', 'g')"
    bare = f"regexp_replace({before}, '\"[^\"]*\"|''[^'']*''', '', 'g')"
    return f"({col} >= 0 AND {col} < len({line}) AND (contains({bare}, chr(34)) OR contains({bare}, chr(39))))"


def names_in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


NAMES_CTE = f"""names AS MATERIALIZED (
SELECT * FROM (SELECT *, instr(lower(line), identifier) - 1 AS col_no FROM (
 SELECT path, line_no, line, unnest({identifiers('lower(line)')}) AS identifier FROM masked
 WHERE NOT {R.comment('pattern')} AND NOT in_docstring AND {QUOTES} < 4
  AND NOT {R.prefixed(strip('line'), ('from typing import', 'from collections import', 'import '))})
 WHERE identifier NOT IN {names_in(sorted(set(Y.ACCEPTABLE_NAMES) | set(Y.TYPE_HINT_NAMES)))})
WHERE NOT {in_string('line', 'col_no')})"""

GENERIC = f"""SELECT path, line_no::INTEGER AS line_no, col_no::INTEGER AS col_no, identifier,
 CASE WHEN base IS NULL THEN 'HIGH' WHEN lifted AND base = 'MEDIUM' THEN 'HIGH' WHEN lifted AND base = 'HIGH' THEN 'CRITICAL' ELSE base END AS severity,
 CASE base WHEN 'CRITICAL' THEN 0.92 WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.65 ELSE 0.85 END::DOUBLE AS confidence,
 {R.context()} AS context,
 CASE WHEN base IS NULL THEN 'Replace ''' || identifier || ''' with descriptive name (numbered variable pattern)'
  ELSE coalesce({R.mapped('identifier', Y.NAME_SUGGESTIONS)}, 'Replace ''' || identifier || ''' with descriptive name') END AS suggestion
FROM (SELECT *, CASE WHEN identifier IN {names_in(Y.CRITICAL_NAMES)} THEN 'CRITICAL' WHEN identifier IN {names_in(Y.HIGH_NAMES)} THEN 'HIGH'
  WHEN identifier IN {names_in(Y.MEDIUM_NAMES)} THEN 'MEDIUM' END AS base,
  contains(lower(line), 'def ') OR contains(lower(line), 'function ') OR contains(lower(line), 'class ') OR contains(lower(line), 'return ') AS lifted FROM names)
WHERE base IS NOT NULL OR regexp_full_match(identifier, '[a-z]+\\d+')"""

OVERUSE = f"""SELECT path, identifier, count(*) AS uses, 'HIGH' AS severity, least(0.9, 0.6 + count(*) * 0.03)::DOUBLE AS confidence
FROM names WHERE identifier IN {names_in(sorted({*Y.CRITICAL_NAMES, *Y.HIGH_NAMES}))} GROUP BY 1, 2 HAVING count(*) > 5"""

TRAPS = f"""SELECT path, line_no::INTEGER AS line_no, {R.context()} AS context, kind, n::INTEGER AS n, severity, confidence::DOUBLE AS confidence FROM (
SELECT path, line_no, line, 'call' AS kind, n, CASE WHEN n >= 4 THEN 'CRITICAL' WHEN n >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, least(0.9, 0.65 + n * 0.08) AS confidence
 FROM (SELECT *, {R.count('line', r'\b(True|False|true|false)\b')} AS n FROM lines WHERE NOT {R.comment('pattern')}
   AND {R.has('line', r'\b(True|False|true|false)\s*,\s*(True|False|true|false)')}) WHERE n >= 2
UNION ALL
SELECT path, line_no, line, 'definition', n, CASE WHEN n >= 5 THEN 'CRITICAL' ELSE 'HIGH' END, least(0.88, 0.7 + n * 0.05)
 FROM (SELECT *, len(list_filter(string_split(regexp_extract(line, '^\\s*def\\s+\\w+\\s*\\(([^)]+)\\)', 1), ','),
   lambda p: lower({strip("split_part(split_part(" + strip('p') + ", ':', 1), '=', 1)")}) IN {names_in(Y.BOOLEAN_PARAMETERS)})) AS n
   FROM lines WHERE NOT {R.comment('pattern')}) WHERE n >= 3)"""

NUMBERS = f"""SELECT path, line_no::INTEGER AS line_no, col_no::INTEGER AS col_no, number, CASE WHEN v >= 100 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 CASE WHEN v >= 100 THEN 0.85 ELSE 0.78 END::DOUBLE AS confidence, {R.context()} AS context FROM (
SELECT *, number::DOUBLE AS v, split_part(split_part(line, '#', 1), '//', 1) AS code_part FROM (
 SELECT path, line_no, line, ord, regexp_extract(piece, '^\\d+\\.?\\d*\\b', 0) AS number,
  sum(len(piece)) OVER (PARTITION BY path, line_no ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS col_no FROM (
  SELECT path, line_no, line, unnest(string_split(marked, chr(1))) AS piece, generate_subscripts(string_split(marked, chr(1)), 1) AS ord FROM (
   SELECT path, line_no, line, regexp_replace({ascii_words('line')}, '\\b(\\d+\\.?\\d*)\\b', chr(1) || '\\0', 'g') AS marked FROM masked
   WHERE NOT {R.comment('pattern')} AND NOT in_docstring AND {QUOTES} < 4 AND NOT regexp_matches(line, '^\\s*[A-Z_][A-Z0-9_]*\\s*='))))
 WHERE ord > 1) WHERE
 NOT (CASE WHEN v = floor(v) THEN v IN ({', '.join(map(str, Y.ACCEPTABLE_INTEGERS))}) ELSE v IN ({', '.join(map(str, Y.ACCEPTABLE_DECIMALS))}) END)
 AND NOT {in_string('line', 'col_no')} AND contains(code_part, number)
 AND NOT regexp_matches(line, '\\[\\s*' || regexp_escape(number) || '\\s*\\]')
 AND NOT (regexp_matches(line, '=\\s*' || regexp_escape(number) || '\\s*[,)]') AND v < 1.0)"""

WIDE = f"""SELECT path, line_no::INTEGER AS line_no, name, n::INTEGER AS n, CASE WHEN n > 8 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
 least(0.88, 0.7 + n * 0.03)::DOUBLE AS confidence, 'parameters' AS kind FROM (
 SELECT path, line_no, regexp_extract(line, '^\\s*def\\s+(\\w+)\\s*\\(([^)]*)\\)', 1) AS name,
  len(list_filter(list_transform(string_split(regexp_extract(line, '^\\s*def\\s+(\\w+)\\s*\\(([^)]*)\\)', 2), ','), lambda p: {strip('p')}),
   lambda p: p <> '' AND {strip("split_part(split_part(p, ':', 1), '=', 1)")} NOT IN ('self', 'cls'))) AS n
 FROM lines WHERE regexp_matches(line, '^\\s*def\\s+(\\w+)\\s*\\(([^)]*)\\)')) WHERE n > 5"""


def _start_case(group: int | None) -> str:
    pats = {}
    for lang, pattern in Y.FUNCTION_STARTS.items():
        pats.setdefault(pattern, []).append(lang)
    use = (lambda p: f"regexp_matches(line, {q(p)})") if group is None else (lambda p: f"regexp_extract(line, {q(p)}, {group})")
    whens = " ".join(f"WHEN language IN ({', '.join(map(q, ls))}) THEN {use(p)}" for p, ls in pats.items())
    return f"CASE {whens} ELSE {use(Y.DEFAULT_FUNCTION_START)} END"


SPECIAL = R.prefixed(strip("line"), ("#", D3, S3))
LONG = f"""SELECT path, start_line::INTEGER AS line_no, name, n::INTEGER AS n, CASE WHEN n > 100 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
 least(0.9, 0.65 + n / 100.0 * 0.25)::DOUBLE AS confidence, 'lines' AS kind FROM (
SELECT path, seg, any_value(name) AS name, min(start_line) AS start_line, count(*) FILTER (counted AND line_no < coalesce(stop, 1000000000)) AS n FROM (
 SELECT *, min(CASE WHEN closing THEN line_no END) OVER (PARTITION BY path, seg) AS stop FROM (
 SELECT *, line_no > start_line AND {strip('line')} <> '' AND (language <> 'python' OR ind > base OR {SPECIAL}) AS counted,
  language = 'python' AND line_no > start_line AND {strip('line')} <> '' AND ind <= base AND NOT {R.prefixed(strip('line'), ('#', D3, S3, '@', 'def ', 'class '))} AS closing FROM (
 SELECT *, first_value(line_no) OVER s AS start_line, first_value(ind) OVER s AS base, first_value(fname) OVER s AS name FROM (
  SELECT *, len(line) - len({lstrip('line')}) AS ind, {_start_case(1)} AS fname,
   sum(({_start_case(None)})::INTEGER) OVER (PARTITION BY path ORDER BY line_no) AS seg FROM lines)
  WHERE seg > 0 WINDOW s AS (PARTITION BY path, seg ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
) WHERE name <> '' GROUP BY path, seg) WHERE n > 50"""

PHRASES = f"""SELECT path, line_no::INTEGER AS line_no, {R.names(Y.TUTORIAL_PHRASES)} AS phrase,
 CASE WHEN {R.confidences(Y.TUTORIAL_PHRASES)} > 0.85 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, {R.confidences(Y.TUTORIAL_PHRASES)} AS confidence, {R.context()} AS context
FROM (SELECT *, {R.first_match(Y.TUTORIAL_PHRASES)} AS i FROM lines WHERE {R.comment('pattern')}) WHERE i IS NOT NULL"""

SHARE = f"""SELECT path, comment_lines::INTEGER AS comment_lines, total_lines::INTEGER AS total_lines, comment_lines / total_lines AS ratio,
 CASE WHEN comment_lines / total_lines > 0.6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, least(0.85, comment_lines / total_lines)::DOUBLE AS confidence FROM (
 SELECT path, count(*) FILTER ({R.comment('pattern')}) AS comment_lines, count(*) AS total_lines FROM lines WHERE {strip('line')} <> '' GROUP BY path)
WHERE total_lines > 10 AND comment_lines / total_lines > 0.5"""


def sql() -> dict[str, str]:
    return {
        "docstring_mask": with_lines("SELECT path, line_no::INTEGER AS line_no FROM masked WHERE in_docstring", MASKED_CTE),
        "generic_naming": with_lines(GENERIC, MASKED_CTE, NAMES_CTE),
        "generic_overuse": with_lines(OVERUSE, MASKED_CTE, NAMES_CTE),
        "boolean_traps": with_lines(TRAPS),
        "magic_numbers": with_lines(NUMBERS, MASKED_CTE),
        "god_functions": with_lines(f"{WIDE} UNION ALL {LONG}"),
        "verbose_comments": with_lines(PHRASES),
        "comment_share": with_lines(SHARE),
    }


__all__ = ["sql", "LINES_CTE", "STRIP_CHARS", "arr", "with_files"]
