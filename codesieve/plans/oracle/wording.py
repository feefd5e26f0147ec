"""SQL twins of the comment and wording operators."""

from __future__ import annotations

from codesieve.plans.oracle import rules as R
from codesieve.plans.oracle.naming import ascii_words, names_in
from codesieve.plans.oracle.sources import arr, q, strip, with_files, with_lines
from codesieve.rulebook import style as Y

D3, S3 = q(chr(34) * 3), q(chr(39) * 3)
SLASHED = [lang for lang, mark in Y.COMMENT_MARKERS.items() if mark == "//"]
TOGGLE = f"(contains(line, {D3}) OR contains(line, {S3}))"
UNQUOTED = q("^(?:[^\"'#]|\"[^\"]*\"|'[^']*')*#(.*)$")

COMMENTS_CTE = f"""toggled AS (
SELECT *, language = 'python' AND {TOGGLE} AS tog, sum((language = 'python' AND {TOGGLE})::INTEGER) OVER (PARTITION BY path ORDER BY line_no) AS k,
 sum((language = 'python' AND {TOGGLE})::INTEGER) OVER (PARTITION BY path) AS ks FROM lines),
coms AS MATERIALIZED (
SELECT path, language, line_no, text FROM (
 SELECT path, language, line_no, {strip(f"CASE WHEN language = 'python' THEN regexp_extract(line, {UNQUOTED}, 1) WHEN language IN {names_in(SLASHED)} THEN (CASE WHEN contains(line, '//') THEN substr(line, instr(line, '//') + 2) ELSE '' END) ELSE (CASE WHEN contains(line, '#') THEN substr(line, instr(line, '#') + 1) ELSE '' END) END")} AS text
 FROM toggled WHERE NOT tog AND k % 2 = 0) WHERE text <> ''
UNION ALL
SELECT path, 'python', min(line_no), string_agg({strip('line')}, ' ' ORDER BY line_no) FROM (
 SELECT *, CASE WHEN k % 2 = 1 THEN k ELSE k - 1 END AS doc FROM toggled WHERE k % 2 = 1 OR (tog AND k % 2 = 0)) WHERE doc < ks GROUP BY path, doc)"""


def graded(expr: str) -> str:
    return f"CASE WHEN {expr} > 0.85 THEN 'HIGH' WHEN {expr} > 0.7 THEN 'MEDIUM' ELSE 'LOW' END"


STYLE = f"""SELECT path, line_no::INTEGER AS line_no, {R.names(Y.WRITING_STYLE)} AS phrase, {graded(R.confidences(Y.WRITING_STYLE))} AS severity,
 {R.confidences(Y.WRITING_STYLE)} AS confidence, {R.context()} AS context
FROM (SELECT *, {R.first_match(Y.WRITING_STYLE)} AS i FROM lines WHERE {R.comment('semantic')}) WHERE i IS NOT NULL"""

QUALITY = f"""SELECT path, line_no::INTEGER AS line_no, kind, severity, confidence::DOUBLE AS confidence FROM (
SELECT path, line_no, CASE WHEN language IN ('python', 'ruby') THEN {strip(f"ltrim({strip('line')}, '#')")}
 ELSE {strip(f"ltrim(ltrim({strip('line')}, '/'), '*')")} END AS text FROM lines WHERE {R.comment('semantic')}) t,
LATERAL (SELECT 'single_word_comment' AS kind, 'LOW' AS severity, 0.6 AS confidence WHERE NOT regexp_matches(text, '\\s') AND len(text) > 3
 UNION ALL SELECT 'empty_marker', 'LOW', 0.55 WHERE regexp_matches(text, '(?i)^(?:TODO|FIXME|XXX|HACK)\\s*:?\\s*$')
 UNION ALL SELECT 'verbose_comment', 'MEDIUM', 0.65 WHERE len(text) > 200)"""

STYLE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(nm, {q(p)}) THEN {q(n)}" for n, p in Y.NAMING_STYLES) + " END"
NAMING = f"""SELECT path, count(*) AS styles, sum(n)::BIGINT AS named, arg_max(style, (n, -first)) AS dominant, 'MEDIUM' AS severity, 0.68::DOUBLE AS confidence FROM (
 SELECT path, style, count(*) AS n, min(pos) AS first FROM (SELECT path, pos, {STYLE_CASE} AS style FROM (
  SELECT path, unnest(t) AS nm, generate_subscripts(t, 1) AS pos FROM (
   SELECT path, CASE WHEN language = 'python' THEN regexp_extract_all({ascii_words('content')}, {q(Y.NAMED_VALUES['python'])}, 1)
    WHEN language IN ('javascript', 'typescript') THEN regexp_extract_all(content, {q(Y.NAMED_VALUES['javascript'])}, 1) END AS t FROM files) WHERE len(t) >= 5))
 WHERE style IS NOT NULL GROUP BY 1, 2) GROUP BY path HAVING count(*) > 2"""

DOCSTRING_CTE = f"""sem_tog AS (SELECT path, line_no, {strip('line')} AS txt, {TOGGLE} AS tog, sum(({TOGGLE})::INTEGER) OVER (PARTITION BY path ORDER BY line_no) AS k,
 sum(({TOGGLE})::INTEGER) OVER (PARTITION BY path) AS ks FROM lines WHERE language = 'python'),
sem_docs AS (SELECT path, min(line_no) AS line_no, string_agg(txt, chr(10) ORDER BY line_no) AS doc, count(*) AS doc_lines,
 count(*) FILTER (txt <> '') - 1 AS rest FROM (SELECT *, CASE WHEN k % 2 = 1 THEN k ELSE k - 1 END AS g FROM sem_tog WHERE k % 2 = 1 OR tog) WHERE g < ks GROUP BY path, g)"""
DOCSTRING = f"""SELECT path, line_no::INTEGER AS line_no, sections::INTEGER AS sections, doc_lines::INTEGER AS doc_lines, 'MEDIUM' AS severity, 0.65::DOUBLE AS confidence FROM (
 SELECT *, {' + '.join(f"contains(doc, {q(s)})::INTEGER" for s in Y.DOCSTRING_SECTIONS)} AS sections FROM sem_docs)
WHERE (sections >= 3 AND doc_lines < 15) OR (doc_lines > 3 AND rest > 0)"""


def _vocab(words) -> str:
    return f"len(list_filter({arr(words)}, lambda w: contains(low, w)))"


VOCAB = f"""SELECT path, m::INTEGER AS machine_words, h::INTEGER AS human_words, CASE WHEN m > 5 AND m > h * 2 THEN 'MEDIUM' END AS severity,
 CASE WHEN m > 5 AND m > h * 2 THEN least(0.85, 0.5 + m * 0.03) END::DOUBLE AS confidence FROM (
 SELECT path, {_vocab(Y.MACHINE_VOCABULARY)} AS m, {_vocab(Y.HUMAN_VOCABULARY)} AS h FROM (SELECT path, lower(content) AS low FROM files))"""


def formality(source: str, key: str, text: str) -> str:
    total = lambda ps: " + ".join(R.count(ascii_words_mixed(text), p, "i") for p in ps)
    return f"""SELECT {key}, f::INTEGER AS formal, i::INTEGER AS informal, round(CASE WHEN f + i = 0 THEN 0.5 ELSE f / (f + i) END, 9) AS score,
 coalesce(f / nullif(f + i, 0), 0.5) > 0.7 AS high FROM (SELECT {key}, {total(Y.FORMAL_PATTERNS)} AS f, {total(Y.INFORMAL_PATTERNS)} AS i FROM {source})"""


def ascii_words_mixed(text: str) -> str:
    """Accented letters become a word character no rule word contains."""
    return f"regexp_replace({text}, '[\\x{{80}}-\\x{{24F}}]', '_', 'g')"


PHRASES = f"""SELECT path, line_no::INTEGER AS line_no, {R.names(Y.COMMENT_PHRASES)} AS phrase, {graded(R.confidences(Y.COMMENT_PHRASES))} AS severity,
 {R.confidences(Y.COMMENT_PHRASES)} AS confidence, left(text, 100) AS comment, {R.mapped(R.names(Y.COMMENT_PHRASES), Y.COMMENT_PHRASE_SUGGESTIONS, Y.COMMENT_PHRASE_DEFAULT)} AS suggestion
FROM (SELECT *, {R.first_match(Y.COMMENT_PHRASES, 'text')} AS i FROM coms) WHERE i IS NOT NULL"""

WORD_LIST = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
OBVIOUS = f"""SELECT path, line_no::INTEGER AS line_no, 'obvious_comment' AS kind, {R.names(Y.OBVIOUS_COMMENTS)} AS rule,
 CASE WHEN {R.confidences(Y.OBVIOUS_COMMENTS)} > 0.85 THEN 'MEDIUM' ELSE 'LOW' END AS severity, {R.confidences(Y.OBVIOUS_COMMENTS)} AS confidence
FROM (SELECT *, {R.first_match(Y.OBVIOUS_COMMENTS, "('# ' || text)")} AS i FROM coms) WHERE i IS NOT NULL
UNION ALL SELECT path, line_no::INTEGER, 'too_brief_comment', 'too_brief', 'LOW', 0.65 FROM coms
WHERE len({WORD_LIST}) <= 2 AND len(text) < 15 AND NOT ({' OR '.join(f"contains(upper(text), {q(w)})" for w in ('TODO', 'FIXME', 'XXX', 'NOTE', 'HACK'))})"""

TOTALS_CTE = f"""com_totals AS (SELECT path, comments, chars, code_lines FROM (SELECT path, count(*) AS comments, sum(len(text)) AS chars FROM coms GROUP BY path) JOIN (
 SELECT path, count(*) FILTER ({strip('line')} <> '' AND NOT {R.prefixed(strip('line'), ('#', '//', chr(34) * 3, chr(39) * 3, '/*', '*'))}) AS code_lines FROM lines GROUP BY path) USING (path))"""
METRICS = """SELECT path, comments, code_lines::INTEGER AS code_lines, round(comments / greatest(1, code_lines), 9) AS ratio, round(chars / comments, 9)::DOUBLE AS mean_length FROM com_totals"""
RATIO = """SELECT path, comments, code_lines::INTEGER AS code_lines, CASE WHEN comments / code_lines > 0.6 THEN 'excessive_comments' ELSE 'high_comment_ratio' END AS kind,
 CASE WHEN comments / code_lines > 0.6 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, CASE WHEN comments / code_lines > 0.6 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence
FROM com_totals WHERE code_lines >= 5 AND comments / code_lines > 0.4"""
LENGTH = """SELECT path, line_no::INTEGER AS line_no, 'long_comment' AS kind, len(text)::DOUBLE AS value, 'MEDIUM' AS severity, least(0.85, 0.6 + (len(text) - 120) / 200)::DOUBLE AS confidence
 FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rk FROM coms WHERE len(text) > 120) WHERE rk <= 5
UNION ALL SELECT path, 1, CASE WHEN v > 100 THEN 'verbose_comments_overall' ELSE 'somewhat_verbose_comments' END, round(v, 9), CASE WHEN v > 100 THEN 'HIGH' ELSE 'MEDIUM' END,
 CASE WHEN v > 100 THEN 0.85 ELSE 0.72 END FROM (SELECT path, avg(len(text)) AS v FROM coms GROUP BY path) WHERE v > 60"""
FILLER = f"""SELECT path, line_no::INTEGER AS line_no, n::INTEGER AS n, 'MEDIUM' AS severity, least(0.85, 0.6 + n * 0.08)::DOUBLE AS confidence FROM (
 SELECT path, line_no, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w IN {names_in(Y.FILLER_WORDS)})) AS n FROM coms) WHERE n >= 3"""


def _own(text: str) -> str:
    return (f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')), "
            f"lambda w: w NOT IN {names_in(Y.COMMON_CODE_WORDS)})")


REDUNDANT = f"""SELECT path, line_no::INTEGER AS line_no, round(overlap, 9) AS overlap, 'MEDIUM' AS severity, round(least(0.88, 0.5 + overlap * 0.4), 9) AS confidence FROM (
 SELECT path, line_no, len(list_intersect(c, k)) / len(c) AS overlap FROM (
  SELECT m.path, m.line_no, {_own('m.text')} AS c, {_own('l.code')} AS k FROM coms m JOIN (
   SELECT path, line_no, coalesce(lead(cand, 1) OVER o, lead(cand, 2) OVER o, lead(cand, 3) OVER o) AS code FROM (
    SELECT path, line_no, CASE WHEN {strip('line')} <> '' AND NOT {R.prefixed(strip('line'), ('#', '//'))} THEN {strip('line')} END AS cand FROM lines)
   WINDOW o AS (PARTITION BY path ORDER BY line_no)) l ON l.path = m.path AND l.line_no = m.line_no WHERE l.code IS NOT NULL)
 WHERE len(c) > 0 AND len(k) > 0) WHERE overlap > 0.6"""


def sql() -> dict[str, str]:
    return {
        "sem_comment_quality": with_lines(QUALITY),
        "sem_writing_style": with_lines(STYLE),
        "naming_styles": with_files(NAMING),
        "sem_docstring": with_lines(DOCSTRING, DOCSTRING_CTE),
        "vocab_markers": with_files(VOCAB),
        "formality": with_files(formality("files", "path", "content")),
        "formality_turns": formality("(SELECT conv_id || ':' || turn AS turn_id, text FROM conversations)", "turn_id", "text"),
        "com_extract": with_lines("SELECT path, line_no::INTEGER AS line_no, text FROM coms", COMMENTS_CTE),
        "com_verbose": with_lines(PHRASES, COMMENTS_CTE),
        "com_obvious": with_lines(OBVIOUS, COMMENTS_CTE),
        "comment_metrics": with_lines(METRICS, COMMENTS_CTE, TOTALS_CTE),
        "com_ratio": with_lines(RATIO, COMMENTS_CTE, TOTALS_CTE),
        "com_length": with_lines(LENGTH, COMMENTS_CTE),
        "com_filler": with_lines(FILLER, COMMENTS_CTE),
        "redundant_comments": with_lines(REDUNDANT, COMMENTS_CTE),
    }
