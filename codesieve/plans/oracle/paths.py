"""SQL twins of the parser tier, path predicates and text helpers."""

from __future__ import annotations

import re

from codesieve.functions.text import any_glob
from codesieve.plans.oracle import rules as R
from codesieve.plans.oracle.design import EMOJI_CTE
from codesieve.plans.oracle.naming import ascii_words, in_string, names_in
from codesieve.plans.oracle.sources import arr, q, strip, with_files, with_lines
from codesieve.rulebook import emoji as E
from codesieve.rulebook import files as T
from codesieve.rulebook import grammar as G

BASE = "split_part(path, '/', -1)"
EXT = f"regexp_extract({BASE}, '^.+(\\.[^.]+)$', 1)"


def by_language(key: str, use, default: str) -> str:
    whens = []
    for name, table in G.LINE_PATTERNS.items():
        if name == "python":
            continue
        whens.append(f"WHEN {q(name)} THEN {use(table[key]) if key in table else default}")
    return f"CASE language {' '.join(whens)} ELSE {use(G.LINE_PATTERNS['python'][key])} END"


def first_group(pattern: str) -> str:
    parts = [f"nullif(regexp_extract(line, {q(pattern)}, {g}), '')" for g in range(1, re.compile(pattern).groups + 1)]
    return f"coalesce({', '.join(parts)}, '')"


has_line = lambda p: f"regexp_matches(line, {q(p)})"
FUNCTIONS = f"SELECT path, line_no::INTEGER AS line_no, {by_language('f', first_group, chr(39) * 2)} AS name, contains(lower(line), 'async') AS is_async FROM lines WHERE {by_language('f', has_line, 'false')}"
CLASSES = f"SELECT path, line_no::INTEGER AS line_no, {by_language('c', first_group, chr(39) * 2)} AS name FROM lines WHERE {by_language('c', has_line, 'false')}"
IMPORTS = f"SELECT path, line_no::INTEGER AS line_no, {by_language('i', first_group, chr(39) * 2)} AS module FROM lines WHERE {by_language('i', has_line, 'false')}"


def _keyword_total(keys) -> str:
    parts = [R.count(ascii_words("content"), rf"\b{k}\b") if k.isalpha() else
             f"(len(content) - len(replace(content, {q(k)}, ''))) // {len(k)}" for k in keys]
    return "1 + " + " + ".join(parts)


COMPLEXITY = (f"SELECT path, (CASE language " + " ".join(
    f"WHEN {q(n)} THEN {_keyword_total(k)}" for n, k in G.COMPLEXITY_KEYWORDS.items() if n in ("javascript", "typescript", "java"))
    + f" ELSE {_keyword_total(G.COMPLEXITY_KEYWORDS['python'])} END)::INTEGER AS complexity FROM files")

D3, S3 = q(chr(34) * 3), q(chr(39) * 3)
# Line kinds by a recursive walk: state 0 outside, 1/2 inside triple quotes, 3 inside a block comment.
_n = lambda d: f"((len(l.t) - len(replace(l.t, {d}, ''))) // 3)"
KINDS_CTE = f"""stripped AS MATERIALIZED (SELECT path, language, line_no, {strip('line')} AS t FROM lines WHERE language IN ('python', 'javascript', 'typescript', 'java')),
walk AS (SELECT path, 0::BIGINT AS line_no, 0 AS st, '' AS kind FROM files WHERE language IN ('python', 'javascript', 'typescript', 'java')
UNION ALL SELECT l.path, l.line_no, CASE WHEN l.t = '' THEN w.st
  WHEN w.st > 0 THEN CASE WHEN (w.st = 1 AND contains(l.t, {D3})) OR (w.st = 2 AND contains(l.t, {S3})) OR (w.st = 3 AND contains(l.t, '*/')) THEN 0 ELSE w.st END
  WHEN l.language = 'python' AND contains(l.t, {D3}) THEN CASE WHEN {_n(D3)} = 1 THEN 1 ELSE 0 END
  WHEN l.language = 'python' AND contains(l.t, {S3}) THEN CASE WHEN {_n(S3)} = 1 THEN 2 ELSE 0 END
  WHEN l.language <> 'python' AND contains(l.t, '/*') THEN CASE WHEN contains(substr(l.t, instr(l.t, '/*') + 2), '*/') THEN 0 ELSE 3 END ELSE 0 END,
 CASE WHEN l.t = '' THEN 'blank' WHEN w.st > 0 THEN 'comment' WHEN l.language = 'python' AND (contains(l.t, {D3}) OR contains(l.t, {S3}) OR starts_with(l.t, '#')) THEN 'comment'
  WHEN l.language <> 'python' AND (contains(l.t, '/*') OR starts_with(l.t, '//')) THEN 'comment' ELSE 'code' END
 FROM walk w JOIN stripped l ON l.path = w.path AND l.line_no = w.line_no + 1)"""
KINDS = """SELECT path, count(*)::INTEGER AS total, count(*) FILTER (kind = 'blank')::INTEGER AS blank, count(*) FILTER (kind = 'comment')::INTEGER AS comment,
 count(*) FILTER (kind = 'code')::INTEGER AS code FROM walk WHERE line_no > 0 GROUP BY path"""


def votes(text: str, words) -> str:
    return f"len(list_filter({arr(words)}, lambda w: contains({text}, w)))"


SAMPLE = "array_to_string(string_split(content, chr(10))[1:50], chr(10))"
DETECT = f"""CASE WHEN {BASE} IN {names_in(T.SPECIAL_NAMES)} THEN {R.mapped(BASE, T.SPECIAL_NAMES)}
 WHEN lower({EXT}) IN {names_in(T.BINARY_EXTENSIONS)} THEN 'binary'
 WHEN lower({EXT}) = '.m' AND {SAMPLE} <> '' THEN CASE WHEN {votes(f'lower({SAMPLE})', T.MATLAB_WORDS)} > {votes(SAMPLE, T.OBJC_WORDS)} THEN 'matlab' ELSE 'objective-c' END
 WHEN lower({EXT}) = '.v' AND {SAMPLE} <> '' THEN CASE WHEN {votes(f'lower({SAMPLE})', T.VERILOG_WORDS)} > {votes(f'lower({SAMPLE})', T.VLANG_WORDS)} THEN 'verilog' ELSE 'vlang' END
 WHEN lower({EXT}) = '.h' AND {SAMPLE} <> '' THEN CASE WHEN {votes(f'lower({SAMPLE})', T.CPP_WORDS)} > 0 THEN 'cpp' ELSE 'c' END
 ELSE coalesce({R.mapped(f'lower({EXT})', T.LANGUAGES)}, 'unknown') END"""

#: Paths with every extension kind, built from the files.
VARIANTS = ["$", "$.m", "$.v", "$.h", "$.PNG", "a/Dockerfile", "b/Makefile", "x/$.min.js", "build/$", "lib.egg-info/$",
            "src/test/$", "$.spec.ts", "pkg/conftest.py", "$_test.go", "q/test_$", "y/.hidden", "$.tar.gz"]
VARIANTS_CTE = f"""variants AS MATERIALIZED (SELECT path AS base_path, replace({arr(VARIANTS)}[(doc_id % {len(VARIANTS)}) + 1], '$', path) AS path, content FROM files)"""

GLOBS = any_glob(T.TEST_GLOBS)
IS_TEST = f"(regexp_matches(path, {q(GLOBS)}) OR regexp_matches({BASE}, {q(GLOBS)}))"
EXCLUDED = f"""len(list_filter(string_split(path, '/')[:-2], lambda d: d IN {names_in(T.EXCLUDED_DIRS)} OR regexp_matches(d, '\\.egg-info$'))) > 0"""
EXCLUDE_GLOBS = ["*.min.js", "docs/*", "src/a?i/*", "*/f[0-4]*.py"]
GLOB = f"(regexp_matches(path, {q(any_glob(EXCLUDE_GLOBS))}) OR regexp_matches({BASE}, {q(any_glob(EXCLUDE_GLOBS))}))"
FILTER = f"""SELECT path FROM (SELECT path, content, {DETECT} AS lang FROM variants) WHERE {EXT} IN ('.py', '.js', '.ts', '.java') AND lang NOT IN ('unknown', 'binary')
 AND NOT ({EXCLUDED}) AND NOT {GLOB}"""

COUNTS = f"""SELECT path, count(*)::INTEGER AS total, count(*) FILTER ({strip('line')} = '')::INTEGER AS blank, count(*) FILTER ({strip('line')} <> '')::INTEGER AS code, 0 AS comments FROM lines GROUP BY path"""
IN_STRING = f"""SELECT path, line_no::INTEGER AS line_no, col_no::INTEGER AS col_no FROM (SELECT *, instr(line, 'data') - 1 AS col_no FROM lines WHERE contains(line, 'data')) WHERE {in_string('line', 'col_no')}"""
RENAME = {"data": "payload_rows", "result": "outcome", "temp1": "first_value"}


def _renamed() -> str:
    text = "content"
    for old, new in RENAME.items():
        text = f"regexp_replace({text}, '\\b{old}\\b', {q(new)}, 'g')"
    return text


REMOVER = q(E.char_class(E.REMOVER_RANGES) + "+")
SNIPPETS = f"""SELECT path, line_no::INTEGER AS line_no, (SELECT string_agg(CASE WHEN s.line_no = m.line_no THEN '>>> ' ELSE '    ' END || lpad(s.line_no::VARCHAR, 4, ' ') || ' | ' || s.line, chr(10) ORDER BY s.line_no)
 FROM lines s WHERE s.path = m.path AND s.line_no BETWEEN m.line_no - 2 AND m.line_no + 2) AS snippet FROM lines m WHERE contains(line, 'eval(')"""
HINTS = ["JS", " ts ", "c++", "Golang", "rb", "cobol"]

QUOTED = ['"a/caf\\303\\251.py"', 'plain/$', '"tab\\there"', '"q\\"x\\\\y"', '"\\101bc"', '"', '"un\\qknown"']


def sql() -> dict[str, str]:
    return {
        "regex_functions": with_lines(FUNCTIONS), "regex_classes": with_lines(CLASSES), "regex_imports": with_lines(IMPORTS),
        "regex_complexity": with_files(COMPLEXITY),
        "loc_breakdown": with_lines(KINDS, KINDS_CTE).replace("WITH ", "WITH RECURSIVE ", 1),
        "line_counts": with_lines(COUNTS),
        "comment_lines": with_lines("SELECT variant, count(*) AS n FROM (" + " UNION ALL ".join(
            f"SELECT {q(v)} AS variant FROM lines WHERE {R.comment(v)}" for v in
            ("security", "pattern", "semantic", "antipattern", "statistical", "emoji")) + ") GROUP BY variant"),
        "detect_language": with_files(f"SELECT path, {DETECT} AS detected FROM variants", VARIANTS_CTE),
        "language_for_path": with_files(f"SELECT path, {R.mapped(f'lower({EXT})', T.REVIEW_LANGUAGES)} AS language FROM variants", VARIANTS_CTE),
        "is_test_path": with_files(f"SELECT path, {IS_TEST} AS is_test FROM variants", VARIANTS_CTE),
        "glob_exclude": with_files(f"SELECT path FROM variants WHERE {GLOB} OR {EXCLUDED}", VARIANTS_CTE),
        "glob_match": with_files(f"SELECT path, regexp_matches(path, '^src/.a.a/.*[0-4]\\.py$') AS matched FROM variants", VARIANTS_CTE),
        "file_filter": with_files(FILTER, VARIANTS_CTE),
        "normalize_language": with_files(f"SELECT path, {R.mapped('lower(trim(h))', T.LANGUAGE_ALIASES)} AS canonical FROM (SELECT path, {arr(HINTS)}[doc_id % {len(HINTS)} + 1] AS h FROM files)"),
        "in_string": with_lines(IN_STRING),
        "remove_emojis": with_files(f"SELECT path, md5(regexp_replace(content, {REMOVER}, '', 'g')) AS digest FROM files WHERE regexp_matches(content, {REMOVER})"),
        "rename_identifiers": with_files(f"SELECT path, md5({_renamed()}) AS digest FROM files"),
        "snippets": with_lines(SNIPPETS),
    }


__all__ = ["EMOJI_CTE", "EXCLUDE_GLOBS", "HINTS", "QUOTED", "RENAME", "VARIANTS", "sql"]
