"""SQL twins of the per-file statistics, mostly with windows and joins."""

from __future__ import annotations

from codesieve.plans.oracle import rules as R
from codesieve.plans.oracle.naming import ascii_words, identifiers, names_in
from codesieve.plans.oracle.sources import lstrip, q, strip, with_files, with_lines
from codesieve.rulebook import grammar as G
from codesieve.rulebook import style as Y

WORDS_CTE = """words AS MATERIALIZED (
SELECT path, pos, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM (
 SELECT path, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM (SELECT path, regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+') AS t FROM files))
WINDOW o AS (PARTITION BY path ORDER BY pos)),
gram_scores AS MATERIALIZED (
SELECT path, tokens, u2, u3, CASE WHEN tokens < 20 THEN 0.0 ELSE (1 - u2 / (tokens - 1)) * 0.4 + (1 - u3 / (tokens - 2)) * 0.6 END AS score FROM (
 SELECT path, count(*) AS tokens, count(DISTINCT CASE WHEN w2 IS NOT NULL THEN w || ' ' || w2 END) AS u2,
  count(DISTINCT CASE WHEN w3 IS NOT NULL THEN w || ' ' || w2 || ' ' || w3 END) AS u3 FROM words GROUP BY path))"""

NGRAM = """SELECT path, tokens::INTEGER AS tokens, u2::INTEGER AS u2, u3::INTEGER AS u3, round(score, 9) AS score,
 CASE WHEN score > 0.5 THEN 'CRITICAL' WHEN score > 0.3 THEN 'HIGH' END AS severity,
 CASE WHEN score > 0.3 THEN round(least(0.9, score + 0.4), 9) END AS confidence FROM gram_scores"""

TRIPLES = """SELECT path, gram, n, rank::INTEGER AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, first) AS rank FROM (
 SELECT path, w || ' ' || w2 || ' ' || w3 AS gram, count(*) AS n, min(pos) AS first FROM words
 WHERE w3 IS NOT NULL AND path IN (SELECT path FROM gram_scores WHERE tokens >= 20) GROUP BY 1, 2 HAVING count(*) > 2)) WHERE rank <= 10"""

ENTROPY_CTE = f"""toks AS (SELECT path, len(t) AS raw, list_filter(t, lambda x: x NOT IN {names_in(Y.ENTROPY_STOP_TOKENS)}) AS t FROM (
 SELECT path, {identifiers('lower(content)')} AS t FROM files)),
entropies AS MATERIALIZED (
SELECT path, CASE WHEN raw < 30 OR len(t) < 15 THEN 5.0 ELSE e END AS entropy FROM toks LEFT JOIN (
 SELECT path, sum(-(c / n) * log2(c / n)) AS e FROM (SELECT *, sum(c) OVER (PARTITION BY path) AS n FROM (
  SELECT path, w, count(*) AS c FROM (SELECT path, unnest(t) AS w FROM toks) GROUP BY 1, 2)) GROUP BY path) USING (path))"""

ENTROPY = """SELECT path, round(entropy, 6) AS entropy, CASE WHEN entropy < 3 THEN 'CRITICAL' WHEN entropy < 4 THEN 'HIGH' END AS severity,
 CASE WHEN entropy < 4 THEN round(least(0.85, (4.0 - entropy) / 4.0 + 0.5), 6) END AS confidence FROM entropies"""

# The word class of the token pattern must cover accented letters.
TOKEN = G.HALSTEAD_TOKEN.replace(r"[\w]+", r"[\p{L}\p{N}_]+")
HALSTEAD_CTE = f"""htok AS (SELECT path, w, w IN {names_in(G.HALSTEAD_OPERATORS)} AS op, regexp_matches(w, '^[a-zA-Z_]') AS named FROM (
 SELECT path, unnest(regexp_extract_all(content, {q(TOKEN)})) AS w FROM files)),
halstead_rows AS MATERIALIZED (
SELECT *, difficulty * volume AS effort, volume / 3000 AS bugs FROM (
SELECT *, CASE WHEN n1 + n2 > 0 THEN (big_n1 + big_n2) * log2(n1 + n2) ELSE 0.0 END AS volume,
 CASE WHEN n2 > 0 THEN (n1 / 2) * (big_n2 / n2) ELSE 0.0 END AS difficulty FROM (
SELECT f.path, count(DISTINCT w) FILTER (op) AS n1, count(DISTINCT w) FILTER (NOT op AND named) AS n2,
 count(*) FILTER (op) AS big_n1, count(*) FILTER (NOT op AND named) AS big_n2 FROM files f LEFT JOIN htok h ON h.path = f.path GROUP BY f.path)))"""

HALSTEAD = """SELECT path, n1::INTEGER AS n1, n2::INTEGER AS n2, big_n1::INTEGER AS big_n1, big_n2::INTEGER AS big_n2, round(volume, 4) AS volume,
 round(difficulty, 4) AS difficulty, round(effort, 2) AS effort, round(bugs, 6) AS bugs, volume > 1000 AS high_volume, difficulty > 30 AS high_difficulty,
 CASE WHEN bugs > 2 THEN 'HIGH' WHEN bugs > 1 THEN 'MEDIUM' END AS bug_severity FROM halstead_rows"""

DIVERSITY_CTE = f"""diversity AS MATERIALIZED (
SELECT path, count(*) AS tokens, count(DISTINCT w) AS unique_tokens FROM (
 SELECT path, unnest(regexp_extract_all({ascii_words('lower(line)')}, '\\b([a-z_][a-z0-9_]{{2,}})\\b', 1)) AS w FROM lines WHERE NOT {R.comment('statistical')}) GROUP BY path)"""
DIVERSITY = """SELECT path, tokens::INTEGER AS tokens, unique_tokens::INTEGER AS unique_tokens, round(ttr, 9) AS ttr, round(unique_tokens / sqrt(tokens), 9) AS guiraud,
 CASE WHEN ttr < 0.3 THEN 'CRITICAL' WHEN ttr < 0.5 THEN 'HIGH' END AS severity,
 CASE WHEN ttr < 0.5 THEN round(least(0.88, (0.5 - ttr) * 2 + 0.5), 9) END AS confidence
FROM (SELECT *, unique_tokens / tokens AS ttr FROM diversity) WHERE tokens >= 20"""

# Reflected walk: the clamped level is the running sum minus its running minimum (at most 0).
NESTING_CTE = f"""nest_lines AS (
SELECT path, line_no, CASE WHEN contains(line, chr(9)) THEN len(left(line, ind)) - len(replace(left(line, ind), chr(9), '')) ELSE ind // 4 END AS depth
 FROM (SELECT *, len(line) - len({lstrip('line')}) AS ind FROM lines WHERE language = 'python' AND {strip('line')} <> '')
UNION ALL
SELECT path, line_no, s - least(0, min(s) OVER (PARTITION BY path ORDER BY line_no, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS depth FROM (
 SELECT path, line_no, ord, c, sum(CASE WHEN c IN ('{{', '(') THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY line_no, ord) AS s FROM (
  SELECT path, line_no, unnest(string_split(b, '')) AS c, generate_subscripts(string_split(b, ''), 1) AS ord FROM (
   SELECT path, line_no, regexp_replace(line, '[^{{}}()]', '', 'g') AS b FROM lines WHERE language <> 'python') WHERE b <> ''))),
nest AS MATERIALIZED (SELECT f.path, coalesce(max(depth), 0) AS depth, coalesce(arg_min(line_no, (-depth, line_no)), 0) AS line_no
 FROM files f LEFT JOIN (SELECT * FROM nest_lines WHERE depth > 0) d ON d.path = f.path GROUP BY f.path)"""
NESTING = """SELECT path, line_no::INTEGER AS line_no, depth::INTEGER AS depth, CASE WHEN depth >= 6 THEN 'CRITICAL' WHEN depth >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 CASE WHEN depth >= 6 THEN 0.9 WHEN depth >= 5 THEN 0.82 ELSE 0.72 END::DOUBLE AS confidence FROM nest WHERE depth >= 4"""

NORMAL_CTE = f"""normal AS MATERIALIZED (
SELECT path, row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS i, count(*) OVER (PARTITION BY path) AS n,
 regexp_replace(lower({strip('line')}), '\\s+', ' ', 'g') AS norm FROM lines WHERE {strip('line')} <> '' AND NOT {R.comment('statistical')})"""
BLOCKS_CTE = """blk AS MATERIALIZED (
SELECT path, i, n, text, list_distinct(string_split(replace(text, chr(10), ' '), ' ')) AS words FROM (
 SELECT path, i, n, string_agg(norm, chr(10)) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS text FROM normal WHERE n >= 8)
WHERE i <= n - 4),
dups AS MATERIALIZED (
SELECT path, 0 AS kind, i AS seq, min(i) OVER (PARTITION BY path, text) AS a, i AS b, 1.0 AS similarity FROM blk QUALIFY i > a
UNION ALL
SELECT path, 1, a, a, min(b), arg_min(similarity, b) FROM (
 SELECT l.path, l.i AS a, r.i AS b, len(list_intersect(l.words, r.words)) / len(list_distinct(list_concat(l.words, r.words))) AS similarity
 FROM blk l JOIN blk r ON l.path = r.path AND r.i >= l.i + 4 WHERE l.i < l.n - 4 AND r.i < r.n - 4) WHERE similarity >= 0.8 GROUP BY path, a)"""
DUPS = """SELECT path, rank::INTEGER AS rank, (a + 1)::INTEGER AS start_a, (b + 1)::INTEGER AS start_b, round(similarity, 9)::DOUBLE AS similarity,
 CASE WHEN similarity >= 0.9 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(similarity * 0.85, 9)::DOUBLE AS confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY path ORDER BY kind, seq) AS rank FROM dups) WHERE rank <= 5"""
JACCARD = """SELECT path, (i + 1)::INTEGER AS line_no, round(shared / (len(x) + len(y) - shared), 9) AS similarity FROM (
 SELECT path, i, x, y, len(list_intersect(x, y)) AS shared FROM (
  SELECT path, i, list_distinct(string_split(norm, ' ')) AS x, list_distinct(string_split(lead(norm) OVER (PARTITION BY path ORDER BY i), ' ')) AS y
  FROM normal WHERE n >= 8) WHERE y IS NOT NULL) WHERE shared > 0"""

DEF = q(G.PYTHON_DEF)
SEGMENT_CTE = f"""seg AS MATERIALIZED (
SELECT *, regexp_matches(line, {DEF}) AS is_def, sum(regexp_matches(line, {DEF})::INTEGER) OVER (PARTITION BY path ORDER BY line_no) AS seg FROM lines)"""


def _count(line: str, word: str) -> str:
    return f"((len({line}) - len(replace({line}, {q(word)}, ''))) // {len(word)})"


def _decisions() -> str:
    total = lambda keys: " + ".join(f"least(3, {_count('lower(line)', k)})" for k in keys)
    return (f"CASE WHEN language IN ('javascript', 'typescript', 'java') THEN {total(G.DECISION_WORDS['javascript'])} "
            f"ELSE {total(G.DECISION_WORDS['python'])} END")


LINE_COMPLEXITY_CTE = f"""line_complexity AS MATERIALIZED (
SELECT path, min(line_no) AS line_no, min(CASE WHEN is_def THEN regexp_extract(line, {DEF}, 1) END) AS name,
 1 + sum(CASE WHEN is_def THEN 0 ELSE {_decisions()} END) AS complexity FROM seg WHERE seg > 0 GROUP BY path, seg)"""
CYCLOMATIC = """SELECT path, line_no::INTEGER AS line_no, name, complexity::INTEGER AS complexity,
 CASE WHEN complexity > 20 THEN 'CRITICAL' WHEN complexity > 15 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 CASE WHEN complexity > 20 THEN 0.92 WHEN complexity > 15 THEN 0.85 ELSE 0.75 END::DOUBLE AS confidence FROM line_complexity WHERE complexity > 10"""

COGNITIVE_CTE = f"""cog_lines AS (
SELECT *, CASE WHEN starts_with(txt, 'if ') AND NOT contains(txt, 'else') OR regexp_matches(txt, '^(for\\s+|while\\s+|try\\s*:)') THEN 1 ELSE 0 END AS up,
 CASE WHEN regexp_matches(txt, '^(return|break|continue|raise)') THEN 1 ELSE 0 END AS down,
 CASE WHEN regexp_matches(txt, '^(elif\\s+|else\\s*:|except\\s+)') THEN 1 ELSE 0 END
 + {R.count('txt', r'\b(and|or|&&|\|\|)\b')}
 + CASE WHEN name IS NOT NULL AND list_contains(regexp_extract_all(txt, '([\\p{{L}}\\p{{N}}_]+)\\s*\\(', 1), name) THEN 1 ELSE 0 END
 + greatest({_count('txt', ' if ')} + {_count('txt', '?')} - 1, 0) AS points FROM (
 SELECT path, line_no, seg, {strip('line')} AS txt, first_value(CASE WHEN is_def THEN regexp_extract(line, {DEF}, 1) END) OVER (PARTITION BY path, seg ORDER BY line_no) AS name FROM seg)),
cog_walk AS (SELECT *, coalesce(s - least(0, min(s) OVER (PARTITION BY path, seg ORDER BY line_no)), 0) AS after_level FROM (
 SELECT *, sum(up - down) OVER (PARTITION BY path, seg ORDER BY line_no) AS s FROM cog_lines)),
cog AS MATERIALIZED (SELECT path, seg, min(line_no) AS start_line, any_value(name) AS name, sum(points + up * (before_level + 1)) AS score FROM (
 SELECT *, coalesce(lag(after_level) OVER (PARTITION BY path, seg ORDER BY line_no), 0) AS before_level FROM cog_walk) GROUP BY path, seg)"""
COGNITIVE = """SELECT path, total_score::BIGINT AS total_score, CASE WHEN total_score > 40 THEN 'CRITICAL' WHEN total_score > 25 THEN 'HIGH' WHEN total_score > 15 THEN 'MEDIUM' END AS severity,
 CASE WHEN total_score > 40 THEN 0.9 WHEN total_score > 25 THEN 0.82 WHEN total_score > 15 THEN 0.72 END::DOUBLE AS confidence FROM (SELECT path, sum(score) AS total_score FROM cog GROUP BY path)"""
HOTSPOTS = """SELECT path, start_line::INTEGER AS line_no, name, score::INTEGER AS score, rank::INTEGER AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, seg) AS rank FROM cog WHERE name IS NOT NULL AND score > 10) WHERE rank <= 3"""

PARAMETERS = f"""SELECT path, line_no::INTEGER AS line_no, name, n::INTEGER AS n, CASE WHEN n > 7 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 0.78::DOUBLE AS confidence FROM (
 SELECT path, line_no, regexp_extract(line, {DEF}, 1) AS name, len(list_filter(list_transform(string_split(regexp_extract(line, {DEF}, 2), ','), lambda p: {strip('p')}),
  lambda p: p NOT IN ('', 'self', 'cls'))) AS n FROM lines WHERE regexp_matches(line, {DEF})) WHERE n > 5"""

MAINTAIN_CTE = f"""{HALSTEAD_CTE},
mi_parts AS (SELECT path, count(*) FILTER ({strip('line')} <> '') AS loc, count(*) FILTER ({R.comment('statistical')}) AS comment_lines FROM lines GROUP BY path),
mi_rows AS MATERIALIZED (SELECT path, loc, comment_lines, cc, greatest(0, least(100, 171 - 5.2 * ln(greatest(volume, 1)) - 0.23 * cc - 16.2 * ln(greatest(loc, 1))
 + 50 * sin(sqrt(2.4 * (comment_lines / greatest(loc, 1)))))) AS mi FROM mi_parts JOIN halstead_rows USING (path) JOIN (
 SELECT path, greatest(1, {R.count(ascii_words('content'), r'\b(if|elif|for|while|except|and|or)\b')}) AS cc FROM files) USING (path))"""
MAINTAIN = """SELECT path, loc::INTEGER AS loc, comment_lines::INTEGER AS comment_lines, cc::INTEGER AS cc, round(mi, 6) AS mi,
 CASE WHEN mi < 20 THEN 'CRITICAL' WHEN mi < 40 THEN 'HIGH' END AS severity, CASE WHEN mi < 40 THEN round(least(0.85, (40 - mi) / 40 + 0.5), 6) END AS confidence FROM mi_rows"""


def sql() -> dict[str, str]:
    return {
        "ngram_repetition": with_files(NGRAM, WORDS_CTE),
        "ngram_top": with_files(TRIPLES, WORDS_CTE),
        "token_entropy": with_files(ENTROPY, ENTROPY_CTE),
        "halstead": with_files(HALSTEAD, HALSTEAD_CTE),
        "token_diversity": with_lines(DIVERSITY, DIVERSITY_CTE),
        "nesting_depth": with_lines(NESTING, NESTING_CTE),
        "dup_blocks": with_lines(DUPS, NORMAL_CTE, BLOCKS_CTE),
        "jaccard_lines": with_lines(JACCARD, NORMAL_CTE),
        "cyclomatic_regex": with_lines(CYCLOMATIC, SEGMENT_CTE, LINE_COMPLEXITY_CTE),
        "cognitive": with_lines(COGNITIVE, SEGMENT_CTE, COGNITIVE_CTE),
        "cognitive_hotspots": with_lines(HOTSPOTS, SEGMENT_CTE, COGNITIVE_CTE),
        "function_metrics": with_lines(PARAMETERS),
        "maintainability": with_lines(MAINTAIN, MAINTAIN_CTE),
    }
