"""SQL twins of the findings algebra and the confidences."""

from __future__ import annotations

from codesieve.operators import scoring
from codesieve.plans.oracle import design as OD
from codesieve.plans.oracle import gate as OG
from codesieve.plans.oracle import metrics as OM
from codesieve.plans.oracle import naming as ON
from codesieve.plans.oracle import security as OS
from codesieve.plans.oracle import wording as OW
from codesieve.plans.oracle.sources import q, with_lines

SEC_CTE = f"sec AS MATERIALIZED ({OS.all_families()})"
STUB_CTE = f"stub_rows AS MATERIALIZED ({OG.stub_select()})"
ISSUES_CTE = f"""issues AS MATERIALIZED (SELECT path, 'security' AS analyzer, line_no, finding_type AS kind, severity, confidence, rule AS message, suggestion FROM sec
UNION ALL SELECT path, 'mock', line_no, pattern_type, severity, confidence, description, suggestion FROM stub_rows
UNION ALL SELECT path, 'antipattern', line_no::INTEGER, antipattern, severity, confidence, subcategory, '' FROM ({OD.anti_all()}))"""
RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
SIZES_CTE = "sizes AS MATERIALIZED (SELECT path, count(*) AS total_lines FROM lines GROUP BY path)"
ev = lambda inner, severity="severity", confidence="confidence", where="true": f"SELECT path, {severity} AS severity, ({confidence})::DOUBLE AS confidence FROM ({inner}) WHERE {where}"
FLAGGED = {"where": "severity IS NOT NULL"}

EVIDENCE = {
    "security": ((SEC_CTE,), [ev("SELECT * FROM sec")]),
    "mock": ((STUB_CTE,), [ev("SELECT * FROM stub_rows")]),
    "antipattern": ((), [ev(OD.anti_all())]),
    "architectural": ((OD.CLASSES_CTE, OD.IMPORTS_CTE), [ev(OD.arch_all())]),
    "semantic": ((OW.DOCSTRING_CTE,), [ev(OW.QUALITY), ev(OW.STYLE), ev(OW.NAMING), ev(OW.DOCSTRING), ev(OW.VOCAB, **FLAGGED),
                                      ev(OW.formality("files", "path", "content"), "'MEDIUM'", "score", "high")]),
    "comment": ((OW.COMMENTS_CTE, OW.TOTALS_CTE), [ev(x) for x in (OW.PHRASES, OW.OBVIOUS, OW.RATIO, OW.LENGTH, OW.FILLER, OW.REDUNDANT)]),
    "pattern": ((ON.MASKED_CTE, ON.NAMES_CTE, OM.WORDS_CTE, OM.ENTROPY_CTE),
                [*[ev(x) for x in (ON.GENERIC, ON.OVERUSE, ON.PHRASES, ON.SHARE, ON.TRAPS, ON.NUMBERS, ON.WIDE, ON.LONG)],
                 ev(OM.NGRAM, **FLAGGED), ev(OM.ENTROPY, **FLAGGED)]),
    "statistical": ((OM.MAINTAIN_CTE, OM.DIVERSITY_CTE, OM.NESTING_CTE, OM.NORMAL_CTE, OM.BLOCKS_CTE, OM.SEGMENT_CTE, OM.LINE_COMPLEXITY_CTE, OM.COGNITIVE_CTE),
                    [ev(OM.CYCLOMATIC), ev(OM.COGNITIVE, **FLAGGED), ev(OM.HOTSPOTS, "'HIGH'", "0.75"),
                     ev("SELECT * FROM halstead_rows", "'HIGH'", "least(0.85, volume / 2000)", "volume > 1000"),
                     ev("SELECT * FROM halstead_rows", "'HIGH'", "least(0.85, difficulty / 60)", "difficulty > 30"),
                     ev("SELECT * FROM halstead_rows", "CASE WHEN bugs > 2 THEN 'HIGH' ELSE 'MEDIUM' END", "least(0.8, bugs / 3)", "bugs > 1"),
                     ev(OM.DIVERSITY, **FLAGGED), ev(OM.NESTING), ev(OM.DUPS), ev(OM.PARAMETERS), ev(OM.MAINTAIN, **FLAGGED)]),
}


def score_ctes(analyzer: str) -> list[str]:
    """CTEs ending in ``score_<analyzer>(path, score)``."""
    if analyzer == "emoji":
        return [OD.EMOJI_CTE, OD.EMO_METRICS_CTE, "score_emoji AS (SELECT path, coalesce(confidence, 0)::DOUBLE AS score, coalesce(emojis, 0) AS n FROM files LEFT JOIN emo_conf USING (path))"]
    ctes, parts = EVIDENCE[analyzer]
    c, h, m, low = scoring.WEIGHTS[analyzer]
    totals = f"""tot_{analyzer} AS (SELECT s.path, total_lines, coalesce(w, 0) AS w, coalesce(n, 0) AS n FROM sizes s LEFT JOIN (
 SELECT path, count(*) AS n, sum(round(confidence * CASE severity WHEN 'CRITICAL' THEN {c} WHEN 'HIGH' THEN {h} WHEN 'MEDIUM' THEN {m} WHEN 'LOW' THEN {low} END * 1e9)::BIGINT) / 1e9 AS w FROM ({' UNION ALL '.join(parts)}) GROUP BY path) e ON e.path = s.path)"""
    source, score = f"tot_{analyzer}", ""
    if analyzer == "pattern":
        source = "(SELECT t.*, g.score AS r, e.entropy FROM tot_pattern t JOIN gram_scores g USING (path) JOIN entropies e USING (path))"
        score = """CASE WHEN n = 0 THEN CASE WHEN r < 0.3 AND entropy > 4 THEN 0 ELSE 0.05 END ELSE least(0.95, least(0.9, w + CASE WHEN r > 0.3 THEN (r - 0.3) * 0.3 ELSE 0 END
 + CASE WHEN entropy < 4 THEN (4 - entropy) / 4 * 0.2 ELSE 0 END) + least(0.4, n * 0.12)) * CASE WHEN total_lines < 5 THEN 0.85 ELSE 1 END END"""
    elif analyzer == "architectural":
        source = """(SELECT t.*, coalesce(c.classes, 0) AS classes FROM tot_architectural t LEFT JOIN (SELECT path, count(*) AS classes FROM class_m GROUP BY path
 UNION ALL SELECT path, len(regexp_extract_all(content, '(?m)^class\\s+\\w+')) FROM files WHERE language IN ('javascript', 'typescript')) c USING (path))"""
        score = "least(0.88, w / greatest(1, total_lines / 100 + classes))"
    elif analyzer == "comment":
        source = "(SELECT t.*, coalesce(c.comments, 0) AS comments FROM tot_comment t LEFT JOIN (SELECT path, count(*) AS comments FROM coms GROUP BY path) c USING (path))"
        score = "CASE WHEN n = 0 THEN 0 ELSE least(0.95, w * least(1, n / greatest(1, comments) * 2) + n * 0.05) END"
    elif analyzer == "mock":
        score = "CASE WHEN n = 0 THEN 0 ELSE least(1, w / n * 0.6 + least(1, n / 10) * 0.25 + least(1, n / greatest(total_lines, 1) * 100 / 5) * 0.15) END"
    else:
        size, cap = {"statistical": (25, 0.92), "security": (15, 0.95), "semantic": (20, 0.88), "antipattern": (100, 0.92)}[analyzer]
        score = f"least({cap}, w / greatest(1, total_lines / {size}))"
    return [*ctes, totals, f"score_{analyzer} AS MATERIALIZED (SELECT path, ({score})::DOUBLE AS score, n FROM {source})"]


def all_scores(analyzers) -> list[str]:
    out = [SIZES_CTE]
    for a in analyzers:
        out += [c for c in score_ctes(a) if c not in out]
    return out


def sql() -> dict[str, str]:
    from codesieve.operators.detectors import QUICK
    from codesieve.plans.score_queries import REPORTED, SCAN_WEIGHTS, THRESHOLD

    level = lambda s: f"CASE WHEN {s} < 0.2 THEN 'none' WHEN {s} < 0.4 THEN 'low' WHEN {s} < 0.6 THEN 'medium' WHEN {s} < 0.8 THEN 'high' ELSE 'very_high' END"
    total_w = sum(SCAN_WEIGHTS.values())
    overall = all_scores(SCAN_WEIGHTS) + ["overall AS MATERIALIZED (SELECT *, " + level("confidence") + " AS level FROM (SELECT path, least(1, ("
              + " + ".join(f"round(score_{a}.score * {w} * 1e9)::BIGINT" for a, w in SCAN_WEIGHTS.items()) + f") / 1e9 / {total_w}) AS confidence, " + " + ".join(f"score_{a}.n" for a in SCAN_WEIGHTS) + " AS patterns FROM files "
              + " ".join(f"JOIN score_{a} USING (path)" for a in SCAN_WEIGHTS) + "))"]
    summary = f"""summary AS (SELECT files, reported, generated, critical_files, patterns, round(generated / files * 100, 6) AS generated_pct, round(mean, 6) AS confidence, {level('mean')} AS level, round(patterns / files, 6) AS per_file, high_risk_files FROM (
 SELECT count(*) AS files, count(*) FILTER (confidence >= {THRESHOLD}) AS reported, count(*) FILTER (confidence >= 0.4) AS generated, count(*) FILTER (confidence >= 0.6) AS critical_files,
 coalesce(sum(round(confidence * 1e9)::BIGINT) FILTER (confidence >= {THRESHOLD}) / (count(*) FILTER (confidence >= {THRESHOLD}) * 1e9), 0) AS mean, sum(patterns)::BIGINT AS patterns, count(*) FILTER (level IN ('high', 'very_high')) AS high_risk_files FROM overall))"""
    risk = "CASE WHEN s >= 0.75 THEN 'CRITICAL' WHEN s >= 0.55 THEN 'HIGH' WHEN s >= 0.35 THEN 'MEDIUM' WHEN s >= 0.15 THEN 'LOW' ELSE 'MINIMAL' END"
    sec_risk = "CASE WHEN s >= 0.7 THEN 'CRITICAL' WHEN s >= 0.5 THEN 'HIGH' WHEN s >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END"
    project = lambda s: f"CASE WHEN {s} < 0.3 THEN 'low' WHEN {s} < 0.5 THEN 'medium' WHEN {s} < 0.7 THEN 'high' ELSE 'critical' END"
    report = REPORTED
    mean = lambda c: f"(sum(round({c} * 1e9)::BIGINT) / (count(*) * 1e9))"
    weighted = scoring.REPORT_WEIGHTS
    quick = "least(1, (" + " + ".join(f"round(score_{a}.score * {SCAN_WEIGHTS[a]} * 1e9)::BIGINT" for a in QUICK) + f") / 1e9 / {sum(SCAN_WEIGHTS[a] for a in QUICK)})"
    report_sum = "((" + " + ".join(f"round(score_{a}.score * {w} * 1e9)::BIGINT" for a, w in weighted.items()) + ") / 1e9)"
    joined = " ".join(f"JOIN score_{a} USING (path)" for a in weighted)
    overall_mean = "((" + " + ".join(f"round(round((SELECT {mean('score')} FROM score_{a}), 9) * {w} * 1e9)::BIGINT" for a, w in weighted.items()) + ") / 1e9)"
    pick = "path, analyzer, line_no, kind, severity, confidence, message, suggestion"
    first = lambda severity: f"SELECT {pick} FROM issues WHERE severity = '{severity}' ORDER BY confidence DESC, path, line_no, analyzer, kind, message LIMIT 20"
    txt = lambda x: f"to_json({x})::VARCHAR"
    num = lambda x: f"{x}::VARCHAR"
    obj = lambda *pairs: "'{' || " + " || ',' || ".join(f"'\"{n}\":' || {v}" for n, v in pairs) + " || '}'"
    agg = lambda what, order: f"'[' || coalesce(string_agg({what}, ',' ORDER BY {order}), '') || ']'"
    listed = lambda severity: f"""SELECT {agg(obj(('path', txt('path')), ('line_no', num('line_no')), ('analyzer', txt('analyzer')), ('kind', txt('kind')), ('message', txt('message')), ('confidence', num('confidence'))),
     'confidence DESC, path, line_no, analyzer, kind, message')} FROM ({first(severity)})"""
    n_of = lambda severity: f"(SELECT count(*) FROM issues WHERE severity = '{severity}')"
    scored = " UNION ALL ".join(f"SELECT {q(a)} AS analyzer, round(round({mean('score')}, 9), 6) AS average, round(min(score), 6) AS low, round(max(score), 6) AS high, {w}::DOUBLE AS weight FROM score_{a}" for a, w in weighted.items())
    batch = f"""SELECT 'summary' AS section, 1 AS "order", {obj(('total_files', "(SELECT count(*) FROM files)"), ('total_lines', "(SELECT count(*) FROM lines)"), ('languages', f"(SELECT {agg(obj(('language', txt('language')), ('n', num('n'))), 'language')} FROM (SELECT language, count(*) AS n FROM files GROUP BY language))"),
      ('overall_confidence', num('round(o, 6)')), ('risk_level', txt(risk.replace('WHEN s', 'WHEN o'))))} AS body FROM (SELECT {overall_mean} AS o)
UNION ALL SELECT 'analyzer_scores', 2, {agg(obj(('analyzer', txt('analyzer')), ('average', num('average')), ('low', num('low')), ('high', num('high')), ('weight', num('weight'))), 'analyzer')} FROM ({scored})
UNION ALL SELECT 'antipattern_summary', 3, {agg(obj(('kind', txt('kind')), ('n', num('n'))), 'kind')} FROM (SELECT kind, count(*) AS n FROM issues WHERE analyzer = 'antipattern' GROUP BY kind)
UNION ALL SELECT 'critical_issues', 4, ({listed('CRITICAL')}) UNION ALL SELECT 'high_issues', 5, ({listed('HIGH')})
UNION ALL SELECT 'recommendations', 6, '[' || array_to_string(list_transform(CASE WHEN len(t) > 0 THEN t ELSE ['Nothing pressing was found'] END, lambda x: to_json(x)::VARCHAR), ',') || ']' FROM (SELECT list_filter([
 CASE WHEN {n_of('CRITICAL')} > 0 THEN 'Mend the ' || {n_of('CRITICAL')} || ' critical issue(s) first' END, CASE WHEN {n_of('HIGH')} > 10 THEN 'Plan time for the issues of high severity' END,
 CASE WHEN (SELECT count(*) FROM issues WHERE analyzer = 'antipattern') > 0 THEN 'Look at the antipatterns, the commonest first' END, CASE WHEN {overall_mean} >= 0.55 THEN 'Have a second person read the files of high confidence' END], lambda x: x IS NOT NULL) AS t)"""
    files_report = f"SELECT path, language, total_lines AS lines_of_code, {report_sum} AS s FROM files JOIN sizes USING (path) {joined}"
    out = {
        "count_by_type": with_lines("SELECT finding_type, severity, count(*) AS n FROM sec GROUP BY 1, 2", SEC_CTE),
        "cwe_distribution": with_lines("SELECT cwe, owasp, count(*) AS n FROM sec GROUP BY 1, 2", SEC_CTE),
        "findings_grouping_sets": with_lines("SELECT finding_type, severity, cwe, count(*) AS n FROM sec GROUP BY GROUPING SETS ((finding_type), (severity), (cwe))", SEC_CTE),
        "mock_summary": with_lines("SELECT path, split_part(pattern_type, '_', 1) AS category, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM stub_rows GROUP BY 1, 2", STUB_CTE),
        "top_per_file": with_lines(f"SELECT path, line_no, finding_type, severity, confidence, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {RANK}, confidence DESC, line_no, finding_type) AS rank FROM sec) WHERE rank <= 5", SEC_CTE),
        "top_issues": with_lines(f"SELECT path, line_no, finding_type, severity, confidence FROM sec ORDER BY {RANK}, confidence DESC, path, line_no, finding_type LIMIT 20", SEC_CTE),
        "severity_bridge": with_lines(f"SELECT severity, confidence, count(*) AS n, {OG.SEVERITY_CASE} AS gate_severity FROM stub_rows GROUP BY 1, 2", STUB_CTE),
        "explain_file": with_lines("SELECT path, finding_type, count(*) AS n, array_to_string(list(line_no ORDER BY line_no)[1:3], ',') AS examples FROM sec GROUP BY 1, 2", SEC_CTE),
        "antipattern_categories": with_lines(f"SELECT antipattern, category, severity, count(*) AS n FROM ({OD.anti_all()}) GROUP BY 1, 2, 3"),
        "confidence_bins": with_lines(f"SELECT {level('s')} AS level, {risk} AS risk, {sec_risk} AS security_risk, {project('s')} AS project_risk, count(*) AS n FROM (SELECT round(score, 9) AS s FROM score_security) GROUP BY 1, 2, 3, 4", *all_scores(("security",))),
        "report_scores": with_lines(" UNION ALL ".join(f"SELECT {q(a)} AS analyzer, round({mean('score')}, 9) AS average, round(min(score), 9) AS low, round(max(score), 9) AS high, {scoring.REPORT_WEIGHTS.get(a, 0.0)}::DOUBLE AS weight FROM score_{a}" for a in report), *all_scores(report)),
        "overall_confidence": with_lines("SELECT path, round(confidence, 6)::DOUBLE AS confidence, level FROM overall", *overall),
        "threshold_filter": with_lines(f"SELECT path, level FROM overall WHERE confidence >= {THRESHOLD}", *overall),
        "quick_scan": with_lines(f"SELECT path, round(s, 6) AS confidence, {level('s')} AS level FROM (SELECT path, {quick} AS s FROM files " + " ".join(f"JOIN score_{a} USING (path)" for a in QUICK) + ")", *all_scores(QUICK)),
        "top_types": with_lines("SELECT analyzer, rank::INTEGER AS rank, kind, n FROM (SELECT analyzer, kind, count(*) AS n, row_number() OVER (PARTITION BY analyzer ORDER BY count(*) DESC, kind) AS rank FROM issues GROUP BY 1, 2) WHERE rank <= 5", SEC_CTE, STUB_CTE, ISSUES_CTE),
        "critical_issues": with_lines(f"SELECT * FROM ({first('CRITICAL')}) UNION ALL SELECT * FROM ({first('HIGH')})", SEC_CTE, STUB_CTE, ISSUES_CTE),
        "severity_totals": with_lines("SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM issues", SEC_CTE, STUB_CTE, ISSUES_CTE),
        "detailed_issues": with_lines("""SELECT i.*, (SELECT string_agg(CASE WHEN l.line_no = i.line_no THEN '>>> ' ELSE '    ' END || lpad(l.line_no::VARCHAR, greatest(4, len(l.line_no::VARCHAR))::INTEGER, ' ') || ' | ' || CASE WHEN EXISTS (SELECT 1 FROM sec WHERE sec.path = l.path AND sec.line_no = l.line_no AND finding_type = 'hardcoded_secret') THEN regexp_replace(l.line, '["''][^"'']*["'']', '***', 'g') ELSE l.line END, chr(10) ORDER BY l.line_no)
 FROM lines l WHERE l.path = i.path AND l.line_no BETWEEN i.line_no - 3 AND i.line_no + 3) AS code_snippet FROM issues i""", SEC_CTE, STUB_CTE, ISSUES_CTE),
        "batch_report": with_lines(batch, SEC_CTE, STUB_CTE, ISSUES_CTE, *[c for c in all_scores(weighted) if c not in (SEC_CTE, STUB_CTE)]),
        "file_reports": with_lines(f"SELECT path, language, lines_of_code::INTEGER AS lines_of_code, round(s, 6) AS confidence, {risk} AS risk FROM ({files_report})", *all_scores(weighted)),
        "executive_summary": with_lines(f"""SELECT {project('confidence')} AS risk, CASE WHEN len(f) = 0 THEN 'PASSED' ELSE 'FAILED' END AS quality_gate, array_to_string(f, ',') AS failures, files, reported, generated, generated_pct, confidence, level, patterns, per_file, high_risk_files, reported AS recommendations
 FROM (SELECT *, list_filter([CASE WHEN confidence > 0.6 THEN 'confidence' END, CASE WHEN generated_pct > 30 THEN 'share' END, CASE WHEN critical_files > 0 THEN 'critical files' END], lambda x: x IS NOT NULL) AS f FROM summary)""", *overall, summary),
        "scan_summary": with_lines("SELECT * FROM summary", *overall, summary),
        "quality_gates": with_lines(f"SELECT array_to_string(f, ',') AS failures, len(f) = 0 AS passed, {project('confidence')} AS risk FROM (SELECT *, list_filter([CASE WHEN confidence > 0.6 THEN 'confidence' END, CASE WHEN generated_pct > 30 THEN 'share' END, CASE WHEN critical_files > 0 THEN 'critical files' END], lambda x: x IS NOT NULL) AS f FROM summary)", *overall, summary),
        "remediation": with_lines("""SELECT path, CASE level WHEN 'very_high' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
 CASE level WHEN 'very_high' THEN 'Have a second person read it line by line|Rewrite the parts nobody can explain|Write down which tools produced it|Cover it with tests' WHEN 'high' THEN 'Have a second person read it|Explain the logic in comments|Try the error paths|Look for security holes' ELSE 'Read it when there is time|Write down which tools helped' END AS actions FROM overall WHERE confidence >= 0.4""", *overall),
    }
    for analyzer in (*scoring.WEIGHTS, "emoji"):
        out[f"confidence_{analyzer}"] = with_lines(f"SELECT path, round(score, 6) AS score FROM score_{analyzer}", *all_scores((analyzer,)))
    return out
