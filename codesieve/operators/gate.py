"""The rule gate: engines united, duplicates collapsed, one verdict per file."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.literals import lowered, required
from codesieve.functions.text import MARK, escaped, folded, found, matches, replaced, rx
from codesieve.operators import spans, stubs
from codesieve.operators.detect import TextRule, marked_lines, run_text_rules
from codesieve.rulebook import gate as G

#: A quoted literal: escapes skip one character, a newline ends all but backticks.
DATA_STRING = (r'"(?:\\[\s\S]|[^"\\\n])*+(?:"|\\$)?'
               r"|'(?:\\[\s\S]|[^'\\\n])*+(?:'|\\$)?"
               r"|`(?:\\[\s\S]|[^`\\])*+(?:`|\\$)?")
#: Tags the lines of docstrings that hold a trigger word.
TAG = "\x02"
FACTS = ("class", "finding", "soft", "source", "severity", "confidence", "suggestion", "cwe", "engine")
#: Engines in the order of their bits: stub rules, prose and markers, structure, and what knows Python's tokens.
ENGINES = ("stubs", "prose", "structure", "python")
FINDING = ("path", "line_no", "class", "finding", "severity", "source", "confidence", "suggestion", "cwe")


def class_of(kind: Column) -> Column:
    """Failure class by the first prefix that fits."""
    expr = None
    for prefix, number in G.CLASS_BY_PREFIX:
        test = F.startswith(F.lower(kind), F.lit(prefix))
        expr = F.when(test, F.lit(G.CLASSES[number])) if expr is None else expr.when(test, F.lit(G.CLASSES[number]))
    return expr.otherwise(F.lit(G.CLASSES[G.DEFAULT_CLASS]))


def cwe_of(kind: Column) -> Column:
    expr = None
    for prefix, cwe in G.CWE_BY_PREFIX:
        test = F.startswith(F.lower(kind), F.lit(prefix))
        expr = F.when(test, F.lit(cwe)) if expr is None else expr.when(test, F.lit(cwe))
    return expr


def gate_severity(severity: Column, confidence: Column) -> Column:
    """CRITICAL and HIGH are violations, MEDIUM only from 0.85 confidence on."""
    upper = F.upper(severity)
    strict = upper.isin("CRITICAL", "HIGH") | ((upper == "MEDIUM") & (F.coalesce(confidence, F.lit(0.0)) >= 0.85))
    return F.when(strict, F.lit("violation")).otherwise(F.lit("warning"))


def adapt(stub_findings: DataFrame, *keep: str) -> DataFrame:
    """Stub findings in the gate's schema."""
    kind = F.col("pattern_type")
    return stub_findings.select(
        "path", "line_no", class_of(kind).alias("class"), F.col("description").alias("finding"),
        gate_severity(F.col("severity"), F.col("confidence")).alias("severity"),
        F.lit(G.SOURCE_STUBS).alias("source"), F.round("confidence", 2).alias("confidence"),
        F.col("suggestion"), cwe_of(kind).alias("cwe"), *keep)


def _unmark_strings(marked: Column) -> Column:
    """Drop match marks that sit inside quoted literals."""
    outside = F.split(marked, rx(DATA_STRING), -1)
    literals = F.concat(F.array(F.lit("")), matches(marked, DATA_STRING))
    return F.array_join(F.zip_with(literals, outside, lambda lit, out: F.concat(F.translate(lit, MARK, ""), out)), "")


def _facts(rule) -> Column:
    kind, _, severity, cwe, number, message, _ = rule
    return F.struct(F.lit(kind).alias("kind"), F.lit(G.CLASSES[number]).alias("class"),
                    F.lit(message).alias("finding"), F.lit(severity).alias("severity"), F.lit(cwe).alias("cwe"))


def prose_findings(files: DataFrame, rules=G.PROSE_RULES, *keep: str) -> DataFrame:
    """Prose and marker rules; a match inside a quoted literal is data, not a deferral.

    Literals are told by their quotes, line by line; ``collected`` knows Python's longer ones.
    """
    content, low = F.col("content"), F.col("_low")
    files = settled(files.select("path", "language", *keep, escaped(content).alias("content"), folded(content).alias("_low")))
    per_rule = files.select("path", "language", *keep, F.explode(F.array_compact(F.array(*[
        F.when(found(content, rule[6], rule[1], low),
               F.struct(_facts(rule).alias("facts"),
                        _unmark_strings(replaced(content, rule[6], MARK + "$0", rule[1])).alias("text")))
        for rule in rules]))).alias("m"))
    per_line = per_rule.select("path", "language", *keep, "m.facts", F.inline(marked_lines(F.col("m.text"))))
    starts = F.length("marked_line") - F.length(F.translate("marked_line", MARK, ""))
    return per_line.select(
        "path", "language", *keep, "line_no", "facts.*",
        F.explode(F.sequence(F.lit(1), starts)).alias("nth"))


def structural_findings(files: DataFrame) -> DataFrame:
    """Empty bodies, hard-coded returns, empty catches; never suppressed."""
    rules = [TextRule(rule[6], rule[1], _facts(rule)) for rule in G.STRUCTURAL_RULES]
    return run_text_rules(files, rules, "path", "language")


def as_gate(rows: DataFrame) -> DataFrame:
    return rows.select("path", "line_no", "class", "finding", "severity", F.lit(G.SOURCE_PROSE).alias("source"),
                       F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("suggestion"),
                       "cwe")


def deduplicate(findings: DataFrame) -> DataFrame:
    """One finding per (path, line, class, text); a violation beats a warning.

    A struct minimum keeps the winner and combines on the map side, which a
    ranking window would not.
    """
    rank = F.struct((F.col("severity") != "violation").alias("soft"), F.col("source").alias("source"),
                    F.col("severity"), F.col("confidence"), F.col("suggestion"), F.col("cwe"))
    best = findings.groupBy("path", "line_no", "class", "finding").agg(F.min(rank).alias("b"))
    return best.select("path", "line_no", "class", "finding", "b.severity", "b.source", "b.confidence",
                       "b.suggestion", "b.cwe")


def verdict_of(violations: Column, warnings: Column) -> Column:
    return F.when(violations > 0, F.lit("FAIL")).when(warnings > 0, F.lit("REVIEW")).otherwise(F.lit("PASS"))


def verdicts(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per file, files without findings included (one exchange)."""
    flags = findings.select("path", (F.col("severity") == "violation").cast("int").alias("v"),
                            (F.col("severity") == "warning").cast("int").alias("w"))
    zero = files.select("path", F.lit(0).alias("v"), F.lit(0).alias("w"))
    totals = zero.unionByName(flags).groupBy("path").agg(F.sum("v").alias("violations"), F.sum("w").alias("warnings"))
    return totals.withColumn("verdict", verdict_of(F.col("violations"), F.col("warnings")))


ENGINE_OF = {"prose": "prose", "marker": "prose", "structure": "structure", "typed_except": "python"}


class GateRule(NamedTuple):
    """A pattern with the finding it stands for, in the order of FACTS; ``kind`` tells how its matches may be suppressed."""

    pattern: str
    flags: str
    kind: str
    facts: tuple


def _by_prefix(kind: str, table, default=None):
    return next((value for prefix, value in table if kind.lower().startswith(prefix)), default)


def gate_rules(python_spans: bool = True) -> list[GateRule]:
    """All engines' rules in the gate's terms."""
    rules = []
    for fam in stubs.S.FAMILIES:
        for rule in fam:
            kind = stubs.pattern_type(fam, rule)
            strict = rule.severity in ("CRITICAL", "HIGH") or (rule.severity == "MEDIUM" and rule.confidence >= 0.85)
            rules.append(GateRule(rule.pattern, fam.flags, kind, (
                G.CLASSES[_by_prefix(kind, G.CLASS_BY_PREFIX, G.DEFAULT_CLASS)], stubs.description(fam, rule), not strict, G.SOURCE_STUBS,
                "violation" if strict else "warning", round(rule.confidence, 2), fam.facts["suggestion"], _by_prefix(kind, G.CWE_BY_PREFIX), ENGINES.index("stubs"))))
    more = (G.TYPED_EXCEPT,) if python_spans else ()
    for kind, flags, severity, cwe, number, message, pattern in (*G.PROSE_RULES, *G.STRUCTURAL_RULES, *more):
        rules.append(GateRule(pattern, flags, kind, (G.CLASSES[number], message, severity != "violation", G.SOURCE_PROSE, severity, None, None, cwe,
                                                     ENGINES.index(ENGINE_OF[kind]))))
    return rules


FACT_TYPES = ("string", "string", "boolean", "string", "string", "double", "string", "string", "int")


def _text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _facts_table(rules: list[GateRule]) -> Column:
    """All rules' facts as one constant array of structs."""
    def sql(value, kind: str) -> str:
        plain = "null" if value is None else _text(value) if kind == "string" else str(value).lower()
        return f"cast({plain} as {kind})"
    structs = [", ".join(f"'{name}', {sql(value, kind)}" for name, value, kind in zip(FACTS, rule.facts, FACT_TYPES)) for rule in rules]
    return F.expr("array(" + ", ".join(f"named_struct({x})" for x in structs) + ")")


# The rules' expressions are written as SQL: one text is parsed once, where columns would take a call for every node.
_LINES = f"filter(transform(split({{0}}, '\\n', -1), (l, i) -> named_struct('line_no', i + 1, 'line', l)), s -> contains(s.line, {_text(MARK)}){{1}})"
_COMMENT = "coalesce(regexp_like({0}, " + _text(rx(r"#\s*\S")) + "), false)"
#: Marked lines without a comment on them or on the next one.
_UNEXPLAINED = ("transform(array(split({0}, '\\n', -1)), r -> filter(transform(r, (l, i) -> named_struct('line_no', i + 1, 'line', l, 'next', get(r, i + 1))), "
                f"s -> contains(s.line, {_text(MARK)}) and not {_COMMENT.format('s.line')} and not {_COMMENT.format('s.next')}))[0]")
#: Marks inside quoted literals dropped.
_QUOTED = (f"array_join(zip_with(concat(array(''), regexp_extract_all({{0}}, {_text(rx(DATA_STRING))}, 0)), split({{0}}, {_text(rx(DATA_STRING))}, -1), "
           f"(q, o) -> concat(translate(q, {_text(MARK)}, ''), o)), '')")
#: The text with another form of each Python token t of kind k.
_RETOLD = ("array_join(zip_with(split({0}, {token}, -1), zip_with(regexp_extract_all({0}, {token}, 0), _kinds, (t, k) -> {1}), "
           "(o, t) -> concat(coalesce(o, ''), coalesce(t, ''))), '')")
_TOKEN = _text(rx(spans.TOKEN))
_DATA_DROPPED = f"case when k = {_text(spans.STRING)} then translate(t, {_text(MARK)}, '') else t end"
_TAGGED = (f"case when k = {_text(spans.DOCSTRING)} and regexp_like(t, {_text(rx(G.DOCSTRING_TRIGGER, 'i'))}) "
           f"then concat({_text(TAG)}, replace(t, '\\n', {_text(chr(10) + TAG)})) else t end")


def _hits(number: int, rule: GateRule, python_spans: bool) -> str:
    """SQL: the lines on which a rule's matches begin, with the rule's number; null when there are none."""
    pattern = _text(rx(rule.pattern, rule.flags))
    fold, needed = required(rule.pattern, rule.flags)
    tests = [f"contains({'_low' if fold else 'content'}, {_text(n)})" for n in needed] + [f"regexp_like(content, {pattern})"]
    plain = lowered(rule.pattern, rule.flags)
    if plain is not None:  # finds what the pattern finds, and a text without a match gets no mark
        tests[-1] = f"regexp_like(_low, {_text(rx(*plain))})"
    lines_of = lambda text, more="": _LINES.replace("{0}", text).replace("{1}", more)
    retold = lambda change: _RETOLD.replace("{0}", "m").replace("{token}", _TOKEN).replace("{1}", change)
    lines = lines_of("m")
    if rule.kind in G.SUPPRESSIBLE:
        lines = lines_of(_QUOTED.replace("{0}", "m"))
        if python_spans:
            lines = f"case when _python then {lines_of(retold(_DATA_DROPPED))} else {lines} end"
    elif rule.kind == G.DOCSTRING_RULE and python_spans:
        lines = f"case when _python then {lines_of(retold(_TAGGED), f' and contains(s.line, {_text(TAG)})')} else {lines} end"
    elif rule.kind == G.TYPED_EXCEPT[0]:
        lines, tests = _UNEXPLAINED.replace("{0}", "m"), ["_python", *tests]
    if rule.kind == stubs.S.MOCK_NAME.rules[0].name:
        tests.append("not _test")
    marked = f"regexp_replace(content, {pattern}, {_text(MARK + '$0')})"
    # The lambda computes the marked text once.
    return f"case when {' and '.join(tests)} then transform(array({marked}), m -> transform({lines}, x -> named_struct('line_no', x.line_no, 'rule', {number})))[0] end"


def collected(files: DataFrame, *keep: str, rules: list[GateRule] | None = None, python_spans: bool = True) -> DataFrame:
    """``(path, language, keep..., found, used, fires, fails)``: each file's findings as one sorted array, collapsed in its row.

    No row leaves its task: the engines share one reading of the text, and a violation beats a warning because it sorts
    first among equal (line, class, finding). With ``python_spans`` a marker rule's match inside a Python string is data,
    a docstring rule's hit counts only on a line of a real docstring that holds a trigger, and an ``except`` of a named
    exception that only passes is reported unless a comment on its line or the next explains it; without, strings are told
    by quotes for every language. Null or empty content has no findings; a repeated row is judged again. ``used``, ``fires``
    and ``fails`` are bit masks of ENGINES: those that look at the file, that find something, that find a violation.
    """
    content, python = F.col("content"), F.col("_python")
    rows = settled(files.select("path", "language", *keep, escaped(F.coalesce("content", F.lit(""))).alias("content")))
    python_text = F.coalesce(spans.is_python(F.col("language"), content), F.lit(False)) if python_spans else F.lit(False)
    rows = settled(rows.withColumns({"_low": folded(content), "_python": python_text, "_test": stubs.reads_like_a_test(content)}))
    if python_spans:
        rows = settled(rows.withColumn("_kinds", F.when(python, spans.token_kinds(content))))

    rules = gate_rules(python_spans) if rules is None else rules

    every = F.expr("flatten(array_compact(array(" + ", ".join(_hits(n, rule, python_spans) for n, rule in enumerate(rules)) + ")))")
    table = _facts_table(rules)
    every = F.transform(every, lambda h: F.get(F.transform(F.array(F.get(table, h["rule"])), lambda t: F.struct(h["line_no"].alias("line_no"), *[t[f].alias(f) for f in FACTS])), 0))
    used = F.lit(2 ** (len(ENGINES) - 1) - 1) + F.when(python, F.lit(2 ** (len(ENGINES) - 1))).otherwise(F.lit(0))
    rows = settled(rows.select("path", "language", *keep, used.alias("used"), F.array_sort(every).alias("_every")))
    same = lambda a, b: (a["line_no"] == b["line_no"]) & (a["class"] == b["class"]) & (a["finding"] == b["finding"])
    first = F.filter("_every", lambda f, i: (i == 0) | ~same(f, F.get("_every", i - 1)))
    mask = lambda rows_: F.aggregate(rows_, F.lit(0), lambda bits, f: bits.bitwiseOR(F.element_at(F.array(*[F.lit(1 << k) for k in range(len(ENGINES))]), f["engine"] + 1)))
    return settled(rows.select("path", "language", *keep, first.alias("found"), "used", mask("_every").alias("fires"),
                               mask(F.filter("_every", lambda f: ~f["soft"])).alias("fails")))


def engine_names(mask: Column) -> Column:
    """The engines of a bit mask, in order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, F.lit(name)) for k, name in enumerate(ENGINES)])), ",")


def rule_benchmark(files: DataFrame) -> DataFrame:
    """How well every set of engines tells files with a true ``expected`` (they should fail) from the others.

    One pass gives each file the mask of engines that fail it; files of equal masks are counted first, so all 2^k - 1 sets
    are scored from at most 2^(k + 1) rows. Columns: engines, n_files, caught, missed, false_alarms, passed, correct_pct.
    """
    counts = collected(files.where("expected is not null"), "expected").groupBy("expected", "fails").agg(F.count("*").alias("n"))
    sets = counts.select("*", F.explode(F.sequence(F.lit(1), F.lit((1 << len(ENGINES)) - 1))).alias("set"))
    flagged = F.col("fails").bitwiseAND(F.col("set")) != 0
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    scores = sets.groupBy("set").agg(
        F.sum("n").alias("n_files"), total(F.col("expected") & flagged).alias("caught"), total(F.col("expected") & ~flagged).alias("missed"),
        total(~F.col("expected") & flagged).alias("false_alarms"), total(~F.col("expected") & ~flagged).alias("passed"))
    return scores.select(engine_names(F.col("set")).alias("engines"), "n_files", "caught", "missed", "false_alarms", "passed",
                         F.round(100 * (F.col("caught") + F.col("passed")) / F.col("n_files"), 6).alias("correct_pct"))


def listed(rows: DataFrame, *keep: str) -> DataFrame:
    """Findings of ``collected`` as rows."""
    return rows.select("path", *keep, F.inline("found")).select(*FINDING, *keep)


def counted(rows: DataFrame, *keep: str) -> DataFrame:
    """Violations, warnings and verdict of each ``collected`` row; nothing is shuffled."""
    n = lambda soft: F.size(F.filter("found", lambda f: f["soft"] == F.lit(soft))).cast("long")
    totals = rows.select("path", *keep, n(False).alias("violations"), n(True).alias("warnings"))
    return totals.withColumn("verdict", verdict_of(F.col("violations"), F.col("warnings")))


def text_findings(files: DataFrame) -> DataFrame:
    """The engines united and collapsed, strings told by quotes alone."""
    return listed(collected(files, python_spans=False))


def text_verdicts(files: DataFrame) -> DataFrame:
    return counted(collected(files, python_spans=False))


def findings(files: DataFrame) -> DataFrame:
    """The whole gate, with Python's strings, docstrings and comments told apart."""
    return listed(collected(files))


def file_verdicts(files: DataFrame) -> DataFrame:
    return counted(collected(files))
