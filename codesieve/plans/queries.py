"""Registry of queries: key -> builder(spark, sf_dir)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import glob_regex, found, text_array
from codesieve.operators import (antipatterns, architecture, documents, emoji, gate, metrics, naming, parsing, paths,
                                 security, stubs, wording)
from codesieve.operators.lines import COMMENT_PREFIXES, is_comment, lines
from codesieve.operators.lines import masked_lines
from codesieve.plans import file_queries, review_queries, score_queries, service_queries, span_queries
from codesieve.rulebook import security as security_rules
from codesieve.rulebook import stubs as stub_rules
from codesieve.sources.rendered import code_files
from codesieve.sources.tables import table

Builder = Callable[[SparkSession, str], DataFrame]


def on_files(operator: Callable[[DataFrame], DataFrame]) -> Builder:
    return lambda spark, sf_dir: operator(code_files(spark, sf_dir))


def build_registry() -> dict[str, Builder]:
    registry: dict[str, Builder] = {}
    for family in security_rules.FAMILIES:
        registry[f"sec_{family.name}"] = on_files(lambda files, f=family: security.findings(files, (f,)))
    registry["sec_all"] = on_files(security.findings)
    for key, family in STUB_KEYS.items():
        registry[f"mock_{key}"] = on_files(lambda files, f=family: stubs.report(files, (f,)))
    registry["class_by_prefix"] = on_files(_types_by_class)
    registry["gate_adapter"] = on_files(lambda files: gate.adapt(stubs.findings(files)))
    registry["prose_rules"] = on_files(lambda files: _gate_columns(gate.prose_findings(files)))
    registry["structural_rules"] = on_files(lambda files: _gate_columns(gate.structural_findings(files)))
    registry["dedupe_findings"] = on_files(gate.text_findings)
    registry["scan_verdict"] = on_files(gate.text_verdicts)
    registry["docstring_mask"] = on_files(lambda files: masked_lines(files).where("in_docstring").select("path", "line_no"))
    registry["generic_naming"] = on_files(naming.generic_names)
    registry["generic_overuse"] = on_files(naming.name_overuse)
    registry["boolean_traps"] = on_files(naming.boolean_traps)
    registry["magic_numbers"] = on_files(naming.magic_numbers)
    registry["god_functions"] = on_files(naming.god_functions)
    registry["verbose_comments"] = on_files(naming.verbose_comments)
    registry["comment_share"] = on_files(naming.comment_share)
    for key, operator in {**METRICS, **WORDING, **DESIGN, **PARSING}.items():
        registry[key] = on_files(operator)
    registry["com_extract"] = on_files(lambda files: wording.comments(files).select("path", "line_no", "text"))
    registry["formality_turns"] = lambda spark, sf_dir: wording.formality(
        table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), "text"),
        "turn_id", "text")
    registry.update(review_queries.build())
    registry.update(service_queries.build())
    registry.update(score_queries.build())
    registry.update(span_queries.build())
    registry.update(file_queries.build())
    return registry


METRICS = {
    "ngram_repetition": metrics.ngram_repetition, "ngram_top": metrics.repeated_triples,
    "token_entropy": metrics.token_entropy, "halstead": metrics.halstead, "token_diversity": metrics.token_diversity,
    "nesting_depth": metrics.nesting_depth, "dup_blocks": lambda files: metrics.duplicate_blocks(files, top=5),
    "jaccard_lines": metrics.adjacent_similarity, "cyclomatic_regex": metrics.cyclomatic_lines,
    "cognitive": metrics.cognitive, "cognitive_hotspots": metrics.cognitive_hotspots,
    "function_metrics": metrics.function_parameters, "maintainability": metrics.maintainability,
}
WORDING = {
    "sem_comment_quality": wording.comment_quality, "sem_writing_style": wording.writing_style,
    "naming_styles": wording.naming_styles, "sem_docstring": wording.docstring_shapes,
    "vocab_markers": wording.vocabulary, "formality": wording.formality, "com_verbose": wording.comment_phrases,
    "com_obvious": wording.obvious_comments, "comment_metrics": wording.comment_metrics,
    "com_ratio": wording.comment_ratio, "com_length": wording.comment_length, "com_filler": wording.filler_words,
    "redundant_comments": wording.redundant_comments,
}
#: Path shapes derived from each file's path ($), covering every extension rule.
VARIANTS = ["$", "$.m", "$.v", "$.h", "$.PNG", "a/Dockerfile", "b/Makefile", "x/$.min.js", "build/$", "lib.egg-info/$",
            "src/test/$", "$.spec.ts", "pkg/conftest.py", "$_test.go", "q/test_$", "y/.hidden", "$.tar.gz"]
EXCLUDE_GLOBS = ("*.min.js", "docs/*", "src/a?i/*", "*/f[0-4]*.py")
RENAMES = {"data": "payload_rows", "result": "outcome", "temp1": "first_value"}
HINTS = ["JS", " ts ", "c++", "Golang", "rb", "cobol"]
QUOTED_PATHS = ['"a/caf\\303\\251.py"', "plain/$", '"tab\\there"', '"q\\"x\\\\y"', '"\\101bc"', '"', '"un\\qknown"']


def _choose(values: list[str]) -> Column:
    return F.element_at(text_array(values), (F.col("doc_id") % len(values) + 1).cast("int"))


def _variants(files: DataFrame) -> DataFrame:
    return files.select("doc_id", F.replace(_choose(VARIANTS), F.lit("$"), F.col("path")).alias("path"), "content")


def _comment_counts(files: DataFrame) -> DataFrame:
    """How many lines each detector's own rule takes for comments, in one pass."""
    line, language = F.col("line"), F.col("language")
    counts = lines(files).agg(*[F.count_if(is_comment(v, line, language)).alias(v) for v in COMMENT_PREFIXES])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("n")) for v in COMMENT_PREFIXES])))


def _strings_with_data(files: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = lines(files).where(F.contains(line, F.lit("data"))).withColumn("col_no", F.instr(line, "data") - 1)
    return rows.where(naming.in_string(line, F.col("col_no"))).select("path", "line_no", "col_no")


def _eval_snippets(files: DataFrame) -> DataFrame:
    rows = settled(files.select("path", F.split("content", "\n", -1).alias("l")))
    spots = F.filter(F.transform("l", lambda line, i: F.when(F.contains(line, F.lit("eval(")), i + 1)), lambda no: no.isNotNull())
    return rows.select("path", F.inline(F.transform(spots, lambda no: F.struct(no.alias("line_no"), paths.snippet(F.col("l"), no, 2).alias("snippet")))))


PARSING = {
    "regex_functions": parsing.functions, "regex_classes": parsing.classes, "regex_imports": parsing.imports,
    "regex_complexity": parsing.keyword_complexity, "loc_breakdown": parsing.line_kinds, "line_counts": paths.line_counts,
    "comment_lines": _comment_counts,
    "detect_language": lambda files: _variants(files).select("path", paths.detect_language(F.col("path"), F.col("content")).alias("detected")),
    "language_for_path": lambda files: _variants(files).select("path", paths.language_for_path(F.col("path")).alias("language")),
    "is_test_path": lambda files: _variants(files).select("path", paths.is_test_path(F.col("path")).alias("is_test")),
    "glob_exclude": lambda files: _variants(files).where(
        paths.matches_globs(F.col("path"), EXCLUDE_GLOBS) | paths.matches_globs(F.substring_index("path", "/", -1), EXCLUDE_GLOBS)
        | paths.excluded_dir(F.col("path"))).select("path"),
    "glob_match": lambda files: _variants(files).select("path", found(F.col("path"), glob_regex("src/?a?a/*[0-4].py")).alias("matched")),
    "file_filter": lambda files: paths.file_filter(_variants(files), exclude=EXCLUDE_GLOBS).select("path"),
    "normalize_language": lambda files: files.select("path", paths.normalize_language(_choose(HINTS)).alias("canonical")),
    "in_string": _strings_with_data,
    "remove_emojis": lambda files: files.where(found(F.col("content"), emoji.EMOJI_REMOVED)).select(
        "path", F.md5(emoji.remove(F.col("content"))).alias("digest")),
    "rename_identifiers": lambda files: files.select("path", F.md5(paths.rename_identifiers(F.col("content"), RENAMES)).alias("digest")),
    "snippets": _eval_snippets,
    "unquote_path": lambda files: files.select("doc_id", paths.unquote_path(
        F.replace(_choose(QUOTED_PATHS), F.lit("$"), F.col("path"))).alias("plain")),
}
# Lower limits than the defaults make the class rules fire on the derived files.
SMALL_LIMITS = {**architecture.LIMIT, "methods": 1, "attributes": 1, "loc": 8, "imports": 4, "dependencies": 1}
DESIGN = {
    "ant_versions": antipatterns.unstable_versions, "ant_experimental": antipatterns.experimental_apis,
    "ant_magic": antipatterns.domain_numbers, "ant_over_engineering": antipatterns.over_engineering,
    "ant_dead_code": antipatterns.dead_code, "ant_premature": antipatterns.premature_optimization,
    "ant_abstraction": antipatterns.abstraction, "ant_flags": antipatterns.feature_flag_totals,
    "class_metrics": architecture.class_metrics,
    "god_classes": lambda files: architecture.god_classes(files, SMALL_LIMITS),
    "coupling": lambda files: architecture.coupling(files, SMALL_LIMITS),
    "solid_params": architecture.solid_params, "layer_violations": architecture.layer_violations,
    "pattern_misuse": architecture.pattern_misuse, "concrete_deps": architecture.concrete_dependencies,
    "dev_doc_names": documents.by_name, "dev_doc_ignore": documents.ignore_entries, "dev_doc_summary": documents.summary,
    "dev_doc_content": lambda files: documents.content_scores(documents.unnamed(files)),
    "emoji_matches": emoji.emoji_matches, "emoji_categories": emoji.categories, "emoji_clusters": emoji.clusters,
    "emoji_indicators": emoji.indicators, "emoji_metrics": emoji.metrics_report,
}
STUB_KEYS = {"placeholder": stub_rules.PLACEHOLDER, "stub": stub_rules.STUB, "success": stub_rules.ALWAYS_SUCCESS,
             "print": stub_rules.PRINT_ONLY, "fake": stub_rules.FAKE_DATA, "passthrough": stub_rules.PASSTHROUGH,
             "todo": stub_rules.TODO, "names": stub_rules.MOCK_NAME}


def _gate_columns(rows: DataFrame) -> DataFrame:
    return rows.select("path", "line_no", "class", "finding", "severity", "cwe")


def _types_by_class(files: DataFrame) -> DataFrame:
    kind = F.col("pattern_type")
    return stubs.findings(files).groupBy("pattern_type").agg(F.count("*").alias("n")) \
        .select("pattern_type", gate.class_of(kind).alias("class"), gate.cwe_of(kind).alias("cwe"), "n")
