"""Registered queries of import verification, corpus lookups, policies and requests."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.text import matches, text_array
from codesieve.operators import corpus, imports, requests
from codesieve.operators.lines import lines
from codesieve.operators.paths import js_package, pep503
from codesieve.rulebook import dependencies as P
from codesieve.sources.diffs import added_lines, file_diffs
from codesieve.sources.python_texts import python_texts
from codesieve.sources.rendered import code_files, diff_texts, policy_texts, rpc_frames
from codesieve.sources.tables import kept

#: A small registry snapshot (offline); a deployment reads its own table.
REGISTRY = [("python", "requests", "exists"), ("python", "numpy", "exists"), ("python", "pyyaml", "exists"),
            ("python", "mysqlclient", "exists"), ("python", "django", "unavailable"), ("npm", "react", "exists"),
            ("npm", "@scope/pkg", "exists")]
EXCLUDE = ("totally_made_up_1*",)
AREA_QUERIES = ["7", "quality", "KA-12", "engineering", "security", "nothing"]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "ecosystem string, name string, status string")


def _diff_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The changes are parsed once; names and modules are both read from the result.
    changed = kept(file_diffs(diff_texts(spark, sf_dir)).select("diff_id", "path", "file_no", "added"), "changes")
    return imports.classify(imports.added_imports(added_lines(changed)), registry(spark), imports.provided_modules(changed),
                            EXCLUDE, keys=("diff_id",))


def _specifiers(files: DataFrame) -> DataFrame:
    forms = F.concat(*[matches(F.col("line"), form, group=1) for form in P.JS_IMPORT_FORMS])
    rows = lines(files.where("language in ('javascript', 'typescript')")).select("path", "line_no", F.explode(forms).alias("spec"))
    return rows.withColumn("package", js_package(F.col("spec")))


def _headings(files: DataFrame) -> DataFrame:
    docs = files.where("language = 'markdown'")
    pick = lambda level: corpus.sections(docs, level).select(
        "path", F.lit(level).alias("level"), "ord", "heading", F.md5("body").alias("body"))
    return pick(2).unionByName(pick(3))


def _areas(files: DataFrame) -> DataFrame:
    docs = files.where("language = 'markdown'")
    asked = docs.select("path", F.element_at(text_array(AREA_QUERIES), (F.floor(F.col("doc_id") / 10) % len(AREA_QUERIES) + 1).cast("int")).alias("query"))
    return corpus.find_area(docs, asked)


SECTION_QUERIES = ["preamble", "hive-mind", "power-of-10", "toc", "full", "nothing", "identity"]


def _lookups(files: DataFrame) -> DataFrame:
    """Three names asked of every markdown file, and one of a file that is no document."""
    docs = files.where("language = 'markdown'")
    picks = F.array(*[F.element_at(text_array(SECTION_QUERIES), ((F.floor(F.col("doc_id") / 10) + k) % len(SECTION_QUERIES) + 1).cast("int")) for k in (0, 1, 3)])
    asked = docs.select("path", F.explode(picks).alias("section"))
    return corpus.look_up(docs, asked.unionByName(docs.where("doc_id % 3 = 0").select(F.concat("path", F.lit("x")).alias("path"), F.lit("toc").alias("section"))))


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "imports_py": lambda s, d: imports.python_imports(code_files(s, d)),
        "imports_js": lambda s, d: imports.script_imports(code_files(s, d)),
        "first_import": lambda s, d: imports.first_imports(code_files(s, d)),
        "pep503": lambda s, d: imports.first_imports(code_files(s, d)).select("path", "name", pep503(F.col("name")).alias("normal")),
        "js_package": lambda s, d: _specifiers(code_files(s, d)),
        "classify_imports": lambda s, d: imports.classify(imports.first_imports(code_files(s, d)), registry(s), exclude=EXCLUDE),
        "diff_imports": _diff_packages,
        "dependency_verdict": lambda s, d: imports.verdicts(_diff_packages(s, d), "diff_id"),
        "split_headings": lambda s, d: _headings(code_files(s, d)),
        "imports_logical": lambda s, d: imports.python_imports(python_texts(s, d)),
        "section_lookup": lambda s, d: _lookups(code_files(s, d)),
        "corpus_lookup": lambda s, d: corpus.find_section(code_files(s, d).where("language = 'markdown'"), "PREAMBLE"),
        "corpus_area": lambda s, d: _areas(code_files(s, d)),
        "rpc_dispatch": lambda s, d: requests.responses(rpc_frames(s, d)),
        "config_validate": lambda s, d: requests.validate_policies(policy_texts(s, d)),
    }
