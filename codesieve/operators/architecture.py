"""Classes, imports, layers and design-pattern misuse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import capture, found, hits, indent, lookup, matches, strip
from codesieve.operators.lines import lines
from codesieve.operators.segments import segments
from codesieve.rulebook import design as D
from codesieve.sources.tables import kept

LIMIT = D.ARCHITECTURE_LIMITS


def python_classes(files: DataFrame) -> DataFrame:
    """Size, method, attribute, base and dependency counts of each Python class.

    A class reaches from its header to the next non-blank line that is not
    indented deeper than the header (headers sit at column 0).
    """
    start = lambda line: found(line, D.PYTHON_CLASS)
    cut = segments(files.where("language = 'python'"), start).where(start(F.element_at("lines", 1)))
    head = F.element_at("lines", 1)
    body = F.expr("slice(lines, 2, size(lines))")
    ends = F.transform(body, lambda l: (F.length(strip(l)) > 0) & (indent(l) <= 0))
    stop = F.array_position(ends, True)
    rows = settled(cut.select(
        "path", "start_line", head.alias("head"), body.alias("body"), stop.alias("stop")))
    inside = F.when(F.col("stop") > 0, F.expr("slice(body, 1, cast(stop as int) - 1)")).otherwise(F.col("body"))
    text = F.concat(F.col("head"), F.lit("\n"), F.array_join("inside", "\n"))
    rows = settled(rows.select("path", "start_line", "head", inside.alias("inside")))
    rows = settled(rows.withColumn("text", text))
    bases = F.filter(F.transform(F.split(capture(F.col("head"), D.PYTHON_CLASS, 2), ","), strip), lambda b: F.length(b) > 0)
    made = F.array_distinct(F.filter(
        matches(F.col("text"), r"(\w+)\s*\(", group=1),
        lambda w: found(w, r"^\p{Lu}") & ~w.isin("True", "False", "None")))
    return settled(rows.select(
        "path", F.col("start_line").alias("line_no"), capture(F.col("head"), D.PYTHON_CLASS).alias("name"),
        (F.size("inside") + 1).alias("loc"), hits(F.col("text"), D.PYTHON_METHOD, "m").alias("methods"),
        hits(F.col("text"), r"self\.(\w+)\s*=").alias("attributes"), F.size(bases).alias("bases"),
        F.size(made).alias("dependencies")))


def class_metrics(files: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The counts of each class. ``classes``, here and below: ``python_classes``, if at hand."""
    return (python_classes(files) if classes is None else classes).select("path", "line_no", "name", "methods", "attributes", "bases", "dependencies", "loc")


def god_classes(files: DataFrame, limits: dict = LIMIT, classes: DataFrame | None = None) -> DataFrame:
    """Classes over the method (15), attribute (20) or length (500) limit."""
    many = F.col("methods") > limits["methods"]
    wide = F.col("attributes") > limits["attributes"]
    long = F.col("loc") > limits["loc"]
    n = many.cast("int") + wide.cast("int") + long.cast("int")
    confidence = 0.5 + F.when(many, 0.15).otherwise(0.0) + F.when(wide, 0.10).otherwise(0.0) + F.when(long, 0.15).otherwise(0.0)
    return class_metrics(files, classes).where(many | wide | long).select(
        "path", "line_no", "name", n.alias("violations"), F.when(n >= 2, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("severity"),
        F.round(F.least(F.lit(0.92), confidence), 9).alias("confidence"))


def imports(files: DataFrame) -> DataFrame:
    """``(path, line_no, module)`` of Python and script files."""
    line, language = F.col("line"), F.col("language")
    rows = lines(files)
    origin = capture(line, D.PYTHON_IMPORT, 1)
    python = rows.where((language == "python") & found(line, D.PYTHON_IMPORT)).select(
        "path", "line_no", F.when(F.length(origin) > 0, origin).otherwise(
            strip(F.substring_index(capture(line, D.PYTHON_IMPORT, 2), ",", 1))).alias("module"))
    script = rows.where(language.isin("javascript", "typescript")).select(
        "path", "line_no", F.explode(matches(line, D.SCRIPT_IMPORT, group=1)).alias("module"))
    return python.unionByName(script)


def coupling(files: DataFrame, limits: dict = LIMIT, classes: DataFrame | None = None, imported: DataFrame | None = None) -> DataFrame:
    """Files with more than 20 imports, classes with more than 8 dependencies. ``imported``, here and below: ``imports``, if at hand."""
    heavy = (imports(files) if imported is None else imported).groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > limits["imports"]).select(
        "path", F.lit(1).alias("line_no"), F.lit("high_import_count").alias("kind"), "n",
        F.lit("MEDIUM").alias("severity"), F.lit(0.68).alias("confidence"))
    tight = (python_classes(files) if classes is None else classes).where(F.col("dependencies") > limits["dependencies"]).select(
        "path", "line_no", F.lit("tight_coupling").alias("kind"), F.col("dependencies").cast("long").alias("n"),
        F.lit("HIGH").alias("severity"), F.lit(0.75).alias("confidence"))
    return heavy.unionByName(tight)


def solid_params(files: DataFrame, limits: dict = LIMIT, classes: DataFrame | None = None) -> DataFrame:
    """Classes with more than 4 bases, methods with more than 7 parameters."""
    line = F.col("line")
    params = F.size(F.filter(F.transform(F.split(capture(line, D.PYTHON_METHOD, 2), ","), strip),
                             lambda p: (F.length(p) > 0) & (p != "self")))
    wide = lines(files.where("language = 'python'")).where(found(line, D.PYTHON_METHOD)).select(
        "path", "line_no", capture(line, D.PYTHON_METHOD).alias("name"), params.alias("n"))
    wide = wide.where(F.col("n") > limits["params"]).select(
        "path", "line_no", F.lit("long_parameter_list").alias("kind"), "name", "n", F.lit(0.70).alias("confidence"))
    deep = (python_classes(files) if classes is None else classes).where(F.col("bases") > limits["bases"]).select(
        "path", "line_no", F.lit("deep_inheritance").alias("kind"), "name", F.col("bases").alias("n"),
        F.lit(0.72).alias("confidence"))
    return wide.unionByName(deep)


def _first_layer(parts: Column) -> Column:
    """First layer name of the table that occurs among the parts."""
    return reduce(lambda expr, name: (F if expr is None else expr).when(F.array_contains(parts, name), F.lit(name)),
                  D.LAYER_RANKS, None)


def layer_violations(files: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """Imports of an upper layer from a lower one, by path and module parts."""
    own = _first_layer(F.split(F.lower("path"), "/"))
    other = _first_layer(F.split(F.lower("module"), "[.]"))
    rows = (imports(files) if imported is None else imported).select("path", "line_no", "module", own.alias("layer"), other.alias("imported"))
    rank = lambda c: lookup(F.col(c), D.LAYER_RANKS)
    return rows.where(F.col("layer").isNotNull() & F.col("imported").isNotNull() & (rank("imported") < rank("layer"))) \
        .select("path", "line_no", "layer", "imported", F.lit("HIGH").alias("severity"), F.lit(0.80).alias("confidence"))


def pattern_misuse(files: DataFrame) -> DataFrame:
    content = F.col("content")
    unsafe = (F.col("language") == "python") & F.contains(content, F.lit("_instance = None")) \
        & ~F.contains(F.lower(content), F.lit("threading")) & ~F.contains(content, F.lit("Lock"))
    item = lambda kind, confidence: F.struct(F.lit(kind).alias("kind"), F.lit("MEDIUM").alias("severity"),
                                             F.lit(confidence).alias("confidence"))
    return files.select("path", F.inline(F.array_compact(F.array(
        F.when(unsafe, item("unsafe_singleton", 0.72)),
        F.when(found(content, D.SERVICE_LOCATOR, "i"), item("service_locator", 0.65))))))


def concrete_dependencies(files: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    return (imports(files) if imported is None else imported).where(found(F.col("module"), D.CONCRETE_MODULES)).select(
        "path", "line_no", "module", F.lit("LOW").alias("severity"), F.lit(0.60).alias("confidence"))


def all_findings(files: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Every finding. Three rules read the classes and three the imports, so both are found once."""
    classes = kept(python_classes(files), "classes") if classes is None else classes
    imported = kept(imports(files), "imports")
    tag = lambda rows, kind=None, **extra: rows.select(
        "path", extra.get("line", F.col("line_no")).alias("line_no"),
        (F.lit(kind) if kind else F.col("kind")).alias("kind"), extra.get("severity", F.col("severity")).alias("severity"),
        "confidence")
    out = tag(god_classes(files, classes=classes), "god_class").unionByName(tag(coupling(files, classes=classes, imported=imported)))
    out = out.unionByName(tag(solid_params(files, classes=classes), severity=F.lit("MEDIUM")))
    out = out.unionByName(tag(layer_violations(files, imported), "layer_violation"))
    out = out.unionByName(tag(pattern_misuse(files), line=F.lit(1)))
    return out.unionByName(tag(concrete_dependencies(files, imported), "concrete_dependency"))
