"""Comment text: extraction, phrases, length, ratio, repetition of the code below."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import (contains_any, escaped, folded, found, hits, lookup, matches, restored, rx,
                                      starts_with_any, strip)
from codesieve.operators.detect import first_rule
from codesieve.operators.lines import context, is_comment, lines, with_low
from codesieve.operators.metrics import words
from codesieve.rulebook import style as R

TRIPLES = ('"""', "'''")
#: One of these stands in every line that holds a comment, whatever the language.
COMMENT_SIGNS = ("#", "//")


# --- semantic rules ----------------------------------------------------------
def comment_text(line: Column, language: Column) -> Column:
    text = strip(line)
    hashed = strip(F.ltrim(text, F.lit("#")))
    slashed = strip(F.ltrim(F.ltrim(text, F.lit("/")), F.lit("*")))
    return F.when(language.isin("python", "ruby"), hashed) \
        .when(language.isin("javascript", "typescript", "java", "csharp"), slashed).otherwise(text)


def comment_quality(files: DataFrame) -> DataFrame:
    """One-word comments, empty markers, very long comments."""
    line, language = F.col("line"), F.col("language")
    rows = lines(files).where(is_comment("semantic", line, language)) \
        .select("path", "line_no", "line", comment_text(line, language).alias("text"))
    text = F.col("text")
    one_word = ~found(text, r"\s") & (F.length(text) > 3)
    empty_marker = found(text, r"^(?:TODO|FIXME|XXX|HACK)\s*:?\s*$", "i")
    item = lambda kind, severity, confidence: F.struct(
        F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))
    found_items = F.array_compact(F.array(
        F.when(one_word, item("single_word_comment", "LOW", 0.60)),
        F.when(empty_marker, item("empty_marker", "LOW", 0.55)),
        F.when(F.length(text) > 200, item("verbose_comment", "MEDIUM", 0.65))))
    return rows.select("path", "line_no", F.inline(found_items))


def writing_style(files: DataFrame) -> DataFrame:
    line, language = F.col("line"), F.col("language")
    rows = first_rule(with_low(lines(files).where(is_comment("semantic", line, language))), R.WRITING_STYLE)
    confidence = R.WRITING_STYLE.confidences(F.col("i"))
    return rows.select("path", "line_no", R.WRITING_STYLE.names(F.col("i")).alias("phrase"),
                       F.when(confidence > 0.85, F.lit("HIGH")).when(confidence > 0.70, F.lit("MEDIUM"))
                       .otherwise(F.lit("LOW")).alias("severity"),
                       confidence.alias("confidence"), context(line).alias("context"))


def _style_of(name: Column) -> Column:
    return reduce(lambda expr, rule: (F if expr is None else expr).when(found(name, rule[1]), F.lit(rule[0])),
                  R.NAMING_STYLES, None)


def naming_styles(files: DataFrame) -> DataFrame:
    """Files that mix more than two naming styles over at least five named values."""
    language, content = F.col("language"), F.col("content")
    names = F.when(language == "python", matches(content, R.NAMED_VALUES["python"], group=1)) \
        .when(language.isin("javascript", "typescript"), matches(content, R.NAMED_VALUES["javascript"], group=1))
    # Settled, so that the names are not cut out again once they are counted.
    rows = settled(files.select("path", names.alias("names"))).where(F.size("names") >= 5)
    styles = F.filter(F.transform("names", _style_of), lambda s: s.isNotNull())
    tagged = rows.select("path", F.posexplode(styles).alias("pos", "style"))
    counted = tagged.groupBy("path", "style").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = F.max(F.struct("n", (-F.col("first")).alias("seen"), "style"))
    return counted.groupBy("path").agg(F.count("*").alias("styles"), F.sum("n").alias("named"), best.alias("best")) \
        .where("styles > 2").select("path", "styles", "named", F.col("best.style").alias("dominant"),
                                    F.lit("MEDIUM").alias("severity"), F.lit(0.68).alias("confidence"))


def docstring_shapes(files: DataFrame) -> DataFrame:
    """Docstrings with three or more section words, or uniformly indented ones.

    A line holding a triple quote toggles the state, as a whole line.
    """
    text = F.transform(F.split(escaped(F.col("content")), "\n", -1), strip)
    toggles = lambda l: contains_any(l, TRIPLES)
    marked = F.array_join(F.transform(text, lambda l, i: F.when(
        toggles(l), F.concat(F.lit("\x01"), (i + 1).cast("string"), F.lit("\t"), l, F.lit("\x01"))).otherwise(l)), "\n")
    pieces = F.split(marked, "\x01", -1)
    # Pieces alternate: plain text, toggle line, plain text, toggle line, ...
    rows = settled(files.where("language = 'python'").select("path", pieces.alias("p"))).where(F.size("p") >= 4)
    # Only its own pieces go with a docstring.
    docs = settled(rows.select("path", F.inline(F.transform(F.sequence(F.lit(2), F.size("p") - 2, F.lit(4)), lambda k: F.struct(
        F.get("p", k - 1).alias("opening"), F.get("p", k).alias("body"), F.get("p", k + 1).alias("closing"))))))
    opening, closing = F.col("opening"), F.col("closing")
    body = F.split("body", "\n", -1)
    text_of = lambda row: F.substring(row, F.instr(row, "\t") + 1, F.length(row))
    doc_lines = F.concat(F.array(text_of(opening)), F.slice(body, F.lit(2), F.greatest(F.size(body) - 2, F.lit(0))),
                         F.array(text_of(closing)))
    full = settled(docs.select("path", F.substring_index(opening, "\t", 1).cast("int").alias("line_no"), doc_lines.alias("d")))
    joined = F.array_join("d", "\n")
    sections = reduce(lambda a, b: a + b, [F.contains(joined, F.lit(s)).cast("int") for s in R.DOCSTRING_SECTIONS])
    # Lines were stripped before, so any non-empty rest has one indent.
    rest = F.size(F.filter(F.expr("slice(d, 2, size(d))"), lambda l: F.length(l) > 0))
    uniform = (F.size("d") > 3) & (rest > 0)
    return full.where(((sections >= 3) & (F.size("d") < 15)) | uniform).select(
        "path", "line_no", sections.alias("sections"), F.size("d").alias("doc_lines"),
        F.lit("MEDIUM").alias("severity"), F.lit(0.65).alias("confidence"))


def vocabulary(files: DataFrame) -> DataFrame:
    """How many machine-like and human-like vocabulary words occur in the text."""
    low = F.lower("content")
    total = lambda vocab: reduce(lambda a, b: a + b, [F.contains(F.col("low"), F.lit(w)).cast("int") for w in vocab])
    # Settled, so that a filter on the verdict doesn't search the text again for each use of a count.
    rows = settled(settled(files.select("path", low.alias("low"))).select(
        "path", total(R.MACHINE_VOCABULARY).alias("machine_words"), total(R.HUMAN_VOCABULARY).alias("human_words")))
    flagged = (F.col("machine_words") > 5) & (F.col("machine_words") > F.col("human_words") * 2)
    return rows.select("path", "machine_words", "human_words", F.when(flagged, F.lit("MEDIUM")).alias("severity"),
                       F.when(flagged, F.least(F.lit(0.85), 0.5 + F.col("machine_words") * 0.03)).alias("confidence"))


def formality_of(text: Column, low: Column | None = None) -> tuple[Column, Column]:
    total = lambda patterns: reduce(lambda a, b: a + b, [hits(text, p, "i", low) for p in patterns])
    return total(R.FORMAL_PATTERNS), total(R.INFORMAL_PATTERNS)


def formality(texts: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Share of formal among formal and informal markers; 0.5 without any."""
    formal, informal = formality_of(F.col("_text"), F.col("_low"))
    rows = settled(texts.select(key, F.col(text).alias("_text"), folded(F.col(text)).alias("_low")))
    rows = settled(rows.select(key, formal.alias("formal"), informal.alias("informal")))
    total = F.col("formal") + F.col("informal")
    score = F.when(total == 0, F.lit(0.5)).otherwise(F.try_divide(F.col("formal"), total))
    return rows.select(key, "formal", "informal", F.round(score, 9).alias("score"), (score > 0.7).alias("high"))


# --- comment extraction --------------------------------------------------------
#: A quoted string before a comment sign; triple quotes first.  No escapes here.
_PY_QUOTED = r"\"\"\"(?:(?!\"\"\")[\s\S])*+(?:\"\"\"|$)|'''(?:(?!''')[\s\S])*+(?:'''|$)|\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)"


def inline_comment(line: Column, language: Column) -> Column:
    """Text after the comment marker, outside quotes for Python; null when none."""
    py = F.regexp_extract(line, rx(r"^(?:[^\"'#]++|" + _PY_QUOTED + r")*+#([\s\S]*)$"), 1)
    slash = F.when(F.contains(line, F.lit("//")), F.substring(line, F.instr(line, "//") + 2, F.length(line)))
    hashed = F.when(F.contains(line, F.lit("#")), F.substring(line, F.instr(line, "#") + 1, F.length(line)))
    slashed_languages = [lang for lang, mark in R.COMMENT_MARKERS.items() if mark == "//"]
    text = strip(F.when(language == "python", py).when(language.isin(slashed_languages), slash).otherwise(hashed))
    return F.when(F.length(text) > 0, text)


def comments(files: DataFrame) -> DataFrame:
    """``(path, language, line_no, text)``: line, inline and docstring comments.

    In Python a line holding a triple quote toggles docstring state; the block
    becomes one comment whose lines are joined by spaces.
    """
    language = F.col("language")
    toggles = lambda l: contains_any(l, TRIPLES)
    numbered = F.transform(F.split(escaped(F.col("content")), "\n", -1), lambda l, i: F.struct((i + 1).alias("no"), l.alias("line")))
    marked = F.array_join(F.transform(numbered, lambda s: F.concat(
        F.when((language == "python") & toggles(s["line"]), F.lit("\x01")).otherwise(F.lit("")),
        s["no"].cast("string"), F.lit("\t"), s["line"])), "\n")
    # Pieces start at toggle lines; odd pieces are docstring bodies with their opening line.
    # A docstring needs its closing line: the first row of the piece after it.
    # The text is read once: its pieces are settled before each of them looks at the next one.
    files = settled(files.select("path", "language", F.split(marked, "\x01", -1).alias("_pieces")))
    rows_of = lambda piece: F.split(F.rtrim(piece, F.lit("\n")), "\n", -1)
    paired = F.transform("_pieces", lambda piece, k: F.struct(
        k.alias("k"), rows_of(piece).alias("rows"),
        F.substring_index(F.get("_pieces", k + 1), "\n", 1).alias("closing")))
    rows = files.select("path", "language", F.inline(paired))
    text_of = lambda row: F.substring(row, F.instr(row, "\t") + 1, F.length(row))
    # Even pieces after the first begin with the closing toggle line, which is no candidate.
    plain = F.filter(F.when(F.col("k") == 0, F.col("rows")).otherwise(F.expr("slice(rows, 2, size(rows))")), lambda r: F.length(r) > 0)
    # A line without any comment sign is no candidate; the head of its row holds only digits and a tab.
    plain = F.filter(plain, lambda r: contains_any(r, COMMENT_SIGNS))
    doc = F.concat(F.substring_index(F.element_at("rows", 1), "\t", 1), F.lit("\t"),
                   F.array_join(F.transform(F.concat("rows", F.array("closing")), lambda r: strip(text_of(r))), " "))
    kept = F.when(F.col("k") % 2 == 0, plain).when(F.col("closing").isNotNull(), F.array(doc))
    rows = settled(rows.select("path", "language", (F.col("k") % 2 == 1).alias("doc"), F.explode(kept).alias("row")))
    text = F.when(F.col("doc"), text_of(F.col("row"))).otherwise(inline_comment(text_of(F.col("row")), language))
    rows = settled(rows.select("path", "language", F.substring_index("row", "\t", 1).cast("int").alias("line_no"), text.alias("text")))
    return rows.where("text is not null").withColumn("text", restored(F.col("text")))


def _every(files: DataFrame, every: DataFrame | None) -> DataFrame:
    """The comments of the files, taken from ``every`` where a caller has them at hand."""
    return comments(files) if every is None else every


def comment_phrases(files: DataFrame, every: DataFrame | None = None) -> DataFrame:
    text = F.col("text")
    rows = first_rule(with_low(_every(files, every), "text"), R.COMMENT_PHRASES, "text")
    name, confidence = R.COMMENT_PHRASES.names(F.col("i")), R.COMMENT_PHRASES.confidences(F.col("i"))
    return rows.select("path", "line_no", name.alias("phrase"),
                       F.when(confidence > 0.85, F.lit("HIGH")).when(confidence > 0.70, F.lit("MEDIUM"))
                       .otherwise(F.lit("LOW")).alias("severity"), confidence.alias("confidence"),
                       F.left(text, F.lit(100)).alias("comment"),
                       lookup(name, R.COMMENT_PHRASE_SUGGESTIONS, R.COMMENT_PHRASE_DEFAULT).alias("suggestion"))


def _word_list(text: Column) -> Column:
    return F.filter(F.split(text, rx(r"\s+"), -1), lambda w: F.length(w) > 0)


def obvious_comments(files: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Comments stating the obvious, and comments too brief to tell anything."""
    text = F.col("text")
    i = R.OBVIOUS_COMMENTS.first_match(F.col("hashed"), low=F.col("low"))
    confidence = R.OBVIOUS_COMMENTS.confidences(F.col("i"))
    brief = (F.size(_word_list(text)) <= 2) & (F.length(text) < 15) \
        & ~contains_any(F.upper(text), ("TODO", "FIXME", "XXX", "NOTE", "HACK"))
    obvious = F.struct(F.lit("obvious_comment").alias("kind"), R.OBVIOUS_COMMENTS.names(F.col("i")).alias("rule"),
                       F.when(confidence > 0.85, F.lit("MEDIUM")).otherwise(F.lit("LOW")).alias("severity"),
                       confidence.alias("confidence"))
    short = F.struct(F.lit("too_brief_comment").alias("kind"), F.lit("too_brief").alias("rule"),
                     F.lit("LOW").alias("severity"), F.lit(0.65).alias("confidence"))
    rows = with_low(_every(files, every).withColumn("hashed", F.concat(F.lit("# "), text)), "hashed")
    return rows.withColumn("i", i).select("path", "line_no", F.inline(F.array_compact(F.array(
        F.when(F.col("i").isNotNull(), obvious), F.when(brief, short)))))


def code_line_counts(files: DataFrame) -> DataFrame:
    code = F.filter(F.transform(F.split("content", "\n", -1), strip), lambda l: (F.length(l) > 0) & ~starts_with_any(
        l, ("#", "//", *TRIPLES, "/*", "*")))
    return files.select("path", F.size(code).alias("code_lines"))


def comment_totals(files: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Comments, code lines, ratio and mean length per file (files with comments)."""
    per_file = _every(files, every).groupBy("path").agg(F.count("*").alias("comments"), F.sum(F.length("text")).alias("chars"))
    return per_file.join(code_line_counts(files), "path")


def comment_metrics(files: DataFrame) -> DataFrame:
    return comment_totals(files).select(
        "path", "comments", "code_lines",
        F.round(F.col("comments") / F.greatest(F.lit(1), F.col("code_lines")), 9).alias("ratio"),
        F.round(F.col("chars") / F.col("comments"), 9).alias("mean_length"))


def comment_ratio(files: DataFrame, every: DataFrame | None = None) -> DataFrame:
    rows = comment_totals(files, every).where("code_lines >= 5").withColumn("ratio", F.col("comments") / F.col("code_lines"))
    high = F.col("ratio") > 0.60
    return rows.where("ratio > 0.40").select(
        "path", "comments", "code_lines", F.when(high, F.lit("excessive_comments")).otherwise(F.lit("high_comment_ratio")).alias("kind"),
        F.when(high, F.lit("CRITICAL")).otherwise(F.lit("HIGH")).alias("severity"),
        F.when(high, F.lit(0.90)).otherwise(F.lit(0.80)).alias("confidence"))


def comment_length(files: DataFrame, top: int = 5, every: DataFrame | None = None) -> DataFrame:
    """The first five comments over 120 characters, and files whose mean is over 60."""
    every = _every(files, every)
    order = Window.partitionBy("path").orderBy("line_no")
    length = F.length("text")
    long = every.where(length > 120).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "path", "line_no", F.lit("long_comment").alias("kind"), length.cast("double").alias("value"),
        F.lit("MEDIUM").alias("severity"), F.least(F.lit(0.85), 0.6 + (length - 120) / 200).alias("confidence"))
    mean = every.groupBy("path").agg(F.avg(length).alias("value")).where("value > 60")
    high = F.col("value") > 100
    overall = mean.select(
        "path", F.lit(1).alias("line_no"),
        F.when(high, F.lit("verbose_comments_overall")).otherwise(F.lit("somewhat_verbose_comments")).alias("kind"),
        F.round("value", 9).alias("value"), F.when(high, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("severity"),
        F.when(high, F.lit(0.85)).otherwise(F.lit(0.72)).alias("confidence"))
    return long.unionByName(overall)


def filler_words(files: DataFrame, every: DataFrame | None = None) -> DataFrame:
    fillers = F.filter(_word_list(F.lower("text")), lambda w: w.isin(R.FILLER_WORDS))
    rows = _every(files, every).select("path", "line_no", fillers.alias("f")).where(F.size("f") >= 3)
    return rows.select("path", "line_no", F.size("f").alias("n"), F.lit("MEDIUM").alias("severity"),
                       F.least(F.lit(0.85), 0.60 + F.size("f") * 0.08).alias("confidence"))


def redundant_comments(files: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Comments sharing over 60% of their words with the next code line (within 3 lines).

    The look-ahead is taken inside the file's row before anything is exploded.
    """
    text = F.transform(F.split("content", "\n", -1), strip)
    # Lines that are no code count as missing; the next ones are looked up, as a slice would copy the file for each line.
    code = F.transform(text, lambda c: F.when((F.length(c) > 0) & ~starts_with_any(c, ("#", "//")), c))
    rows = settled(files.select("path", "language", F.split("content", "\n", -1).alias("l"), code.alias("t")))
    next_code = lambda i: F.coalesce(*[F.get("t", i + k) for k in (1, 2, 3)])
    # Comments begin on lines with a comment sign or, in Python, with triple quotes.
    signed = lambda l: contains_any(l, (*COMMENT_SIGNS, *TRIPLES))
    ahead = rows.select("path", F.inline(F.filter(F.transform("l", lambda l, i: F.when(signed(l), F.struct(
        (i + 1).alias("line_no"), next_code(i).alias("code")))), lambda s: s["code"].isNotNull())))
    own = lambda c: F.array_except(F.array_distinct(words(F.lower(c))), F.array(*[F.lit(w) for w in R.COMMON_CODE_WORDS]))
    joined = _every(files, every).join(ahead, ["path", "line_no"])
    # Settled, so that the words are not cut out again for each use of them; those of the code only where a comment has some.
    joined = settled(joined.select("path", "line_no", "code", own(F.col("text")).alias("c"))).where(F.size("c") > 0)
    joined = settled(joined.select("path", "line_no", "c", own(F.col("code")).alias("k")))
    overlap = F.size(F.array_intersect("c", "k")) / F.size("c")
    return joined.where((F.size("c") > 0) & (F.size("k") > 0)).withColumn("overlap", overlap).where("overlap > 0.6") \
        .select("path", "line_no", F.round("overlap", 9).alias("overlap"), F.lit("MEDIUM").alias("severity"),
                F.round(F.least(F.lit(0.88), 0.5 + F.col("overlap") * 0.4), 9).alias("confidence"))


