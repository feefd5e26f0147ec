"""Sections of markdown documents and lookups by heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import MARK, escaped, found, lookup, restored, rx, strip

AREAS = """Software Requirements|Software Architecture|Software Design|Software Construction|Software Testing
Software Engineering Operations|Software Maintenance|Software Configuration Management|Software Engineering Management
Software Engineering Process|Software Engineering Models and Methods|Software Quality|Software Security
Software Engineering Professional Practice|Software Engineering Economics|Computing Foundations
Mathematical Foundations|Engineering Foundations""".replace("\n", "|").split("|")


# The sections a caller may name, in the order of the table of contents, with the heading each begins with.
SECTIONS = {"preamble": "PREAMBLE", "identity": "PART I", "anti-deception": "PART II", "intelligence-architecture": "PART III", "t-shape": "PART IV",
            "swebok": "PART V", "consensus-protocol": "PART VI", "iteration-protocol": "PART VII", "agentic-pathway": "PART VIII",
            "power-of-10": "PART IX", "operational-directives": "PART X", "knowledge-graph": "APPENDIX A", "invariants": "APPENDIX B",
            "references": "REFERENCES"}
# Former names of sections, accepted but not listed.
FORMER = {"hive-mind": "consensus-protocol"}


def sections(docs: DataFrame, level: int, text: str = "content", key: str = "path") -> DataFrame:
    """``(key, ord, heading, body)`` per heading of the level; fences are respected.

    Fence lines toggle, so splitting the text at them tells inside from outside;
    only outside pieces get heading marks, and one more split yields sections.
    """
    prefix = "#" * level + " "
    fence = r"^\s*```"
    rows = F.split(escaped(F.col(text)), "\n", -1)
    # Fence state by a linear fold over the lines' fence flags, kept as text marks.
    tagged = F.array_join(F.transform(rows, lambda l: F.when(
        found(l, fence), F.concat(F.lit("\x03"), l)).otherwise(l)), "\n")
    pieces = F.split(tagged, "\x03", -1)
    heading = "^" + prefix + "(?!#)"
    mark = lambda piece: F.regexp_replace(piece, F.lit(rx(heading, "m")), F.lit(MARK + prefix))
    # An odd piece starts at an opening fence line, an even one at a closing line.
    marked = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, mark(p)).otherwise(p))
    parts = F.split(F.array_join(marked, ""), MARK, -1)
    out = docs.select(key, F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("ord", "section"))
    section = restored(F.col("section"))
    head = F.substring_index(section, "\n", 1)
    body = F.substring(section, F.length(head) + 2, F.length(section))
    return out.select(key, "ord", strip(F.substring(head, len(prefix) + 1, F.length(head))).alias("heading"), strip(body).alias("body"))


def find_section(docs: DataFrame, prefix: str, level: int = 2) -> DataFrame:
    """First section of each document whose heading starts with the prefix (any case)."""
    rows = sections(docs, level).where(F.startswith(F.upper("heading"), F.lit(prefix.upper())))
    best = rows.groupBy("path").agg(F.min_by(F.struct("heading", "body"), "ord").alias("s"))
    return best.select("path", F.concat(F.lit("#" * level + " "), F.col("s.heading"), F.lit("\n\n"), F.col("s.body")).alias("text"))


def look_up(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``(path, section, status, text)`` for every row of queries(path, section).

    A former name stands for today's. ``full`` gives the document, ``toc`` the table of contents with the preamble; a known
    section gives its heading and body. status: found, missing (no heading begins so), unknown (no such name), or
    no-document. A null section is the table of contents. The sections of a document are one array; the first that fits
    counts, and queries meet documents by path.
    """
    parts = sections(docs, 2).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "heading", "body"))).alias("_sections"))
    texts = docs.select(F.col("path").alias("_path"), F.col("content").alias("_content")).join(parts.withColumnRenamed("path", "_key"), F.col("_path") == F.col("_key"), "left")
    none = F.expr("cast(array() as array<struct<ord:int,heading:string,body:string>>)")
    rows = settled(queries.select("path", "section").join(texts, F.col("path") == F.col("_path"), "left").withColumn("_sections", F.coalesce("_sections", none)))
    begins = lambda prefix: F.get(F.filter("_sections", lambda s: F.startswith(F.upper(s["heading"]), F.upper(prefix))), 0)
    asked = F.coalesce("section", F.lit("toc"))
    prefix = lookup(F.coalesce(lookup(asked, FORMER), asked), SECTIONS)
    shown = lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), s["body"])
    known = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(p).alias("prefix")) for k, p in SECTIONS.items()])
    entries = F.transform(known, lambda k: F.concat(F.lit("- "), k["key"], F.lit(": "), F.coalesce(begins(k["prefix"])["heading"], k["prefix"])))
    contents = F.array_join(F.concat(entries, F.array(F.lit("- full: the whole document")), F.array_compact(F.array(F.concat(F.lit("\n"), shown(begins(F.lit("PREAMBLE"))))))), "\n")
    found_text = shown(begins(prefix))
    status = F.when(F.col("_path").isNull(), F.lit("no-document")).when(asked.isin("full", "toc"), F.lit("found")).when(prefix.isNull(), F.lit("unknown")) \
        .when(found_text.isNull(), F.lit("missing")).otherwise(F.lit("found"))
    text = F.when(asked == "full", F.col("_content")).when(asked == "toc", contents).otherwise(found_text)
    return rows.select("path", "section", status.alias("status"), F.when(F.col("_path").isNotNull(), text).alias("text"))


def area_number(query: Column) -> Column:
    """Area number from digits in the query, else from a unique name match."""
    digits = F.regexp_extract(query, r"\d+", 0)
    names = F.transform(F.split(F.lit("|".join(AREAS)), r"\|"), lambda a, i: F.struct(F.lower(a).alias("a"), (i + 1).alias("n")))
    hits = F.filter(names, lambda s: F.contains(s["a"], F.lower(strip(query))))
    by_name = F.when(F.size(hits) == 1, F.element_at(hits, 1)["n"])
    return F.when(F.length(digits) > 0, digits.try_cast("int")).otherwise(by_name)


def ambiguous(query: Column) -> Column:
    names = F.split(F.lit("|".join(AREAS)), r"\|")
    return (F.length(F.regexp_extract(query, r"\d+", 0)) == 0) \
        & (F.size(F.filter(names, lambda a: F.contains(F.lower(a), F.lower(strip(query))))) > 1)


def find_area(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Sections ``### KA-nn`` of the areas that queries(path, query) name."""
    asked = queries.select("path", "query", area_number(F.col("query")).alias("number"), ambiguous(F.col("query")).alias("ambiguous"))
    areas = sections(docs, 3).withColumn("number", F.regexp_extract("heading", r"^KA-(\d+)\b", 1).try_cast("int"))
    first = areas.where("number is not null").groupBy("path", "number").agg(F.min_by("heading", "ord").alias("heading"))
    return asked.join(first, ["path", "number"], "left").select("path", "query", "number", "ambiguous", "heading")


