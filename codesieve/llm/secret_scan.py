"""Secret scans: patterns propose, corpus-wide ownership tells live credentials from examples. DataFrame operations only.

Each pattern's matches in a text come from one extraction and one split; of a text only gap lengths and matched strings
go on, and running sums over them give code-point spans. Every candidate value is hashed and counted by the distinct
repositories (`source`) and owners (the part of it before a slash) that hold it, each pair once, so a key copied into
very many documents is one row per repository. A value in at least EXAMPLE_REPOS repositories, or of EXAMPLE_OWNERS
owners, is a widely copied `example`; another credential is `live`. Both are spans of the value itself, beside the base
kinds assign, access and hex; `mixed` candidates (long, of letters and digits) give method spans only.

What is a credential depends on the kind. Access keys and values assigned to a key word are, whatever their characters,
unless they are one character over and over, or hold no letter or digit. Hexadecimal runs need a digit, a letter and
DISTINCT different characters. A `mixed` value has nothing but itself to show for it: without UUIDs and plain words, at
least CORE letters and digits must be left, which change between words, capitals and numbers at one in CHANGES places;
three words between its - and _ make it a slug, one between slashes makes it a path.

Null texts are empty. A null source is a repository of its own. Spans of different kinds may overlap. Repeated rows are
scanned alike. `redact` blanks out every occurrence of a document's live values and leaves the rest as it is; a value of
plain words or numbers only where it is assigned, since the same words may stand in the prose around it.
Texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import settle

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern (runs are matched whole, so their least length may stand in the pattern), and a cheap test before it.
PATTERNS = [
    ("assign", ASSIGN, r"(?i)passw|secret|token|api_?key"),
    ("access", "AKIA[A-Z0-9]{12,}", "AKIA"),
    ("hex", "(?<![0-9a-f])[0-9a-f]{32,}+", "[0-9a-f]{32}"),
    ("mixed", "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", "[A-Za-z0-9+/_-]{20}"),
]
BASE = ["assign", "access", "hex"]
ORDER = [*BASE, "live", "example"]
EXAMPLE_REPOS, EXAMPLE_OWNERS, MASK = 5, 3, "[secret]"
DISTINCT, CORE, CHANGES, SLUG_WORDS = 8, 16, 5, 3
KEYED = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)"""
UUID = "(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])"
#: A word, capitals or a number inside a value; and a part that is one word.
PIECE, WORD = "[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", "^(?:[A-Z]?[a-z]+|[A-Z]+)$"


def _matches(text: Column, kind: str, pattern: str, guard: str) -> Column:
    """(kind, n, gap, match) of each match: its number and the code points since the one before."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    rows = F.transform(both, lambda b, n: F.struct(F.lit(kind).alias("kind"), n.alias("n"), b["g"].alias("gap"), b["m"].alias("match")))
    # The last gap has no match after it.
    return F.when(text.rlike(guard), F.filter(rows, lambda r: r["match"].isNotNull())).otherwise(F.array().cast("array<struct<kind:string,n:int,gap:int,match:string>>"))


def _varied(value: Column) -> Column:
    """Letters and digits in many different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT)


def _parts(value: Column, pattern: str) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(0))


def _random(value: Column) -> Column:
    """Evidence in the value itself: neither path nor slug, and what is left without UUIDs and words keeps changing."""
    bare = F.regexp_replace(value, UUID, "")
    path = F.contains(bare, F.lit("/")) & F.exists(F.split(bare, "/"), lambda x: (F.length(x) >= 3) & x.rlike(WORD))
    parts = _parts(bare, "[A-Za-z0-9]+")
    words = F.filter(parts, lambda x: (F.length(x) >= 2) & x.rlike(WORD))
    core = F.array_join(F.filter(parts, lambda x: (F.length(x) < 2) | ~x.rlike(WORD)), "-")
    left = F.length(F.replace(core, F.lit("-"), F.lit("")))
    changes = F.size(_parts(core, PIECE)) - F.size(_parts(core, "[A-Za-z0-9]+"))
    return ~path & (F.size(words) < SLUG_WORDS) & _varied(core) & (left >= CORE) & (CHANGES * changes >= left)


def _credential(kind: Column, value: Column) -> Column:
    body = F.when(kind == "access", F.substring(value, 5, 1 << 30)).otherwise(value)
    filler = ~body.rlike("[A-Za-z0-9]") | (F.replace(body, F.substring(body, 1, 1), F.lit("")) == "")
    return F.when(kind.isin("assign", "access"), ~filler).when(kind == "hex", _varied(value)).otherwise(_random(value))


def _plain(value: Column) -> Column:
    """Words and numbers, such as prose has."""
    return F.forall(F.split(value, "[^A-Za-z0-9]+"), lambda x: x.rlike("^(?:[A-Z]?[a-z]*|[A-Z]*|[0-9]*)$"))


def scan(docs: DataFrame) -> DataFrame:
    """rid, doc_id, source, found: a number for each row and what the patterns match in it; stored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    found = F.concat(*[_matches(F.col("text"), *p) for p in PATTERNS])
    return settle(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", found.alias("found")), "op5-scan")


def spans(scanned: DataFrame) -> DataFrame:
    """rid, source, kind, start, end, value of every candidate."""
    hits = scanned.where(F.size("found") > 0).select("rid", "doc_id", "source", F.inline("found"))
    upto = Window.partitionBy("rid", "kind").orderBy("n")
    size = F.length("match")
    hits = hits.withColumn("end", F.sum(F.col("gap") + size).over(upto))
    value = F.when(F.col("kind") == "assign", F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    hits = hits.select("rid", "doc_id", "source", "kind", (F.col("end") - size).alias("start"), "end", value.alias("value"))
    return hits.where((F.col("kind") != "assign") | (F.length("value") >= 8))


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, repos, owners: in how many of each a candidate value stands; stored."""
    repo = F.coalesce("source", F.lit(""))
    pairs = candidates.select(F.sha2("value", 256).alias("value_hash"), repo.alias("repo")).distinct().withColumn("owner", F.substring_index("repo", "/", 1))
    return settle(pairs.groupBy("value_hash").agg(F.count("*").alias("repos"), F.count_distinct("owner").alias("owners")), "op5-ownership")


def judged(scanned: DataFrame) -> DataFrame:
    """The candidates with `verdict`: live, example or neither (null)."""
    candidates = settle(spans(scanned).withColumn("value_hash", F.sha2("value", 256)), "op5-spans")
    rows = candidates.join(ownership(candidates), "value_hash")
    wide = (F.col("repos") >= EXAMPLE_REPOS) | (F.col("owners") >= EXAMPLE_OWNERS)
    return rows.withColumn("verdict", F.when(~_credential(F.col("kind"), F.col("value")), None).when(wide, "example").otherwise("live"))


def _listed(rows: Column) -> Column:
    ordered = F.sort_array(rows)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    scanned = scan(docs)
    own = F.struct("kind", "start", "end")
    ruled = F.struct(F.col("verdict").alias("kind"), (F.col("end") - F.length("value")).alias("start"), "end")
    rows = judged(scanned).select("rid", F.explode(F.array_compact(F.array(F.when(F.col("kind") != "mixed", own), F.when(F.col("verdict").isNotNull(), ruled)))).alias("s")).distinct()
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("s.kind"))
    span = F.struct(F.col("s.start").alias("start"), place.alias("place"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"))
    # The spans of one text come together here.
    texts = rows.groupBy("rid").agg(F.collect_list(span).alias("all")).withColumn("base", F.filter("all", lambda s: s["place"] <= len(BASE)))
    of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    texts = texts.select("rid", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))
    none = {**{f"n_{k}": F.lit(0).cast("long") for k in BASE}, "base_sha256": F.sha2(F.lit("").cast("binary"), 256), "spans": F.lit("")}
    return scanned.select("rid", "doc_id").join(texts, "rid", "left").select("doc_id", *[F.coalesce(F.col(c), v).alias(c) for c, v in none.items()])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with the live values of each document blanked out in its text."""
    bound = (F.col("kind") == "assign") & _plain(F.col("value"))
    live = judged(scan(docs)).where("verdict = 'live'").groupBy(F.col("doc_id").alias("live_id")).agg(F.collect_set(F.struct(F.length("value").alias("n"), F.col("value").alias("v"), bound.alias("bound"))).alias("values"))
    longest = F.reverse(F.sort_array("values"))
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    found = whole.join(settle(live, "op5-live"), F.col("row.doc_id").eqNullSafe(F.col("live_id")), "left")
    # Values hold no backslash, so they may be quoted in a pattern.
    assigned = lambda v: F.concat(F.lit(KEYED + r"\Q"), v, F.lit(r"\E(?![A-Za-z0-9+/_.=-])"))
    blank = lambda t, x: F.when(x["bound"], F.regexp_replace(t, assigned(x["v"]), F.lit("$1" + MASK))).otherwise(F.replace(t, x["v"], F.lit(MASK)))
    text = F.when(F.col("values").isNull(), F.col("row.text")).otherwise(F.aggregate(longest, F.col("row.text"), blank))
    out = found.select("row", "values", text.alias("text"))
    size = F.when(F.col("values").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast("long") if "n_chars" in names else None
    return out.select(*[F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in names])
