"""Quality rules: decision lists learned by sequential covering, in DataFrame operations only.

Statistics of a text are computed in its row. Training joins them with the labels, takes quantiles of each as cut
points, and grows one conjunction at a time on two thirds of the rows by information gain, each step one aggregate over
all labelled rows that no rule covers yet (its result has a row per statistic and bin). The other third prunes the
conjunction and accepts it only if it is precise there. The list is an ordered conditional expression over the
statistics: the first rule that holds names the fault; a text without one is kept.

Null texts have no words. Labels that are null, or whose document is missing, teach nothing; without labels the list is
empty and only the base rule drops. Repeated rows are judged alike. Windows of eight words are compared by 64-bit hashes.
Texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import settle

BLANK = r"[ \t-\r]"
WINDOW, BINS, MAX_RULES, MAX_TESTS, MIN_COVER, MIN_PRECISION = 8, 16, 10, 3, 5, 0.95
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that rules may test.
FEATURES = ["n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
            "mean_word", "mean_line", "digit_share", "stop_share", "capital_share"]


def with_covered(rows: DataFrame, width: int = WINDOW) -> DataFrame:
    """Add n_repeat_words: words in windows whose hash (column windows, in order) occurs twice or more.

    Arrays that a lambda looks into are columns of their own, so that each is made once a row.
    """
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("pairs", F.when(some, pairs))
    at = lambda k: F.get(F.col("pairs"), k)["h"]
    again = F.filter("pairs", lambda p, k: F.coalesce(at(k - 1) == p["h"], F.lit(False)) | F.coalesce(at(k + 1) == p["h"], F.lit(False)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(again, lambda p: p["i"])))
    spans = F.transform("starts", lambda s, k: F.least(F.lit(width), F.coalesce(F.get(F.col("starts"), k + 1) - s, F.lit(width))))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda t, n: t + n)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, and the shares that rules test."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.filter(F.split("text", BLANK + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \t-\r]")).alias("lines"))
    hashed = split.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))))
    rows = hashed.withColumn("windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    chars = F.length(F.regexp_replace("text", BLANK + "+", ""))
    base = with_covered(rows).select(
        "doc_id", n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("n_stops"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"))
    per = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return base.withColumns({
        "symbol_share": per("n_symbols", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"), "distinct_share": per("n_distinct", "n_words"),
        "mean_word": per("word_chars", "n_words"), "mean_line": per("n_words", "n_lines"),
        "digit_share": per("n_digits", "word_chars"), "stop_share": per("n_stops", "n_words"), "capital_share": per("n_capitals", "word_chars")})


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def holds(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Test, ...]


def all_hold(rule: Rule) -> Column:
    out = F.lit(True)
    for test in rule:
        out = out & test.holds()
    return out


def fired(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null where none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(all_hold(rule), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def gain(p: int, n: int, all_p: int, all_n: int) -> float:
    """Information gained about the p rows of the class when a test leaves p and n of all_p and all_n."""
    return p * (math.log2(p / (p + n)) - math.log2(all_p / (all_p + all_n))) if p else 0.0


def _best_test(rows: DataFrame, cuts: dict[str, list[float]]) -> Test | None:
    """The test with the largest gain among the given rows: one aggregate over them."""
    bins = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("bin")) for f in cuts])
    counts: dict[str, list[list[int]]] = {f: [[0, 0] for _ in range(len(c) + 1)] for f, c in cuts.items()}
    for r in rows.select("bad", F.inline(bins)).groupBy("f", "bin").agg(F.sum(F.col("bad").cast("int")).alias("p"), F.count("*").alias("n")).collect():
        counts[r["f"]][r["bin"]] = [r["p"], r["n"] - r["p"]]
    best, top = None, 1e-9
    for f, table in counts.items():
        all_p, all_n = (sum(x[i] for x in table) for i in (0, 1))
        low_p = low_n = 0
        for cut, (p, n) in zip(cuts[f], table):
            low_p, low_n = low_p + p, low_n + n
            for above, here in ((False, (low_p, low_n)), (True, (all_p - low_p, all_n - low_n))):
                if MIN_COVER <= sum(here) < all_p + all_n:
                    g = gain(*here, all_p, all_n)
                    # Of cuts that part the rows alike, the one that spares most of what lies between.
                    if g > top + 1e-9 or above and best and (best.feature, best.above) == (f, True) and abs(g - top) <= 1e-9:
                        best, top = Test(f, above, cut), g
    return best


def _prune(rule: Rule, rows: DataFrame) -> Rule | None:
    """The shortest beginning of a rule that is most precise on the given rows; None if it isn't precise enough."""
    prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
    found = rows.agg(*[F.struct(F.count_if(all_hold(p) & F.col("bad")).alias("p"), F.count_if(all_hold(p)).alias("n")).alias(f"k{k}") for k, p in enumerate(prefixes)]).first()
    scores = [((f["p"] + 1) / (f["n"] + 2) if f["n"] else 0.0) for f in found]
    best = max(range(len(prefixes)), key=lambda k: (scores[k], -k))
    return prefixes[best] if found[best]["n"] and found[best]["p"] >= MIN_PRECISION * found[best]["n"] else None


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many of the cuts lie under a statistic."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: F.col(feature) > cut))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn(stats: DataFrame, labels: DataFrame, max_rules: int = MAX_RULES) -> list[Rule]:
    """Rules for texts labelled quality 0 that the base rule lets pass, in order."""
    marked = labels.select(F.col("doc_id").alias("label_id"), (F.col("quality") == 0).alias("bad")).where("bad is not null").distinct()
    rows = stats.where(~base_failed()).join(marked, F.col("doc_id") == F.col("label_id")).select(*FEATURES, "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow"))
    shares = [k / BINS for k in range(BINS)] + [0.98, 0.99, 0.995]
    number = lambda f: F.col(f).cast("double")
    found = rows.agg(*[F.percentile_approx(number(f), shares, 1000).alias(f) for f in FEATURES], *[F.percentile_approx(F.when(F.col("bad"), number(f)), shares, 1000).alias(f"bad_{f}") for f in FEATURES]).first()
    cuts = {}
    for f in FEATURES:
        at = sorted({*(found[f] or ()), *(found[f"bad_{f}"] or ())})
        if len(at) > 1:
            cuts[f] = sorted({*at, *((a + b) / 2 for a, b in zip(at, at[1:]))})
    bins = {f"bin_{f}": _bin(f, c) for f, c in cuts.items()}
    rows = settle(rows.withColumns(bins), "op2-training") if cuts else rows
    rules: list[Rule] = []
    while cuts and len(rules) < max_rules:
        open_rows = rows.where(fired(rules).isNull())
        rule: Rule = ()
        while len(rule) < MAX_TESTS:
            test = _best_test(open_rows.where(F.col("grow") & all_hold(rule)), cuts)
            if test is None:
                break
            rule += (test,)
        pruned = _prune(rule, open_rows.where(~F.col("grow"))) if rule else None
        if pruned is None:
            break
        rules.append(pruned)
    return rules


def decisions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and the rule that dropped a text."""
    stats = settle(statistics(docs), "op2-statistics")
    rule = fired(learn(stats, labels))
    failed = base_failed()
    return stats.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & rule.isNull()).alias("kept"), rule.alias("fault"))
