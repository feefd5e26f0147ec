"""Benchmark decontamination, conversation repair and phrase mining against plain versions, and their edge cases."""

import random
from collections import defaultdict

import pytest

from codesieve.llm import conversation_repair, decontaminate, phrases
from tests.llm import plain

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n_words string, first double, part int, phrase string"
ITEMS = "item_id long, text string, name double, words string"
CONV = "conv_id long, turn long, role string, text string, gone string, copy double, block int, mark string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1.0, 2, "y") for i, t, lang in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], ITEMS)


def conversations_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0, 2, "y") for r in rows], CONV)


# ---- benchmark decontamination

def random_texts(seed, n, words="abcdef", longest=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(longest))) for _ in range(n)]


WORDS = ["the", "The", "of", "ünd", "a1", "x"]
ODD_ITEMS = [(1, None), (2, ""), (3, "!!"), (4, "Short item"), (4, "short ITEM"), (5, "one two three four five six seven eight nine ten eleven"),
             (None, "nameless words of an item"), (10, "short item"), (6, "single")]
ODD_DOCS = [(1, None, "en"), (2, "", None), (3, "a short-item; SHORT ITEM", "en"), (4, "x one two three four five six seven eight nine TEN y", "en"),
            (4, "nameless words of an item", "en"), (None, "Single", "en"), (7, "short " * 30_000 + "item", "en"), (8, "é" * 100_000, "de"), (9, "one two three four five six seven eight nine", "en")]


def findings(frame):
    return [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in frame.collect()]


def expected(docs, items):
    found = plain.contaminated([t for _, t, _ in docs], items)
    return [(d, len(w), len(h), len(n), plain.sha(",".join(n)), bool(h)) for (d, _, _), (w, h, n) in zip(docs, found)]


def same(a, b):
    return sorted(a, key=str) == sorted(b, key=str)


@pytest.mark.parametrize("part_chars", [decontaminate.PART_CHARS, 40])
def test_decontamination_equals_the_plain_version(spark, part_chars):
    assert same(findings(decontaminate.decisions(docs_of(spark, ODD_DOCS), items_of(spark, ODD_ITEMS), part_chars=part_chars)), expected(ODD_DOCS, ODD_ITEMS))
    docs = [(i, t, "en") for i, t in enumerate(random_texts(1, 80, WORDS))]
    items = list(enumerate(random_texts(2, 12, WORDS, 25)))
    assert same(findings(decontaminate.decisions(docs_of(spark, docs), items_of(spark, items), part_chars=10 * part_chars)), expected(docs, items))


def test_decontamination_of_the_given_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"], None) for r in docs.collect()]
    want = expected(rows, [tuple(r) for r in items.select("item_id", "text").collect()])
    assert same(findings(decontaminate.decisions(docs, items)), want) and any(r[-1] for r in want)


def test_long_items_are_cut_into_segments_that_hold_every_window(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 14)
    items = [(1, " ".join(f"w{i}" for i in range(100))), (2, "only three words")]
    docs = [(i, " ".join(f"w{j}" for j in range(i, i + 10)), "en") for i in range(95)] + [(200, "only three words", "en")]
    assert same(findings(decontaminate.decisions(docs_of(spark, docs), items_of(spark, items), part_chars=60)), expected(docs, items))


def test_spans_and_documents_are_removed(spark):
    docs, items = docs_of(spark, ODD_DOCS), items_of(spark, ODD_ITEMS)
    left = {(r["doc_id"], r["text"]) for r in decontaminate.clean(docs, items).collect()}
    assert (3, "a ") in left and (4, "x  y") in left and (1, None) in left and (None, "") in left and (9, "one two three four five six seven eight nine") in left
    whole = decontaminate.clean(docs, items, whole=True)
    hit = {i for i, _, _ in ODD_DOCS} & {r[0] for r in expected(ODD_DOCS, ODD_ITEMS) if r[-1]}
    assert whole.columns == docs.columns and whole.count() == sum(not r[-1] for r in expected(ODD_DOCS, ODD_ITEMS)) and hit
    assert decontaminate.clean(docs, items).count() == len(ODD_DOCS)


def test_decontamination_without_rows(spark):
    docs, items = docs_of(spark, ODD_DOCS), items_of(spark, ODD_ITEMS)
    assert decontaminate.decisions(docs.limit(0), items).collect() == []
    assert not any(r[-1] for r in findings(decontaminate.decisions(docs, items.limit(0))))


# ---- conversation repair

def repairs(frame):
    return {r["conv_id"]: tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in frame.collect()}


def plain_repairs(damaged):
    return {c: (w := plain.repair(rows))[:7] + (plain.sha(w[7]),) for c, rows in damaged.items()}


def random_conversations(seed, n, longest=12):
    rng, out = random.Random(seed), []
    for conv in range(n):
        for turn in sorted(rng.sample(range(longest * 2), rng.randrange(longest))):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "admin"])
            out.append((conv, turn if rng.random() > 0.1 else None, role, rng.choice(["Yes.", "No!", "cut", " ", None, "Why?\n", "  \t"])))
    return out


def test_repair_equals_the_plain_version(spark):
    rows = random_conversations(7, 300)
    damaged = plain.damage(rows)
    assert repairs(conversation_repair.decisions(conversations_of(spark, rows))) == plain_repairs(damaged)


def test_repair_of_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    damaged = plain.damage([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert repairs(conversation_repair.decisions(table)) == plain_repairs(damaged)


def test_one_conversation_may_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", 16)
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant", "assistant"]), rng.choice([f"Turn {t % 40}.", "cut off", "", f"Own {t}!"])) for t in range(1500)]
    rows += [(c, t, rng.choice(["user", "assistant"]), "Well.") for c in (1, 4, 6, 9, None) for t in range(7)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = repairs(conversation_repair.decisions(conversations_of(spark, rows)))
        blocks = conversation_repair.repair(conversations_of(spark, rows)).where("conv_id = 5").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain_repairs(plain.damage(rows))
    assert len({b["part"] for b in blocks}) >= 5 and max(len(b["edits"]) for b in blocks) < 100


def test_repair_of_odd_rows(spark):
    rows = [(1, 0, "user", "x" * 200_000 + "."), (2, 3, "assistant", "Same."), (2, 3, "assistant", "Same."), (2, 3, "user", "Same."), (None, None, None, None),
            (3, 0, "User", "Capital."), (4, 1, "system", "Only this.")]
    assert repairs(conversation_repair.decisions(conversations_of(spark, rows))) == plain_repairs(plain.damage(rows))
    assert conversation_repair.decisions(conversations_of(spark, rows[:1]).limit(0)).collect() == []
    turns = conversation_repair.repair(conversations_of(spark, [(4, 1, "assistant", "Hi."), (4, 2, "assistant", "There.")])).collect()
    # Making the first of the two the user's turn costs least.
    assert ["".join(t["edits"] for t in turns)] == ["RK"]


def test_checkpointed_walk_is_tight():
    rng = random.Random(11)
    for n in (0, 1, 2, 5, 40, 300):
        forms = [(rng.choice("usat"), rng.choice(["", "", "blank", "truncated"])) for _ in range(n)]
        v = conversation_repair.END
        for row in reversed(forms):
            v = conversation_repair.before(row, v)
        cost, state = 0, 0
        for i, edit, after in conversation_repair.walk(forms, conversation_repair.END, 0):
            cost += conversation_repair.INSERT if edit == "I" else {e: c for e, c, to in conversation_repair.moves(*forms[i])[state] if to == after}[edit]
            state = after
        assert cost + conversation_repair.INSERT * len(list(conversation_repair.closing(state))) == v[0]


# ---- phrase mining

def mined(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_phrases_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert mined(phrases.collocations(docs)) == sorted(plain.collocations([(r["lang"], r["text"]) for r in docs.collect()]))


@pytest.mark.parametrize("share,low,max_bits", [(0.5, 2, 1 << 20), (0.02, 3, 1 << 20), (0.5, 1, 64)])
def test_phrases_whatever_the_sample_proposes(spark, share, low, max_bits, monkeypatch):
    monkeypatch.setattr(phrases, "MIN_BITS", 64)
    monkeypatch.setattr(phrases, "HELD_WORDS", 500)
    rng, rows = random.Random(9), []
    for i in range(400):
        pieces = [" ".join(rng.choice(["go", "GO", "on", "and", "Éa", "x\x00y", "the", "the", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(5))]
        rows.append((i, rng.choice([". ", "\n", ";", "\t!"]).join(pieces), rng.choice(["en", "en", None, "und", "de"])))
    rows += [(900, None, "en"), (901, "", "xx"), (902, "go on " * 2000, "en"), (903, "same same same", "de"), (903, "same same same", "de")]
    want = sorted(plain.collocations([(lang, t) for _, t, lang in rows]))
    docs = docs_of(spark, rows)
    assert mined(phrases.collocations(docs, share=share, low=low, max_bits=max_bits)) == want and len(want) > 50
    assert mined(phrases.collocations(docs, top=7, share=share)) == sorted(r for r in want if r[1] <= 7)


def test_a_poor_sample_takes_an_expansion_pass(spark, monkeypatch):
    docs = docs_of(spark, [(i, "rare words stand here together " * (1 + i % 3), "en") for i in range(12)])
    passes, count = [], phrases.count
    monkeypatch.setattr(phrases, "count", lambda *a: passes.append(a[3]) or count(*a))
    out = phrases.frequent(docs, share=0.0).collect()
    # Nothing is proposed: all words fail, and one expansion counts their pairs and triples.
    assert passes == [(1, 2), (1, 2, 3), (2, 3)]
    found = defaultdict(int, {r["phrase"]: r["n"] for r in out})
    assert found["stand here together"] == found["rare"] == 24 and found["together rare words"] == 12
    assert len({(r["lang"], r["phrase"]) for r in out}) == len(out)


def test_phrases_without_rows(spark):
    docs = docs_of(spark, [(1, None, "en"), (2, "one two", None)])
    assert phrases.collocations(docs.limit(0)).collect() == [] and phrases.collocations(docs).collect() == []
