"""Dedup, packing, BPE, line dedup and language ID against plain versions, and their edge cases."""

import os
import random

import pytest

from codesieve.llm import bpe, components, exact_dedup, language_id, line_dedup, near_dedup, packing
from tests.llm import plain

SMALL = "/root/testdata/sf0.001/documents.parquet"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "Abc abc"), (5, "abc ABC"), (5, "abc ABC"), (6, "É é ß"), (None, "no id here at all"),
       (None, None), (7, "x" * 300_000), (8, "word " * 40_000), (9, "<|endoftext|>a'S \x00\x1ć")]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_tokenizer(bpe.default_tokenizer()))


def odd(spark):
    rows = [(i, t, "en" if n % 2 else None, None, None, "x", 1.0) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA + ", keep_id string, row double")


def make(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def test_odd_rows_and_empty_tables(spark):
    rows, none = odd(spark), odd(spark).limit(0)
    for run in (exact_dedup.decisions, near_dedup.link, packing.pieces, bpe.digests, line_dedup.decisions, language_id.decisions):
        out = run(rows).collect()
        assert {r["doc_id"] for r in out} == {i for i, _ in ODD}
        assert run(none).collect() == []
    for run in (exact_dedup.deduplicate, near_dedup.deduplicate, language_id.accepted):
        assert run(rows).columns == rows.columns
        assert run(none).collect() == []


def test_exact_dedup(spark):
    out = {r["doc_id"]: r for r in exact_dedup.decisions(odd(spark)).collect()}
    assert (out[4]["keep_id"], out[4]["group_size"], out[4]["kept"]) == (5, 3, False)
    assert out[1]["keep_id"] == 2 and out[1]["group_size"] == 3
    assert out[6]["keep_id"] == 6 and out[6]["text_sha256"] == plain.sha(plain.lower("É é ß"))
    stay = exact_dedup.deduplicate(odd(spark)).select("doc_id").collect()
    assert sorted(r[0] for r in stay if r[0]) == [2, 3, 5, 6, 7, 8, 9]


def test_exact_dedup_in_a_crowded_filter(spark):
    texts = [f"text {i % 700}" for i in range(1000)]
    out = exact_dedup.decisions(make(spark, texts), max_bits=256).collect()
    assert all(r["keep_id"] == max(r["doc_id"] % 700, r["doc_id"] % 700 + 700 if r["doc_id"] % 700 < 300 else 0) for r in out)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)] + [(7, 7), (None, 3)]
    top = {}
    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    out = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in out} == {n: find(n) for n in top} and len(out) == len(top)


def test_near_dedup_on_the_given_table(spark):
    docs = spark.read.parquet(SMALL)
    want = plain.near_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.link(docs).collect()}
    assert got == want


def test_near_dedup_on_chains_and_shared_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, passage = [], [word() for _ in range(60)]
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(40):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randrange(1, 7)):
                base[rng.randrange(len(base))] = word()
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(5, 60))]) for _ in range(120)]
    texts += ["a b c", "A b\tc", "a b", "one two three four five", "one two three four five six"]
    rng.shuffle(texts)
    docs = make(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.link(docs).collect()}
    assert got == plain.near_components(list(enumerate(texts)))


def test_packing(spark, encoder):
    docs = spark.read.parquet(SMALL)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert plain.check_packing(rows, packing.pieces(docs).collect(), encoder.encode) < 0.01
    texts = [None, "", "a", "b " * 9000] + ["c " * n for n in range(4000, 4200, 7)]
    docs = make(spark, texts)
    assert plain.check_packing(list(enumerate(texts)), packing.pieces(docs).collect(), encoder.encode) < 0.05


def test_nnls_fits_what_can_be_fitted():
    shapes = packing.plan({100: 50, 156: 50, 64: 40, 96: 20, 256: 7})
    repeats = {s: round(n, 3) for s, n in shapes}
    assert repeats[(256,)] == 7 and repeats[(100, 156)] == pytest.approx(50, abs=1e-2)
    # Of 40 and 20 pieces, x times (64, 96, 96): the squares (40 - x)^2 + (20 - 2x)^2 are least at x = 16.
    assert repeats[(64, 96, 96)] == pytest.approx(16, abs=1e-2)


def test_bpe_equals_the_library(spark, encoder):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.default_tokenizer())
    rng = random.Random(1)
    letters = "ab'st  \n\t\x1c\x85éÉß́̇İıΣς中<|endoftext|> 12#*'ll 'S ﬁ​ªµ×÷À\x7f\x00\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) + "<|endoftext|>" * (i % 9 == 0) for i in range(3000)]
    texts += [r["text"] for r in spark.read.parquet(SMALL).collect()] + ["zq" * 5000, "qzxj" * 50]
    rows = {r["doc_id"]: r for r in bpe.encode(make(spark, texts)).collect()}
    hashes = {r["doc_id"]: r for r in bpe.digests(make(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert rows[i]["ids"] == ids and rows[i]["decoded"] == decoded
        assert hashes[i]["n_tokens"] == len(ids) and hashes[i]["ids_sha256"] == plain.sha(" ".join(map(str, ids))) and hashes[i]["decoded_sha256"] == plain.sha(decoded)


def test_line_dedup_is_reversible(spark):
    rng = random.Random(2)
    pool = [f"Line number {i} that is shared by some" for i in range(30)]
    texts = ["\n".join([rng.choice(pool) for _ in range(4)] + ["short", f"own line {i} of this one document"]) for i in range(60)]
    docs = make(spark, texts)
    whole = line_dedup.insert(line_dedup.empty(spark, 4), docs)
    parts = line_dedup.insert(line_dedup.insert(line_dedup.empty(spark, 4), docs.where("doc_id < 40")), docs.where("doc_id >= 30"))
    back = line_dedup.delete(parts, docs.where("doc_id >= 50").select("doc_id"))
    less = line_dedup.insert(line_dedup.empty(spark, 4), docs.where("doc_id < 50"))
    key = lambda s: sorted(map(tuple, s.refs.select("k1", "k2", "refs", "max_doc").collect()))
    assert key(whole) == key(parts) and key(back) == key(less)
    again = line_dedup.insert(back, docs)
    assert key(again) == key(whole)
    assert {r["doc_id"]: r["cleaned"] for r in line_dedup.clean(back, docs.where("doc_id < 50")).collect()} == \
        {r["doc_id"]: r["cleaned"] for r in line_dedup.clean(less, docs.where("doc_id < 50")).collect()}
    # Every key in refs has its fingerprint.
    filters = {r["shard"]: line_dedup.CuckooFilter(r["data"]) for r in again.filters.collect()}
    for r in again.refs.collect():
        assert (r["k1"] % (1 << 64), r["k2"] % (1 << 64)) in filters[r["k1"] % 4]


def test_shards_grow_with_the_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 50)
    monkeypatch.setattr(line_dedup, "MIN_SHARDS", 1)
    docs = make(spark, ["\n".join(f"line {j} of those in document {i // 2}" for j in range(10)) for i in range(60)])
    first = line_dedup.insert(line_dedup.empty(spark), docs.where("doc_id < 4"))
    state = line_dedup.insert(first, docs.where("doc_id >= 3"))
    assert first.shards == 1 and state.refs.count() == 300 and state.shards >= 6
    filters = {r["shard"]: line_dedup.CuckooFilter(r["data"]) for r in state.filters.collect()}
    assert len(filters) == state.filters.count() == state.shards
    for r in state.refs.collect():
        assert r["refs"] == 2 and (r["k1"] % (1 << 64), r["k2"] % (1 << 64)) in filters[r["k1"] % state.shards]
    left = line_dedup.delete(state, docs.select("doc_id"))
    assert left.refs.count() == 0 and not any(any(line_dedup.CuckooFilter(r["data"]).table) for r in left.filters.collect())


def test_cuckoo_filter_grows_and_forgets():
    rng = random.Random(4)
    keys = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(40_000)]
    cuckoo = line_dedup.CuckooFilter()
    for k in keys:
        cuckoo.add(k)
    cuckoo = line_dedup.CuckooFilter(cuckoo.to_bytes())
    assert all(k in cuckoo for k in keys)
    assert all(cuckoo.remove(k) for k in keys) and not any(cuckoo.table)


def test_cuckoo_filter_keeps_what_was_not_removed():
    rng = random.Random(6)
    keys = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(300_000)]
    cuckoo = line_dedup.CuckooFilter()
    for k in keys:
        cuckoo.add(k)
    assert all(cuckoo.remove(k) for k in keys[::2])
    assert all(k in cuckoo for k in keys[1::2])
    assert sum(k in cuckoo for k in keys[::2]) < 20 and sum(map(bool, cuckoo.table)) == 150_000


def test_recent_table_keeps_what_is_asked_for():
    table, made = bpe.Recent(size=20), []

    def make(keys):
        made.extend(keys)
        return {k: k.upper() for k in keys}
    for n in range(200):
        keys = ["common", f"rare {n}", "common", "rare 0"] if n % 50 else [f"many {k}" for k in range(15)]
        found = table.filled(keys, make)
        assert all(found[k] == k.upper() for k in keys)
        assert len(table.young) <= 10 and len(table.old) <= 10
    assert made.count("common") <= 4 and made.count("rare 7") == 1 and "rare 1" not in table.young and "rare 1" not in table.old


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = language_id.decisions(docs).collect()
    tested = [r for r in out if r["held_out"] and truth[r["doc_id"]]]
    assert len(tested) > 150
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in tested) >= 0.97 * len(tested)
    assert sum(r["rejected"] for r in out) <= 0.01 * len(out) and all(0 <= r["score"] <= 1 for r in out)


def test_language_id_rejects_what_it_never_saw(spark):
    rows = [(i, "the cat and the dog went to the house " * 3, "en", "s", 1) for i in range(20)] + [(90, "привет мир как дела " * 5, None, "s", 1), (91, "123 456", None, "s", 1)]
    out = {r["doc_id"]: r for r in language_id.decisions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[90]["rejected"] and out[91]["lang_pred"] == "und" and out[91]["rejected"] and not out[3]["rejected"]


def test_no_module_of_the_library_imports_llm():
    root = os.path.join(os.path.dirname(__file__), "../../codesieve")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, name), encoding="utf-8").read()
