"""BPE encoding and decoding with forced boundaries.

A pair of adjacent bytes that occurs inside no vocabulary token can be crossed by no merge, so a text may be cut there:
fragments are encoded independently and their ids concatenated. White space is the plainest case (its bytes occur in no
token); within a word, the pairs of the vocabulary decide. Fragments repeat a lot, so each worker keeps a bounded table of
those it has met lately. Only the last fragment of a word carries the word-end mark; the others use the same merges without it.

A text's special-token strings become their ids, as the tokenizers library does by default. Null text counts as empty,
and an empty text has no ids. The tokenizer file is read once, on the driver, and broadcast: a file of fixed size.
Texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from array import array
from itertools import chain, filterfalse
from typing import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from codesieve.llm.common import apart, ship, small_batches

#: Entries a worker keeps of each table, in two generations.
TABLE_SIZE = 500_000
BLANKS = str.maketrans("\t\n\r", "   ")
#: Texts of these characters only are in normal form, but for case.
PLAIN = re.compile("[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*").fullmatch


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    names = {b: chr(256 + n) for n, b in enumerate(others)}
    return [names.get(b, chr(b)) for b in range(256)]


class Recent:
    """A table of bounded size that forgets what was not asked for lately.

    New entries go to the young generation. When that holds half of `size`, it becomes the old one and what was old is
    dropped. An entry found in the old generation is young again, so common ones stay.
    """

    def __init__(self, size: int = TABLE_SIZE):
        self.half, self.young, self.old = size // 2, {}, {}

    def filled(self, keys: Iterable, make: Callable[[list], dict]) -> dict:
        """A dictionary that holds all keys; make(keys) gives the entries of those that are in neither generation."""
        before, old = self.young, self.old
        unmet = set(filterfalse(before.__contains__, keys))
        kept = {k: old[k] for k in unmet if k in old}
        fresh = make([k for k in unmet if k not in kept])
        for entries in (kept, fresh):
            if len(self.young) + len(entries) > self.half:
                self.young, self.old = {}, self.young
            if len(entries) <= self.half:
                self.young.update(entries)
        return before if self.young is before and len(fresh) <= self.half >= len(kept) else {**before, **kept, **fresh}


class Encoder:
    """Encodes by fragments; `source` is the text of a tokenizer file whose words end in a suffix."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab, merges, suffix = spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]], spec["model"]["end_of_word_suffix"]
        # Words come to the models in the byte alphabet, so this one only normalises.
        self.normalizer = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "post_processor": None, "model": {**spec["model"], "vocab": {}, "merges": []}})).normalizer
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        # The same pattern for texts of PLAIN characters only, which no normal form changes.
        self.plain_words = re.compile(pattern.replace(r"\p{L}", "a-z\xdf-\xf6\xf8-\xff").replace(r"\p{N}", "0-9")).findall
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.names = {i: t for t, i in {**vocab, **self.specials}.items()}
        self.ends = np.zeros(max(self.names) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        bare = (t.removesuffix(suffix) for t in vocab)
        inside = {t[i:i + 2] for t in bare for i in range(len(t) - 1)}
        alphabet = byte_alphabet()
        self.letters = np.array([ord(c) for c in alphabet], "<u4")
        self.letters[10] = 10  # stands between words
        # Pairs of bytes that no token holds; a line feed, which stands between words here, makes none.
        self.forced = np.array([[a != 10 != b and x + y not in inside for b, y in enumerate(alphabet)] for a, x in enumerate(alphabet)])
        self.parts: dict[tuple[str, bool, type], bytes] = {}
        # Words are new when they get here, so the models' own caches would only fill up.
        self.last, self.inner = (models.BPE(vocab, merges, cache_capacity=0, **more) for more in ({"end_of_word_suffix": suffix}, {}))
        self.together = Tokenizer(self.last)
        self.together.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def words(self, text: str) -> list[str]:
        """The words of a text in its normal form."""
        if text.isascii() and text.isalpha():
            return [text.lower()]
        if PLAIN(text):
            return self.plain_words(text.lower())
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def word_ids(self, words: list[str], width: type = np.uint32) -> list[bytes]:
        """Ids of each word, as numbers of this width. Whole words and fragments are cut out of one buffer of all words.

        Words without a forced cut go to the library together, already in the byte alphabet.
        """
        data = np.frombuffer("\n".join(words).encode(), np.uint8)
        letters = self.letters[data]
        cuts = np.flatnonzero(self.forced[data[:-1], data[1:]]) + 1
        inner = np.bincount(np.cumsum(data == 10)[cuts], minlength=len(words))
        whole = inner == 0
        fragments = np.insert(letters, cuts, 10).tobytes().decode("utf-32-le").split("\n")
        stops = np.cumsum(inner + 1)
        ids = self._encoded([fragments[i] for i in (stops[whole] - 1).tolist()] if len(cuts) else fragments, width)
        if not len(cuts):
            return ids
        out: list[bytes] = [b""] * len(words)
        for n, word in zip(np.flatnonzero(whole).tolist(), ids):
            out[n] = word
        for n, stop, size in zip(np.flatnonzero(~whole).tolist(), stops[~whole].tolist(), inner[~whole].tolist()):
            parts = [self._part(f, self.inner, width) for f in fragments[stop - 1 - size:stop - 1]]
            out[n] = b"".join([*parts, self._part(fragments[stop - 1], self.last, width)])
        return out

    def _encoded(self, words: list[str], width: type) -> list[bytes]:
        """Ids of each word without a cut, all in one call."""
        ids = np.asarray(self.together.encode("\n".join(words), add_special_tokens=False).ids, width)
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def _part(self, fragment: str, model: models.BPE, width: type) -> bytes:
        """Ids of a fragment, which has few forms once it is cut off its word."""
        key = (fragment, model is self.last, width)
        ids = self.parts.get(key)
        if ids is None:
            ids = np.array([t.id for t in model.tokenize(fragment)], width).tobytes()
            if len(self.parts) >= TABLE_SIZE // 10:
                self.parts.clear()
            self.parts[key] = ids
        return ids

    def pieces(self, text: str | None) -> list[str | tuple[str]]:
        """The words of a text in its normal form; a special token stands alone, as a tuple."""
        if not text:
            return []
        if "<|" in text:
            parts = self.special.split(text)
            return [w for n, p in enumerate(parts) for w in ([(p,)] if n % 2 else self.pieces(p) if p != text else self.all_words(p))]
        return self.all_words(text)

    def all_words(self, text: str) -> list[str]:
        if PLAIN(text):
            return self.plain_words(text.lower())
        return [w for c in text.translate(BLANKS).split(" ") if c for w in self.words(c)]

    def new_ids(self, pieces: list, width: type = np.uint32) -> Iterator[bytes]:
        words = [p for p in pieces if isinstance(p, str)]
        ids = dict(zip(words, self.word_ids(words, width))) if words else {}
        for piece in pieces:
            yield ids[piece] if isinstance(piece, str) else width(self.specials[piece[0]]).tobytes()

    def forms(self, texts: list[str | None], table: Recent, form: Callable | None, width: type = np.uint32) -> Iterator[list]:
        """For each text, form(ids) of its words in order, through a table that the caller keeps; without a form, the ids
        as bytes of this width."""
        lists = [self.pieces(t) for t in texts]
        made = lambda new: self.new_ids(new, width) if form is None else (form(array("I", ids)) for ids in self.new_ids(new))
        known = table.filled(chain.from_iterable(lists), lambda new: dict(zip(new, made(new))))
        for pieces in lists:
            yield list(map(known.__getitem__, pieces))

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in next(self.forms([text], Recent(), list)) for i in ids]

    def listed(self, ids: array) -> tuple[str, str]:
        """Ids and tokens as text, a blank before each."""
        return "".join([f" {i}" for i in ids]), "".join([" " + self.names[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Tokens by name, joined as the library joins them where the file names no decoder."""
        return " ".join([self.names[i] for i in ids if i in self.names])


def groups(texts: list[str | None], limit: int = 1 << 20) -> Iterator[list[str | None]]:
    """Runs of texts of about `limit` characters together; a longer text stands alone."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text or "") > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text or "")
    if run:
        yield run


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that only a slice's texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def worker_encoder(source: str, kind: str) -> tuple[Encoder, dict]:
    """The encoder of this worker process and its table of one kind of forms; tasks that follow go on with them."""
    store = sys.modules.setdefault("_codesieve_worker", types.ModuleType("_codesieve_worker")).__dict__
    key = hashlib.sha256(source.encode()).hexdigest()
    if store.get("key") != key:
        store.update(key=key, encoder=Encoder(source), tables={})
    return store["encoder"], store["tables"].setdefault(kind, Recent())


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), decoded (text of those ids) for every row."""
    small_batches(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer or default_tokenizer()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = worker_encoder(source.value, "ids")
        for batch in sliced(batches):
            at = 0
            for texts in groups(batch.column("text").to_pylist()):
                ids = [[i for w in words for i in w] for words in encoder.forms(texts, table, list)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array(map(encoder.decode, ids), pa.string())],
                    ["doc_id", "ids", "decoded"])
                at += len(texts)
    return apart(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode() gives, hashed where it arises."""
    small_batches(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer or default_tokenizer()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = worker_encoder(source.value, "digests")
        for batch in sliced(batches):
            out: list[list] = [[], [], []]
            for texts in groups(batch.column("text").to_pylist()):
                for parts in encoder.forms(texts, table, encoder.listed):
                    ids, decoded = "".join([p[0] for p in parts])[1:], "".join([p[1] for p in parts])[1:]
                    out[0].append(ids.count(" ") + bool(ids))
                    out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return apart(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


ship(__name__)
