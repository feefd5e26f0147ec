"""The encoder reads new words together: one buffer, one call of the library, ids in the width that is stored."""

import numpy as np
from tokenizers import Tokenizer

from codesieve.llm import bpe


def test_the_encoder_cuts_all_new_words_out_of_one_buffer_and_calls_the_library_once():
    encoder = bpe.Encoder(bpe.read_tokenizer(bpe.default_tokenizer()))
    library = Tokenizer.from_file(bpe.default_tokenizer())
    calls, together = [], encoder.together

    class Counted:
        def encode(self, text, **more):
            calls.append(text)
            return together.encode(text, **more)
    encoder.together = Counted()
    words = ["plain", "日本日本", "x" * 3000, "é", "...", "naïve", "zq日xé", "straße"]
    for width in (np.uint16, np.uint32):
        got = [np.frombuffer(ids, width).tolist() for ids in encoder.word_ids(words, width)]
        assert got == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert len(calls) == 2
    assert encoder.encode("a<|endoftext|> 日本 b") == library.encode("a<|endoftext|> 日本 b", add_special_tokens=False).ids
