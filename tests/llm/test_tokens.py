"""How often texts and their pieces go to the tokenizer libraries."""

import numpy as np
import public_tokenizers
import pytest

from flowgauge.llm.common import process_cache
from flowgauge.llm.tokens import Encoder, Known


def test_known_keeps_what_is_met_again():
    known, asked = Known(300, latest=10), []

    def ask(keys):
        def encode(places):
            asked.extend(keys[places].tolist())
            return [np.array([k, k + 1], dtype=np.uint32).tobytes() for k in keys[places].tolist()]

        flat, begin, size = known.ids_of(keys, encode)
        assert [flat[b : b + s].tolist() for b, s in zip(begin, size, strict=True)] == [[k, k + 1] for k in keys.tolist()]

    often = np.arange(20, dtype=np.uint64)
    for turn in range(200):
        ask(np.concatenate([often, np.arange(1000 + 5 * turn, 1005 + 5 * turn, dtype=np.uint64)]))
        assert len(known.keys) + len(known.latest) <= 300
    assert len([k for k in asked if k < 20]) == 20 and len(asked) == 20 + 1000


@pytest.mark.parametrize("text", ["it's  'tis 're-ab 12a, \t x\n\n (b) 't", "a <|endoftext|> b <| endoftext|>", "é ü É  ", " ", "ab" * 50])
def test_pieces_of_a_space_go_together(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    process_cache().pop(("tokenizer", path), None)
    encoder = Encoder(path, "byte")
    found = encoder.encode([text, f"{text} {text}"])
    for got, want in zip(found, [text, f"{text} {text}"], strict=True):
        assert got.tolist() == encoder.library.encode(want, add_special_tokens=False).ids


def test_new_pieces_make_few_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    process_cache().pop(("tokenizer", path), None)
    encoder, sent = Encoder(path, "byte"), []

    class Library:
        def encode_batch_fast(self, texts, **kwargs):
            sent.extend(texts)
            return real.encode_batch_fast(texts, **kwargs)

    real, encoder.library = encoder.library, Library()
    text = "".join(f" word{'x' * (i % 7)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i}," for i in range(2000))
    assert encoder.encode([text])[0].tolist() == real.encode(text, add_special_tokens=False).ids
    assert len(sent) < 3000 and max(map(len, sent)) > 1000
