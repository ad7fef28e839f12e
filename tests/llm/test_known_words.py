"""The encoder asks the library for a word once while it is known, and gives the library's ids."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from passagemill.llm.tokenizing import TextEncoder

TEXTS = ["one two three", "four's five, six\nseven  eight ", " nine´ten ́x", "", "one", "Ǆ ﬁ \x01 1234 é́ \ta b", "<|endoftext|> a", "two \x01two 漢字 👍🏽 a b"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("known_words", [0, 5, 400_000])
def test_batches_give_the_ids_of_the_library(name, known_words):
    encoder = TextEncoder(public_tokenizers.path(name), chunk_chars=16, slice_words=3, known_words=known_words)
    batches = [TEXTS, TEXTS[::-1], ["five six seven eight nine ten"], TEXTS[2:5], TEXTS]
    found = [[np.frombuffer(x, "<u4").tolist() for x in told] for told in encoder.encode_batches(pa.array(b, pa.string()) for b in batches)]
    assert found == [[encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in b] for b in batches]


def test_words_stay_known_over_a_batch_without_them(monkeypatch):
    encoder = TextEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked = []
    encode_words = encoder.encode_words
    monkeypatch.setattr(encoder, "encode_words", lambda words: asked.extend(words) or encode_words(words))
    for told in encoder.encode_batches(pa.array([t], pa.string()) for t in ("a bb cc", "d ee", "a bb cc")):
        list(told)
    assert len(asked) == len(set(asked))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_marks_and_line_feeds_make_no_new_words(name, monkeypatch):
    """A word is asked for once, whatever marks or line feeds follow it; ids are the library's."""
    encoder = TextEncoder(public_tokenizers.path(name))
    asked = []
    encode_words = encoder.encode_words
    monkeypatch.setattr(encoder, "encode_words", lambda words: asked.extend(words) or encode_words(words))
    texts = ["a one two one, two. jamí", "a one... two!\nthree\n\nfour\n\n\nfive one&&& jamí.", "a"]
    told = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)]
    assert told == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [w for w in asked if "one" in w] == ["one"]
    assert [w for w in asked if "jam" in w] == ["jamí"]


def test_slices_hold_few_bytes():
    from passagemill.llm.tokenizing import in_slices

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["ab", "", None, "cde", "x" * 50, "f"])})
    found = [s.column(0).to_pylist() for s in in_slices([batch.slice(1), batch.slice(0, 0)], 0, 4)]
    assert found == [["", None, "cde"], ["x" * 50], ["f"]]
