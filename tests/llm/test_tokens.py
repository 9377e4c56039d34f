"""Encoding, decoding and counting against the tokenizers library itself."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import bpe, token_counts

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = ["the", "ing", " ", "\n", "a", "b", "é", "0", "9", "'", "s", "!", "\t", "ſ", "ß", "—", "\xa0", "İ", "æ", "ḿ", "Ⱥ", "Σ", "日", "<|endoftext|>", "'re", "\x1c", "\x85"]


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    return ["", "  a  b\n\n c", " <|endoftext|>x<|startoftext|>", "x" * 5000, "aAbB" * 400, "İΣΑΣ ǅ", "😀😀 é é", "<|endoftext", "1234 ²³½ ٣", *made]


@pytest.mark.parametrize("text", [None])
def test_codec_equals_library(text):
    codec, library = bpe.Codec(BYTE), Tokenizer.from_file(BYTE)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert got.tolist() == want
        assert codec.decimals(got).decode() == ",".join(map(str, want))
        assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


def test_codec_cache_may_be_tiny(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    codec, library = bpe.Codec(BYTE), Tokenizer.from_file(BYTE)
    text = "many words that do not fit into so small a cache, many words"
    assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_counter_equals_library():
    counter, library = token_counts.TokenCounter(WORD), Tokenizer.from_file(WORD)
    counter.load({"the": 1, "ing": 1})
    for text in texts():
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_odd_rows(odd, nothing):
    library = Tokenizer.from_file(BYTE)
    got = bpe.encode_decode(odd, BYTE).collect()
    assert len(got) == odd.count() and bpe.encode_decode(nothing, BYTE).count() == 0
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect())
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert {r.decoded_sha256 for r in got if r.doc_id == 5} == {hashlib.sha256(odd.where("doc_id = 5").first().text.encode()).hexdigest()}
    library = Tokenizer.from_file(WORD)
    got = token_counts.token_counts(odd, WORD, limit=50).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 50) for r in got)
    assert token_counts.token_counts(nothing, WORD, 50).count() == 0
