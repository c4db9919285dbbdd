"""Splitting and encoding pre-tokens gives what the library gives for whole texts."""

import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from prosegauge.llm.pieces import PLAIN, splitter

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PLAIN_CHARS = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and not regex.match(PLAIN, c)]


def by_pieces(split, text):
    pieces = split.pieces(text)
    return split.whole(text) if pieces is None else [i for ids in split.encoded(pieces) for i in ids]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("around", ["{}", "a{}b", "1{}2", " {} ", "!{}!", "{0}{0}", "\n{}s"])
def test_every_plain_code_point(name, around):
    split = splitter(public_tokenizers.path(name))
    texts = [around.format(c) for c in PLAIN_CHARS]
    whole = [e.ids for e in split.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert all(split.pieces(t) is not None for t in texts)
    flat = [p for t in texts for p in split.pieces(t)]
    ids = dict(zip(flat, split.encoded(flat), strict=True))
    got = [[i for p in split.pieces(t) for i in ids[p]] for t in texts]
    assert [t for t, a, b in zip(texts, got, whole, strict=True) if a != b] == []


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("aéßİΣς1½ \n\t\x1c\x85 'sltreved!<|endofx>é‍中")))
def test_any_text(name, text):
    split = splitter(public_tokenizers.path(name))
    assert by_pieces(split, text) == split.whole(text)
