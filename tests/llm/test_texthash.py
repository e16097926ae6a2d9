from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import texthash
from tessera.llm.texthash import alnum_words, ngrams, whitespace_words, word_slices


def split(text, pattern):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(pattern, lowered)


@pytest.mark.parametrize(("inside", "pattern"), [(whitespace_words(), r"[^\x20\x09-\x0D]+"), (alnum_words(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@pytest.mark.parametrize("size", [1 << 20, 16, 3])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("aB \n\té日0-!"), max_size=40), max_size=8))
def test_words_are_those_of_the_pattern(inside, pattern, size, texts):
    before, texthash.SLICE_BYTES = texthash.SLICE_BYTES, size
    try:
        known, got = {}, {}
        for row, counts, hashes in word_slices(pa.array([*texts, None], pa.string()), inside):
            for i, part in enumerate(np.split(hashes, np.cumsum(counts)[:-1])):
                got[row + i] = part.tolist()
        for i, text in enumerate(texts):
            want = split(text, pattern)
            assert len(got[i]) == len(want)
            assert all(known.setdefault(w, h) == h for w, h in zip(want, got[i], strict=True))
        assert len(set(known.values())) == len(known) and got[len(texts)] == []
    finally:
        texthash.SLICE_BYTES = before


def test_ngrams_depend_on_order():
    words = np.arange(10, dtype=np.uint64)
    assert len(np.unique(ngrams(words, 3))) == 8 and len(ngrams(words[:2], 3)) == 0
    assert ngrams(words[::-1].copy(), 10)[0] != ngrams(words, 10)[0]
