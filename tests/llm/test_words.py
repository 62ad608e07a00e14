import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from bondmarts.llm.words import Words, chunks, shingle_sets

TEXT = st.text(alphabet=st.sampled_from(list("aAbÉßñ漢 .\t\n\x0b\x1c ")), max_size=40)


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def binary(texts):
    return pa.array(texts, pa.string()).cast(pa.large_binary())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    words = Words(binary(texts))
    assert [w.decode() for w in map(words.word, range(len(words.hashes)))] == [w for t in texts for w in plain_words(t)]
    assert np.diff(words.at).tolist() == [len(plain_words(t)) for t in texts]
    by_word = {}
    for i, h in enumerate(words.hashes.tolist()):
        assert by_word.setdefault(words.word(i), h) == h
    assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_shingle_sets_are_those_of_the_words(texts):
    names = {}
    for text, found in zip(texts, shingle_sets(pa.array(texts, pa.string()))):
        w = plain_words(text)
        expected = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        assert len(found) == len(expected) and (np.sort(found) == found).all()
        assert names.setdefault(frozenset(expected), found.tolist()) == found.tolist()


def test_chunks_cover_all_rows():
    texts = pa.array(["x" * n for n in (0, 5, 100, 3, 0, 40)] + [None])
    parts = list(chunks(texts, 50))
    assert [s for s, _ in parts] == sorted({s for s, _ in parts}) and sum(len(p) for _, p in parts) == len(texts)
    assert list(chunks(pa.array([], pa.string()))) == []
