import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenscribe.llm import kernels as K


def words_of(texts):
    column, out = K.Texts(pa.array(texts, pa.string())), []
    for lo, hi in column.slices(64):
        w = column.words(lo, hi)
        for i in range(hi - lo):
            at = range(w.of[i], w.of[i + 1])
            out.append([(bytes(w.data[w.starts[k] : w.ends[k]]).decode(), int(w.hashes[k])) for k in at])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é.\n 7"), max_size=40)), max_size=12), st.integers(3, 30))
def test_words_agree_with_the_pattern_and_hashes_with_the_words(texts, piece):
    before, K.PIECE = K.PIECE, piece
    try:
        found = words_of(texts)
    finally:
        K.PIECE = before
    assert [[w for w, _ in doc] for doc in found] == [re.findall(K.WORD_RE, t or "") for t in texts]
    pairs = {x for doc in found for x in doc}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_windows_are_equal_exactly_when_their_words_are():
    text = K.Texts(pa.array(["a b c a b c a b d " * 20]))
    w = text.words(0, 1)
    seq = text.data.tobytes().decode().split()
    for size in (2, 3, 7, 25):
        hashes, byte_words = w.windows(size), {}
        for k, h in enumerate(hashes):
            assert byte_words.setdefault(tuple(seq[k : k + size]), h) == h
        assert len(set(byte_words.values())) == len(byte_words)


def test_sliding_min():
    x = K.mix(np.arange(200, dtype=np.uint64))
    for size in (1, 2, 3, 26, 199, 200):
        assert (K.sliding_min(x, size) == [x[i : i + size].min() for i in range(len(x) - size + 1)]).all()
    assert not len(K.sliding_min(x, 201))
