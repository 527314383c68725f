from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from fixtures import lower, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from reelgrid.llm import words as W
from reelgrid.llm.decontaminate import decode, encode

PATTERNS = [(W.blank_separated, r"[^\x20\x09-\x0D]+"), (W.letters_and_digits, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def check(texts):
    for table, pattern in PATTERNS:
        found = W.Words(pa.array(texts, pa.string()), table())
        got = [[bytes(found.data[a:b]).decode() for a, b in zip(found.start[p:q], found.end[p:q])] for p, q in zip(found.ptr[:-1], found.ptr[1:])]
        assert got == [re.findall(pattern, lower(t)) for t in texts]
        of: dict = {}
        for word, h in zip([w for ws in got for w in ws], found.hashes().tolist()):
            assert of.setdefault(word, h) == h
        assert len(set(of.values())) == len(of)
        codes, distinct = found.codes()
        assert [distinct[c].decode() for c in codes] == [w for ws in got for w in ws]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ09 \t\n\x0b\x00-_éß漢\U0001F600", max_size=30)), max_size=6))
def test_words_equal_the_pattern(texts):
    check(texts)


def test_words_of_odd_texts():
    check([t for _, t in odd_texts()])
    check([])
    check([None, None])


def test_chunks_keep_every_text_whole():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 100, "", "c"])], names=["text"])
    parts = list(W.chunks([batch, batch.slice(0, 0)], most=50))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 1


def test_hashes_do_not_depend_on_place():
    text = " ".join(f"word{i}" for i in range(200_000))
    alone = W.Words(pa.array(["word777"]), W.blank_separated()).hashes()[0]
    assert W.Words(pa.array([text]), W.blank_separated()).hashes()[777] == alone


def test_shingles_of_short_texts():
    h = np.arange(1, 4, dtype=np.uint64)
    assert len(W.shingle_hashes(h[:0], 5)) == 0
    assert len(W.shingle_hashes(h, 5)) == 1
    assert len(W.shingle_hashes(h, 2)) == 2
    assert W.shingle_hashes(h[:2], 2)[0] != W.shingle_hashes(h[:2], 5)[0]


@given(st.lists(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=20, unique=True), min_size=1, max_size=5))
def test_position_lists_round_trip(lists):
    lists = [sorted(x) for x in lists]
    flat = np.array([v for x in lists for v in x])
    first = np.array([i == 0 for x in lists for i in range(len(x))])
    raw, end = encode(flat, first)
    cuts = [0, *end[np.cumsum([len(x) for x in lists]) - 1]]
    assert [decode(raw[a:b].tobytes()).tolist() for a, b in zip(cuts, cuts[1:])] == lists
