import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarterwise.llm import words as w
from quarterwise.llm.frames import text_slices

UNSPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {i: i + 32 for i in range(0x41, 0x5B)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB9 \t\n-é世İ\x7f\x1f\x0b'"), max_size=30)), max_size=8))
def test_words_equal_the_patterns(texts):
    for kind, lower, pattern in ((w.UNSPACED, False, UNSPACED), (w.ALNUM, True, ALNUM)):
        got = w.split_words(pa.array(texts, pa.string()), kind, lower)
        want = [pattern.findall((t or "").translate(ASCII_LOWER) if lower else t or "") for t in texts]
        assert got.counts().tolist() == [len(x) for x in want]
        assert [got.word(i).decode() for i in range(len(got.starts))] == [x for doc in want for x in doc]


def test_equal_words_have_equal_hashes_across_blocks(monkeypatch):
    monkeypatch.setattr(w, "_BLOCK", 16)
    texts = ["alpha beta " * 20, "gamma " + "x" * 100 + " alpha", ""]
    got = w.split_words(pa.array(texts))
    hashes = w.hash_words(got)
    by_word = {}
    for i, h in enumerate(hashes.tolist()):
        by_word.setdefault(got.word(i), set()).add(h)
    assert all(len(v) == 1 for v in by_word.values())
    assert len({next(iter(v)) for v in by_word.values()}) == len(by_word) == 4


def test_windows_stay_within_texts():
    got = w.split_words(pa.array(["a b c", None, "d", "a b c d"]))
    first, text = w.window_rows(got.rows, 3)
    assert first.tolist() == [0, 4, 5] and text.tolist() == [0, 3, 3]
    windows = w.hash_windows(w.hash_words(got), 3)[first]
    assert windows[0] == windows[1] != windows[2]


def test_slices_cover_all_rows_and_bound_bytes():
    column = pa.array(["x" * n for n in (3, 0, 50, 2, 2, 2, 0)] + [None])
    slices = list(text_slices(column, 5))
    assert [i for lo, hi in slices for i in range(lo, hi)] == list(range(8))
    assert all(hi - lo == 1 or sum(len(x.as_py() or "") for x in column[lo:hi]) <= 5 for lo, hi in slices)
    assert list(text_slices(pa.array([], pa.string()), 5)) == []
    assert np.array_equal(w.split_words(column.slice(2, 3)).counts(), [1, 1, 1])
