import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarterwise.llm import substring_dedup as sd


def brute(docs, length):
    seen = Counter()
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for _, w in split:
        seen.update(tuple(w[k : k + length]) for k in range(len(w) - length + 1))
    out = []
    for i, w in split:
        gone = {p for k in range(len(w) - length + 1) if seen[tuple(w[k : k + length])] > 1 for p in range(k, k + length)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    shared = [fresh(n) for n in (12, 20, 60)]
    texts = [f"{fresh(rng.randrange(30))} {rng.choice(shared)}\t{fresh(rng.randrange(30))}" for _ in range(60)]
    texts += [texts[0]] * 3 + ["la la " * 40, "a b c " * 30, f"x {shared[2]}\n", shared[2], "", None, "é \x1c ü " * 9, fresh(9)]
    words = texts[1].split()
    words[len(words) // 2] = "changed"
    return list(enumerate([*texts, " ".join(words)]))


@pytest.mark.parametrize("settings_", [{}, {"hot": 3}, {"shard_words": 50, "hot": 10}])
def test_result_equals_brute_force(documents, rows_of, settings_):
    docs = corpus(1)
    got = rows_of(sd.repeat_digests(documents(*docs), length=10, gram=4, **settings_), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute(docs, 10)


def test_production_window(documents, rows_of):
    rng = random.Random(7)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    thirty_four, thirty_five, long = fresh(34), fresh(35), fresh(6000)
    docs = [(1, f"{thirty_four} a"), (2, f"{thirty_four} b"), (3, f"c {thirty_five}"), (4, f"{thirty_five} d"), (5, long), (6, f"{long} e")]
    got = rows_of(sd.repeat_digests(documents(*docs)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute(docs, 35)
    assert [r[2] for r in got] == [0, 0, 35, 35, 6000, 6000]


def test_repeated_rows_are_occurrences(documents, rows_of):
    text = " ".join(f"t{i}" for i in range(50))
    docs = [(1, text), (1, text), (None, None), (None, "z")]
    got = rows_of(sd.repeat_digests(documents(*docs)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute(docs, 35) and got[0][2] == 50


def test_texts_without_their_repeats(documents):
    text = " ".join(f"t{i}" for i in range(40))
    docs = documents((1, f"a {text}"), (2, f"{text} b"), (3, "c  c"), (4, None)).withColumns({"tie": F.lit(1), "kept_text": F.lit(2)})
    out = sd.drop_repeats(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a", 2: "b", 3: "c  c", 4: None}
    assert sd.drop_repeats(docs.limit(0)).count() == 0 == sd.repeat_digests(documents().limit(0)).count()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab", max_size=12), st.integers(1, 2)), max_size=5))
def test_matching_statistics(rows):
    sequences = [([c.encode() for c in text], copies) for text, copies in rows]
    automaton = sd.Automaton(sequences)
    counted = Counter()
    for text, copies in rows:
        for i in range(len(text)):
            for j in range(i, len(text)):
                counted[text[i : j + 1]] += copies
    for (sequence, _), (text, _) in zip(sequences, rows):
        want = [max((n for n in range(1, i + 2) if counted[text[i + 1 - n : i + 1]] > 1), default=0) for i in range(len(text))]
        assert list(automaton.statistics(sequence)) == want


def test_least_of():
    import numpy as np

    values = np.array([random.Random(i).randrange(100) for i in range(50)], np.uint64)
    for width in (1, 2, 3, 7, 28):
        assert sd.least_of(values, width).tolist() == [values[i : i + width].min() for i in range(51 - width)]
