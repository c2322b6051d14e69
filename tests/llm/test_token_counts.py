import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarterwise.llm import token_counts as tc

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks(spark):
    return tc.read_ranks(spark, PATH)


@pytest.fixture(scope="module")
def count(ranks):
    return tc.encoder(ranks)


TEXT = st.text(alphabet=st.sampled_from("abcXY019 \n\t'.,-é日½² \x1cst"), max_size=200)


@settings(max_examples=200, deadline=None)
@given(text=TEXT, size=st.integers(1, 30))
def test_leaves_add_up(count, text, size):
    lengths, at, total = tc.leaves(text, size), 0, 0
    for n in lengths:
        total += count(text[at : at + n])
        at += n
    assert at == len(text) and total == count(text)


@settings(max_examples=200, deadline=None)
@given(text=TEXT, size=st.integers(1, 12), seed=st.integers(0, 10**6))
def test_counts_follow_edits(count, text, size, seed):
    rng = random.Random(seed)
    for _ in range(2):  # a second round starts from the edited tree
        lengths = tc.leaves(text, size)
        at, tokens = 0, []
        for n in lengths:
            tokens.append(count(text[at : at + n]))
            at += n
        tree = tc.SegmentTree(lengths, tokens)
        places = sorted(rng.randrange(len(text) + 1) for _ in range(2 * rng.randrange(4)))
        edits = [(a, b, rng.choice(["", " ", "x", " new words", "\n\n", "'s", "é"])) for a, b in zip(places[::2], places[1::2])]
        edits = [e for i, e in enumerate(edits) if all(e[0] > f[1] for f in edits[:i])]
        want = text
        for a, b, new in reversed(edits):
            want = want[:a] + new + want[b:]
        got, _ = tc.apply_edits(text, tree, edits, count)
        assert got == want and tree.tokens[1] == count(want) and tree.chars[1] == len(want)
        text = want


def test_few_characters_are_encoded_again(count):
    text = " ".join(f"word{i}" for i in range(20_000))
    lengths = tc.leaves(text)
    tree = tc.SegmentTree(lengths, [0] * len(lengths))
    _, again = tc.apply_edits(text, tree, [(70_000, 70_004, "x")], count)
    assert 0 < again < 3 * tc.LEAF


def test_frames(documents, ranks, spark):
    docs = documents((1, "hello wide world " * 300), (2, None), (3, ""), (3, ""), (4, "日本語" * 100)).withColumnRenamed("lang", "tree")
    counted, tree = tc.count_tokens(docs, ranks)
    assert tree == "tree_" and counted.columns == [*docs.columns, "tree_"]
    edited = counted.selectExpr("*", "CASE WHEN doc_id = 1 THEN array(named_struct('start', 6, 'stop', 10, 'replacement', cast(null AS string)), "
                                "named_struct('start', 5000, 'stop', 999999, 'replacement', ' end')) WHEN doc_id = 3 THEN "
                                "array(named_struct('start', 0, 'stop', 0, 'replacement', 'new text')) END AS edits")
    done, name = tc.recount(edited, tree, "edits", ranks)
    own = tiktoken.Encoding("t", pat_str=tc.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in done.collect():
        assert r[name]["n_tokens"] == len(own.encode_ordinary(r[name]["text"]))
        assert sum(r[name]["leaf_tokens"]) == r[name]["n_tokens"] and sum(r[name]["leaf_chars"]) == len(r[name]["text"])
    texts = {r.doc_id: r[name]["text"] for r in done.collect()}
    assert texts[1].startswith("hello  world") and texts[1].endswith(" end") and texts[2] == "" and texts[3] == "new text"
    assert tc.edited_counts(docs.limit(0), ranks).count() == 0


def test_redactions_join_overlaps():
    text = "mail a.b@c.org from 10.0.0.1, token = abcdef123456, card 4111111111111111"
    edits = tc.redactions(text)
    assert [text[s:e] for s, e, _ in edits] == ["a.b@c.org", "10.0.0.1", "token = abcdef123456", "4111111111111111"]
    assert tc.redactions(None) == []
