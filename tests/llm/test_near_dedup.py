import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarterwise.llm import near_dedup as nd
from quarterwise.llm.components import connected_components
from quarterwise.llm.words import ALNUM, hash_words, split_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(0x41, 0x5B)}))
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def overlap(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(texts, least=0.8):
    """Least id of each document's component under all links."""
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and overlap(bags[i], bags[j]) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def corpus(seed=1):
    """Families of texts with a few words changed, repeated lines, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (1, 2, 3, 12, 40):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    line = " ".join(rng.choice(vocabulary) for _ in range(9))
    texts += [f"{line}\n" * n for n in (20, 21, 30, 60)]
    texts += ["a b c", "A, b: c!", "a b", "a b c d e f", "", None, "!!!", "...", texts[0].upper(), texts[0]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("settings", [{}, {"block": 8, "common": 2}, {"block": 4, "common": 1}])
def test_classes_equal_brute_force(documents, rows_of, settings):
    texts = corpus()
    got = rows_of(nd.near_classes(documents(*enumerate(texts)), **settings), "doc_id", "class_id")
    assert got == sorted(((i, c) for i, c in enumerate(classes(texts))), key=repr)


def test_one_row_of_each_class_stays(documents, rows_of):
    texts = corpus(2)
    docs = documents(*enumerate(texts)).withColumns({"text_tie": F.lit(1), "node": F.lit(2)})
    out = nd.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert rows_of(out, "doc_id") == sorted(((i,) for i in set(classes(texts))), key=repr)


def test_null_and_repeated_ids_and_long_texts(documents, rows_of):
    long = " ".join(f"x{i}" for i in range(60_000))
    docs = documents((None, long), (1, long + " y"), (2, "q r s t u v"), (2, "q r s t u v"), (None, None))
    got = rows_of(nd.near_classes(docs), "doc_id", "class_id", "class_size", "kept")
    assert got == sorted([(None, 1, 2, False), (1, 1, 2, True), (2, 2, 2, True), (2, 2, 2, False), (None, None, 1, True)], key=repr)
    assert nd.near_classes(documents().limit(0)).count() == 0 == nd.drop_near_copies(documents().limit(0)).count()


def signature(texts):
    words = split_words(pa.array(texts), ALNUM, lower=True)
    return nd.bag_minhash(*nd.multisets(*nd.shingles(words, hash_words(words)), len(texts)), len(texts), 4096)


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(3)
    line = lambda: " ".join(f"v{rng.randrange(500)}" for _ in range(40))
    one, two, three = line(), line(), line()
    texts = [f"{one} {two}", f"{one} {three}", (one + " ") * 5, (one + " ") * 9 + three, "a b c d e f g"]
    together = signature(texts)
    bags = [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            want = overlap(bags[i], bags[j])
            assert abs(np.mean(together[i] == together[j]) - want) < 4.5 * max(0.001, (want * (1 - want) / 4096) ** 0.5)
    # a text's signature does not depend on what else is in its batch
    assert np.array_equal(signature(texts[2:3])[0], together[2])


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame(path + star + [(7, 7), (300, 299), (299, 300)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {299: 299, 300: 299}
    assert connected_components(edges.limit(0)).count() == 0
