import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarterwise.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(0x41, 0x5B)}))


def brute(docs, items, length=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(length, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for i in range(len(w)):
            for k in range(1, length + 1):
                if i + k <= len(w) and (found := windows.get(tuple(w[i : i + k]))):
                    hit |= set(range(i, i + k))
                    names |= found
        out[doc] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def corpus():
    rng = random.Random(4)
    sentence = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "eps", "ÉTA", "x9"]) for _ in range(n))
    items = [(i, sentence(rng.randrange(1, 25))) for i in range(2, 14)] + [(100, ""), (101, None), (102, "?!"), (103, "zeta"), (104, "zeta")]
    docs = [(i, sentence(rng.randrange(0, 40))) for i in range(30)]
    for i in range(30, 60):
        item = rng.choice(items)[1] or ""
        docs.append((i, f"{sentence(6)}; {item.upper() if i % 2 else item}. {sentence(8)}"))
    return [*docs, (60, None), (61, ""), (62, "zeta"), (63, "w " * 50_000 + items[0][1])], items


@pytest.mark.parametrize("most", [10**6, 7])
def test_hits_equal_brute_force(documents, spark, most):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = {r.doc_id: tuple(r[c] for c in columns) for r in dc.contamination(documents(*docs), bench, max_windows=most).collect()}
    assert got == brute(docs, items)


def test_documents_or_passages_go(documents, spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "prime number")], "item_id long, text string")
    docs = documents((1, f"Before. {item.upper()}! After."), (2, "clean text"), (3, None), (4, "é a Prime, number z prime numbers"))
    docs = docs.withColumn("found", F.lit(5))
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in dc.decontaminate(docs, bench, spans_only=True).collect()}
    assert cut == {1: "Before. ! After.", 2: "clean text", 3: None, 4: "é a  z prime numbers"}


def test_empty_tables(documents, spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.contamination(documents().limit(0), bench).count() == 0
    assert [r.n_hit for r in dc.contamination(documents((1, "a b")), bench.limit(0)).collect()] == [0]
    assert [r.n_hit for r in dc.contamination(documents((1, "a b"), (1, "a b")), bench).collect()] == [2, 2]
