import math
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quarterwise.llm import lm_score as lm

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, order, backoff=0.4, leave_out=True):
    split = [(i, WORD.findall((t or "").lower())) for i, t in docs]
    own, contexts = [], []
    for _, w in split:
        padded = ["<s>"] * (order - 1) + w
        own.append(Counter(tuple(padded[i - k + 1 : i + 1]) for i in range(order - 1, len(padded)) for k in range(1, order + 1)))
        contexts.append(Counter(tuple(padded[i - k + 1 : i]) for i in range(order - 1, len(padded)) for k in range(2, order + 1)))
    all_own, all_contexts = sum(own, Counter()), sum(contexts, Counter())
    total = sum(len(w) for _, w in split)
    out = []
    for (i, w), mine, around in zip(split, own, contexts):
        mine, around = (mine, around) if leave_out else (Counter(), Counter())
        rest = max(1, total - (len(w) if leave_out else 0))
        padded, s, backed, unknown = ["<s>"] * (order - 1) + w, 0.0, 0, 0
        for p in range(order - 1, len(padded)):
            for k in range(order, 0, -1):
                gram = tuple(padded[p - k + 1 : p + 1])
                others = all_own[gram] - mine[gram]
                if k > 1 and others > 0:
                    s += math.log(others / (all_contexts[gram[:-1]] - around[gram[:-1]])) + (order - k) * math.log(backoff)
                    break
                if k == 1:
                    s += math.log((others if others > 0 else 0.5) / rest) + (order - 1) * math.log(backoff)
                    unknown += others <= 0
            backed += k < order
        out.append((i, len(w), s, backed, unknown))
    return out


def corpus():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the cat Dog sat on a mat, é x9".split()) for _ in range(rng.randrange(25))) for _ in range(40)]
    return list(enumerate([*texts, texts[0], None, "", "only here once", "the", "z " * 3000]))


@pytest.mark.parametrize("order, passes, leave_out", [(2, 1, True), (2, 3, True), (3, 2, True), (4, 1, True), (2, 2, False)])
def test_scores_equal_brute_force(documents, order, passes, leave_out):
    docs = corpus()
    got = {r.doc_id: r for r in lm.score_documents(documents(*docs), order=order, passes=passes, known=3, common=9, leave_out=leave_out).collect()}
    assert len(got) == len(docs)
    for i, n, s, backed, unknown in brute(docs, order, leave_out=leave_out):
        r = got[i]
        assert (r.n_words, r.n_backed_off, r.n_unknown) == (n, backed, unknown)
        assert r.log_score == pytest.approx(s, abs=1e-6)
        assert r.mean_log_score == (pytest.approx(s / n, abs=1e-6) if n else None)


def test_repeated_rows_are_separate_documents(documents):
    docs = [(1, "a b c"), (1, "a b c"), (None, "a b"), (2, None)]
    got = sorted((r.n_words, round(r.log_score, 9)) for r in lm.score_documents(documents(*docs), passes=1).collect())
    assert got == sorted((n, round(s, 9)) for _, n, s, _, _ in brute(docs, 2))


def test_one_document_and_none(documents):
    r = lm.score_documents(documents((1, "a b")), passes=1).first()
    assert r.log_score == pytest.approx(2 * math.log(0.4 * 0.5)) and r.n_unknown == 2
    assert lm.score_documents(documents().limit(0), passes=1).count() == 0
    with pytest.raises(ValueError):
        lm.score_documents(documents((1, "a")), order=1)


def test_memory_of_a_task_stays_small_beside_its_batch():
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(50_000)) for _ in range(2000)) for _ in range(700)]  # 8 MB
    batch = pa.RecordBatch.from_pydict({"doc_id": range(700), "tie": range(700), "text": texts})
    none = SimpleNamespace(value=(np.zeros(0, np.int64),) * 3)
    runs = {
        "pairs": lm._explode_pairs("bigint", none, none, 0.4, True)[0],
        "wide": lm._explode("bigint", 3, 1, 0, none, none, True)[0],
        "survey": lm._survey("bigint")[0],
        "count": lm._count_pairs,
    }
    for name, run in runs.items():
        list(run(iter([batch.slice(0, 1)])))  # tables that are kept
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60_000_000, (name, peak)
