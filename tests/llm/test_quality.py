import math

import numpy as np
import pyarrow as pa
import pytest

from quarterwise.llm import quality
from quarterwise.llm.queries import QUERIES

LABELS = "doc_id long, quality int"


def plain(text):
    """The n-grams of a text as a set, in plain Python."""
    data = (text or "").encode()
    grams = {("bytes", data[i : i + 3]) for i in range(len(data) - 2)}
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    kind = lambda b: 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 4 if 48 <= b <= 57 else 16 if b >= 128 else 8 if b > 32 else 0
    shapes = []
    for i, w in enumerate(words):
        kinds = [kind(b) for b in w.encode()]
        shapes.append((sum(set(kinds)), kinds[-1], i > 0 and words[i - 1] == w))
    for stream, name, most in ((words, "words", 2), (shapes, "shapes", 3)):
        for n in range(1, most + 1):
            grams |= {(name, *stream[i : i + n]) for i in range(len(stream) - n + 1)}
    return grams


TEXTS = ["a b a b c", "De De De", "", None, "x", "Ünï côde 12 A1-B2!", "word " * 50 + "END!!", "two\nlines\tand tabs", "ab", "abc abc"]


def test_features_are_the_plain_ngrams():
    offsets, places = quality.features_of(pa.array(TEXTS), bits=40)  # room enough that nothing collides
    sets = [set(places[offsets[i] : offsets[i + 1]].tolist()) for i in range(len(TEXTS))]
    grams = [plain(t) for t in TEXTS]
    assert [len(s) for s in sets] == [len(g) for g in grams]
    for i in range(len(TEXTS)):
        for j in range(len(TEXTS)):
            assert len(sets[i] & sets[j]) == len(grams[i] & grams[j]), (TEXTS[i], TEXTS[j])


def test_descent_reaches_the_optimum():
    random = np.random.default_rng(2)
    ratios = random.standard_normal(40)
    rows = [np.sort(random.choice(40, random.integers(0, 12), replace=False)) for _ in range(120)]
    labels = np.where(random.random(120) < 0.4, 1.0, -1.0)
    bounds = np.where(labels > 0, 0.5, 1.5)
    weights, intercept, dual = quality.descend(rows, labels, ratios, bounds, passes=3000, tolerance=1e-7)
    x = np.zeros((120, 40))
    for i, r in enumerate(rows):
        if len(r):
            x[i, r] = ratios[r] / np.linalg.norm(ratios[r])
    w = x.T @ (dual * labels)
    assert np.allclose(weights, w * ratios) and intercept == pytest.approx((dual * labels).sum())
    primal = 0.5 * (w @ w + intercept**2) + (bounds * np.maximum(0, 1 - labels * (x @ w + intercept))).sum()
    value = dual.sum() - 0.5 * (w @ w + intercept**2)
    assert ((0 <= dual) & (dual <= bounds)).all() and primal == pytest.approx(value, rel=1e-5)


def test_scores_by_plain_arithmetic(spark, documents):
    rows = [(i, f"good plain words {i} here." if i % 3 else f"BAD!! WORDS!! {i}!!") for i in range(60)] + [(100, None), (101, ""), (101, "BAD!!")]
    docs = documents(*rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(1, 0), (2, None), (3, 7), (999, 1)], LABELS)
    model = quality.fit(docs, labels, bits=20)
    # counts over all labelled rows, and the ratios
    ones, zeros = {}, {}
    for i, text in rows[:60]:
        for g in plain(text):
            side = ones if i % 3 else zeros
            side[g] = side.get(g, 0) + 1
    size = 1 << 20
    norm_p, norm_q = size + sum(ones.values()), size + sum(zeros.values())
    offsets, places = quality.features_of(pa.array([rows[1][1]]), 20)
    want = sorted(math.log((1 + ones.get(g, 0)) / norm_p) - math.log((1 + zeros.get(g, 0)) / norm_q) for g in plain(rows[1][1]))
    assert np.allclose(np.sort(model.ratios[places]), want)
    for r, (_, text) in zip(sorted(quality.score(docs, model, 20).collect(), key=lambda r: r.doc_id), rows):
        if r.doc_id < 100:
            _, at = quality.features_of(pa.array([text]), 20)
            margin = model.intercept + model.weights[at].sum() / np.linalg.norm(model.ratios[at])
            assert r.score == pytest.approx(1 / (1 + math.exp(-2 * margin))) and r.predicted == int(r.score >= 0.5) == int(r.doc_id % 3 > 0)
    assert quality.score(docs, model, 20).count() == 63


def test_defined_results(spark, documents):
    docs, none = documents((1, "a"), (2, None), (None, "b")), spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert {r.predicted for r in quality.score(docs, quality.fit(docs, spark.createDataFrame([(1, 0)], LABELS))).collect()} == {0}
    assert quality.score(documents(), quality.fit(documents(), none)).count() == 0


def test_bounds_of_the_sample(spark, documents):
    many = documents(*[(i, f"w{i} x" if i % 2 else f"v{i} Y!") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], LABELS)
    whole, fewer, thinner = quality.fit(many, labels), quality.fit(many, labels, per_class=40), quality.fit(many, labels, most_features=600)
    # fewer ids count less; fewer rows of the descent keep the counts whole
    assert not np.array_equal(fewer.ratios, whole.ratios)
    assert np.array_equal(thinner.ratios, whole.ratios) and not np.array_equal(thinner.weights, whole.weights)
    for model in (whole, fewer, thinner):
        assert all(r.predicted == r.doc_id % 2 for r in quality.score(many, model).collect())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = QUERIES["op11_quality_classifier"](spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    told = found.where("held_out").join(labels, "doc_id").collect()
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(r.predicted == r.quality for r in told) >= 0.95 * len(told) > 100
    # every pair of a good and a bad document, ordered by score
    good, bad = ([r.score for r in told if r.quality == q] for q in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.98 * len(good) * len(bad)
