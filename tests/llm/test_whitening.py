import math

import numpy as np
import pytest

from quarterwise.llm import whitening
from quarterwise.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def matrix(d, values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [9, 7, 5, 3, 2, 1],
        [1000.0, 999.9999, 1e-3, 1e-6, 0, 0],
        [5, 5, 5, 1, 1, 0],
        [0, 0, 0, 0, 0, 0],
        [1 + 1e-13, 1, 1 - 1e-13, 0.5, 0.5, 0.5],
    ],
)
def test_leading_pairs(values):
    a = matrix(6, values)
    a = (a + a.T) / 2
    found, vectors = whitening.Spectrum(a).leading(4)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:4]
    assert np.allclose(found, want, rtol=0, atol=1e-13 * max(1, max(values)))
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * found, atol=1e-12 * max(1, max(values)))


def test_inertia_and_solution():
    random = np.random.default_rng(3)
    for d in (1, 2, 5, 17):
        for _ in range(20):
            a = random.standard_normal((d, d))
            a = a + a.T
            a[np.diag_indices(d)] *= random.integers(0, 2, d)  # zero pivots need blocks of two
            factors = whitening.Factors(a)
            assert factors.positive() == (np.linalg.eigvalsh(a) > 0).sum()
            b = random.standard_normal(d)
            if np.linalg.cond(a) < 1e8:
                assert np.allclose(a @ factors.solve(b), b, atol=1e-6)


def brute(rows, k=4):
    """{vec_id: (n, deviation, whitened up to sign, explained)} in plain Python and LAPACK."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({tuple(x) for _, x in kept})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    mean = np.array([s / n for s in sums])
    y = np.array(listed, float) - mean
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = np.trace(y.T @ y / n)
    return n, {i: (sum((n * c - s) ** 2 for c, s in zip(x, sums)), (np.array(x) - mean) @ vectors / np.sqrt(values)) for i, x in kept}, values / trace


def test_whitened_table(spark):
    random = np.random.default_rng(7)
    rows = [(i, [float(c) for c in random.standard_normal(6) * [3, 2, 1.5, 1, 0.2, 0.1]]) for i in range(300)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(400)]  # a text that is repeated counts once
    rows += [(0, rows[0][1]), (None, rows[1][1]), (5000, None), (5001, [1.0, None] + [0.0] * 4), (5002, [math.inf] + [0.0] * 5), (5003, [math.nan] * 6), (5004, [-0.0] * 6)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", component string")
    got = whitening.whiten(frame, whitening.fit_whitening(frame)).collect()
    n, want, explained = brute(rows)
    assert n == 301 and len(got) == 4 * 703
    signs = {}
    for r in got:
        deviation, white = want[r.vec_id]
        assert (r.n, r.deviation, int(r.deviation_exact)) == (n, deviation, deviation)
        sign = signs.setdefault(r.component, math.copysign(1, r.whitened * white[r.component - 1]))
        assert r.whitened == pytest.approx(sign * white[r.component - 1], rel=1e-9, abs=1e-9)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10) and r.identity_error < 1e-9


def test_degenerate_tables(spark):
    def run(*vectors):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], SCHEMA)
        return whitening.whiten(frame, whitening.fit_whitening(frame)).collect()

    assert run() == [] and run(None, []) == []
    one = run([1.0, 2.0, 3.0], [1.0, 2.0, 3.0])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one[:3]] == [(c, 1, 0, None, None, None) for c in (1, 2, 3)]
    two = run([1.0, 0.0, 0.0], [3.0, 0.0, 0.0], [9.0])  # another length is left out
    assert len(two) == 6 and [r.whitened is None for r in two[:3]] == [False, True, True]
    assert abs(two[0].whitened) == pytest.approx(1) and two[0].explained == pytest.approx(1) and two[0].identity_error < 1e-9


def test_sums_beyond_a_long(spark):
    rows = [(i, [1e30 if i == 0 else 3e16 + i * 1e15, float(i)]) for i in range(4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whitening.whiten(frame, whitening.fit_whitening(frame)).collect() if r.component == 1}
    assert set(got) == {1, 2, 3}  # 256e30 exceeds a long
    x = {i: (int(256 * (3e16 + i * 1e15)), 256 * i) for i in (1, 2, 3)}
    sums = [sum(c) for c in zip(*x.values())]
    for i, r in got.items():
        far = sum((3 * c - s) ** 2 for c, s in zip(x[i], sums))
        assert int(r.deviation_exact) == far and r.deviation == (far if far < 2**63 else None)
    assert got[1].deviation is None


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    n, want, explained = brute([(r.vec_id, r.embedding) for r in table])
    got = QUERIES["op13_embedding_whitening"](spark, sf).collect()
    assert len(got) == 4 * len(want)
    for r in got:
        assert (r.n, r.deviation) == (n, want[r.vec_id][0])
        assert abs(r.whitened) == pytest.approx(abs(want[r.vec_id][1][r.component - 1]), rel=1e-6, abs=1e-7)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-4
