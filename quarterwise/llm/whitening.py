"""Whitening of embedding vectors by spectrum slicing.

Entries become whole numbers, x = floor(scale * c), and every distinct x vector counts once. Its exact
sums, then the covariance of the centred vectors (divisor n), are added up over all tasks. Only the
d x d covariance reaches the driver, with d at most `MOST_DIMENSIONS`. There the factors L D Lᵀ of the covariance shifted
by s tell by the signs of D how many eigenvalues lie above s (Sylvester's law of inertia). Bisection with
these counts isolates each leading eigenvalue, Rayleigh quotient iteration with the same factors
converges on it, and two more counts certify its number. Vectors are projected in a narrow map; the
covariance of the whitened fit list is measured to give `identity_error`.

Defined results: vectors that are NULL, hold a NULL or non-finite entry or one whose x exceeds a long are left
out. All vectors of a fit have one length: the commonest among the distinct ones (of ties the longer);
others are left out as well. Where an eigenvalue is zero to working precision (few or equal vectors),
`whitened` is NULL and `identity_error` leaves that component out, NULL if none remains; `explained` is NULL if the trace
is zero. `deviation` is NULL where it exceeds a long; `deviation_exact` holds it to 38 digits. Repeated rows and ids give
repeated results. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterwise.llm.frames import Scratch

SCALE = 256
COMPONENTS = 4
#: Bound of the d x d matrices that a task and the driver hold: 128 MB each.
MOST_DIMENSIONS = 4096
_ENTRIES = 2_000_000
_EPS = float(np.finfo(float).eps)
_WIDTHS = (np.int16, np.int32, np.int64)


class Factors:
    """P A Pᵀ = L D Lᵀ of a symmetric matrix, D with blocks of one or two rows (partial pivoting)."""

    def __init__(self, a: np.ndarray) -> None:
        a = np.array(a, float)
        n = len(a)
        self.order = np.arange(n)
        self.lower = np.eye(n)
        self.blocks: list[tuple[int, np.ndarray]] = []
        self.tiny = _EPS * max(float(np.abs(a).max(initial=0.0)), 1e-300)
        k = 0
        while k < n:
            k += self._step(a, k)

    def _swap(self, a: np.ndarray, k: int, r: int) -> None:
        if k != r:
            a[[k, r], :] = a[[r, k], :]
            a[:, [k, r]] = a[:, [r, k]]
            done = min(k, r)
            self.lower[[k, r], :done] = self.lower[[r, k], :done]
            self.order[[k, r]] = self.order[[r, k]]

    def _step(self, a: np.ndarray, k: int) -> int:
        grown = (1 + 17**0.5) / 8
        below = np.abs(a[k + 1 :, k])
        most = float(below.max(initial=0.0))
        here, size = abs(a[k, k]), 1
        if here < grown * most:
            r = k + 1 + int(below.argmax())
            across = np.abs(a[r, k:])
            across[r - k] = 0.0
            widest = float(across.max())
            if here * widest >= grown * most * most:
                pass
            elif abs(a[r, r]) >= grown * widest:
                self._swap(a, k, r)
            else:
                self._swap(a, k + 1, r)
                size = 2
        block = a[k : k + size, k : k + size].copy()
        if size == 1 and abs(block[0, 0]) < self.tiny:
            # an exact shift: keep the sign and a size that can be divided by
            block[0, 0] = self.tiny if block[0, 0] > 0 else -self.tiny
        rest = a[k + size :, k : k + size]
        part = np.linalg.solve(block, rest.T).T
        a[k + size :, k + size :] -= part @ rest.T
        self.lower[k + size :, k : k + size] = part
        self.blocks.append((k, block))
        return size

    def positive(self) -> int:
        """How many eigenvalues are above zero."""
        return sum(int((np.linalg.eigvalsh(b) > 0).sum()) if len(b) == 2 else int(b[0, 0] > 0) for _, b in self.blocks)

    def solve(self, b: np.ndarray) -> np.ndarray:
        y = b[self.order].astype(float)
        for k in range(len(y)):
            y[k + 1 :] -= self.lower[k + 1 :, k] * y[k]
        for k, block in self.blocks:
            y[k : k + len(block)] = np.linalg.solve(block, y[k : k + len(block)])
        for k in range(len(y) - 1, -1, -1):
            y[k] -= self.lower[k + 1 :, k] @ y[k + 1 :]
        out = np.empty_like(y)
        out[self.order] = y
        return out


class Spectrum:
    """Leading eigenpairs of a symmetric positive semidefinite matrix, numbered by inertia counts."""

    def __init__(self, a: np.ndarray) -> None:
        self.a, self.d = a, len(a)
        self.scale = float(np.abs(a).sum(axis=1).max(initial=0.0))
        self.least = 8 * self.d * _EPS * self.scale
        self.counts: dict[float, int] = {}
        self.values: list[float] = []
        self.vectors = np.zeros((self.d, 0))

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = Factors(self.a - shift * np.eye(self.d)).positive()
        return self.counts[shift]

    def leading(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(eigenvalues falling, unit eigenvectors in columns)."""
        if not self.scale:
            return np.zeros(min(k, self.d)), np.eye(self.d)[:, :k]
        for number in range(1, min(k, self.d) + 1):
            value, vector = self._pair(number)
            self.values.append(value)
            self.vectors = np.column_stack([self.vectors, vector])
        return np.array(self.values), self.vectors

    def _bracket(self, number: int) -> tuple[float, float]:
        """The closest shifts counted so far with at least `number` eigenvalues above the one, and fewer above the other."""
        low, high = -self.scale - 1.0, self.scale + 1.0
        for shift, count in self.counts.items():
            if count >= number:
                low = max(low, shift)
            else:
                high = min(high, shift)
        return low, high

    def _pair(self, number: int) -> tuple[float, np.ndarray]:
        narrow = False
        while True:
            low, high = self._bracket(number)
            isolated = self.counts.get(low) == number and self.counts.get(high) == number - 1
            narrow = narrow or high - low <= self.least
            if isolated or narrow:
                value, vector, error = self._converged((low + high) / 2)
                near = max(4 * error, self.least)
                if low - near <= value <= high + near and error <= self.least and self._certified(value, near, number):
                    return value, vector
                if narrow:
                    raise ArithmeticError(f"eigenvalue {number} did not converge: {value}, error {error}")
            for _ in range(1 if not isolated else 3):  # the quotient left its interval: narrow it
                low, high = self._bracket(number)
                self.above((low + high) / 2)

    def _certified(self, value: float, near: float, number: int) -> bool:
        return self.above(value - near) >= number > self.above(value + near)

    def _outside(self, v: np.ndarray) -> np.ndarray:
        """A unit vector without the parts along eigenvectors already found."""
        for _ in range(2):
            v = v - self.vectors @ (self.vectors.T @ v)
            v = v / np.linalg.norm(v)
        return v

    def _converged(self, shift: float) -> tuple[float, np.ndarray, float]:
        v = self._outside(np.random.default_rng(self.vectors.shape[1]).standard_normal(self.d))
        inverse = Factors(self.a - shift * np.eye(self.d))
        for _ in range(3):
            v = self._outside(inverse.solve(v))
        best: tuple[float, np.ndarray, float] | None = None
        for _ in range(12):
            value = float(v @ self.a @ v)
            error = float(np.linalg.norm(self.a @ v - value * v))
            if best is not None and error >= best[2]:
                break
            best = (value, v, error)
            v = self._outside(Factors(self.a - value * np.eye(self.d)).solve(v))
        return best


@dataclass(frozen=True)
class Whitening:
    """What a fit found; `vectors` has a column and `values` an entry per component."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    scale: int
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def usable(self) -> np.ndarray:
        """Which components have an eigenvalue above working precision."""
        return self.values > 64 * len(self.sums) * _EPS * self.trace


def _whole(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x vectors) of the usable vectors of a list column, per length and at most `_ENTRIES` entries at a time."""
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    lists = column.take(pa.array(there))
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
        bad = np.concatenate([[0], np.cumsum(~(np.abs(x) < 2.0**63))])
    good = bad[ends] == bad[ends - lengths]
    for d in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == d))
        for lo in range(0, len(rows), max(1, _ENTRIES // max(int(d), 1))):
            some = rows[lo : lo + max(1, _ENTRIES // max(int(d), 1))]
            at = (ends - lengths)[some][:, None] + np.arange(d)
            yield there[some], x[at].astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest whole numbers that hold it, marked by their width."""
    most = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
    width = sum((most > np.iinfo(w).max).astype(int) for w in _WIDTHS[:-1])
    out: list[bytes] = [b""] * len(x)
    for i, w in enumerate(_WIDTHS):
        for row in np.flatnonzero(width == i):
            out[row] = bytes([i]) + x[row].astype(w).tobytes()
    return out


def _unpacked(column: pa.Array, d: int) -> np.ndarray:
    x = np.empty((len(column), d), np.int64)
    for i, packed in enumerate(column.to_pylist()):
        x[i] = np.frombuffer(packed, _WIDTHS[packed[0]], d, 1)
    return x


def _slices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    step = max(1, _ENTRIES // max(d, 1))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            yield _unpacked(batch.column("packed").slice(lo, step), d)


def fit_list(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """(d, packed): every distinct x vector once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _whole(batch.column(0), scale):
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(_packed(x), pa.binary())], names=["d", "packed"])

    return rows.select(vector).mapInArrow(run, "d int, packed binary").distinct()


def _sums(fitted: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number and exact sums of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for x in _slices(batches, d):
            n += len(x)
            # halves, so that no sum of a slice leaves the long
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low)]
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(-1, d)), "total": [str(t) for t in (n, *total)]})

    # text, as a sum may need more digits than a long has
    parts = fitted.select("packed").mapInArrow(run, "i long, total string")
    added = {r["i"]: int(r["total"]) for r in parts.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return added[-1], [added[i] for i in range(d)]


def _covariance(fitted: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """Mean product of the centred vectors: each task adds up its own, then each row of the matrix meets in one place."""
    d = len(mean)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _slices(batches, d):
            y = x - mean
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": list(range(d)), "row": list(total)}, schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column("row").flatten().to_numpy().reshape(-1, d)
            for i, row in zip(batch.column("i").to_pylist(), rows):
                total[i] = total[i] + row if i in total else row.copy()
        if total:
            yield pa.RecordBatch.from_pydict({"i": list(total), "row": list(total.values())}, schema)

    schema = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])
    spark_schema = "i int, row array<double>"
    added = fitted.select("packed").mapInArrow(multiply, spark_schema).repartition("i").mapInArrow(add, spark_schema)
    out = np.zeros((d, d))
    for r in added.toLocalIterator():
        out[r["i"]] = r["row"]
    return (out + out.T) / (2 * n)


def _projected(x: np.ndarray, mean: np.ndarray, vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (x - mean) @ vectors / np.sqrt(values)


def _identity_error(fitted: DataFrame, mean: np.ndarray, vectors: np.ndarray, values: np.ndarray) -> float | None:
    """Largest entry of the measured covariance of the whitened fit list, minus the identity."""
    d, k = vectors.shape
    if not k:
        return None
    names = [f"w{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _slices(batches, d):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _projected(x, mean, vectors, values).T], names=names)

    white = fitted.select("packed").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    # covar_pop takes the running means off before it multiplies
    gaps = [F.abs(F.covar_pop(names[i], names[j]) - F.lit(float(i == j))) for i in range(k) for j in range(i, k)]
    return float(white.agg(F.array_max(F.array(*gaps))).first()[0])


def fit_whitening(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """Leading components of the distinct vectors; None where there is no usable vector."""
    with Scratch() as scratch:
        listed = scratch.stored(fit_list(rows, vector, scale), "fit-list")
        common = listed.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        if common is None or not common["d"]:
            return None
        d = common["d"]
        if d > MOST_DIMENSIONS:
            raise ValueError(f"vectors of {d} entries; a covariance of more than {MOST_DIMENSIONS} rows is not held in one place")
        fitted = listed.where(F.col("d") == d)
        n, sums = _sums(fitted, d)
        plain = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, scale)
        covariance = _covariance(fitted, n, plain.mean)
        values, vectors = Spectrum(covariance).leading(components)
        found = Whitening(n, sums, vectors, np.maximum(values, 0.0), float(np.trace(covariance)), scale)
        some = found.usable
        error = _identity_error(fitted, found.mean, vectors[:, some], found.values[some])
    return Whitening(n, sums, vectors, found.values, found.trace, scale, error)


def _deviations(x: np.ndarray, n: int, sums: Sequence[int]) -> list[int]:
    """Sum of (n x - S)² over the dimensions, exact."""
    far = n * (int(x.max(initial=0)) - min(int(x.min(initial=0)), 0)) + max(map(abs, sums), default=0)
    if len(sums) * far * far < 2**63:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    gap = n * x.astype(object) - np.array(sums, object)
    return (gap * gap).sum(axis=1).tolist()


_SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whiten(rows: DataFrame, fitted: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    schema = T.StructType([rows.schema[key], *T._parse_datatype_string(_SCHEMA).fields])
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    names, (d, k) = schema.names, fitted.vectors.shape
    # plain values: executors need not know the class
    n, sums, mean, scale, error = fitted.n, fitted.sums, fitted.mean, fitted.scale, fitted.identity_error
    vectors, some = fitted.vectors, fitted.usable
    roots = np.where(some, fitted.values, 1.0)
    explained = [float(v) / fitted.trace if fitted.trace > 0 else None for v in fitted.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, x in _whole(batch.column(1), scale):
                if x.shape[1] != d:
                    continue
                far = _deviations(x, n, sums)
                white = _projected(x, mean, vectors, roots)
                each = lambda c, kind: pa.array(c, kind).take(pa.array(np.repeat(np.arange(len(x)), k)))
                arrays = [
                    batch.column(0).take(pa.array(np.repeat(where, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n, np.int64)),
                    each([v if v < 2**63 else None for v in far], pa.int64()),
                    pa.array(white.ravel(), mask=np.tile(~some, len(x))),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array([error] * (len(x) * k), pa.float64()),
                    each([v if v < 10**38 else None for v in far], pa.decimal128(38, 0)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.select(key, vector).mapInArrow(run, schema)
