"""Quality classifier: Naive Bayes support vectors.

A text is the set of its n-grams, hashed to `2**BITS` places: runs of three bytes, words and pairs of words, and
runs of up to three word shapes (kinds of characters in the word, kind of its last character, whether it repeats the word
before). An indicator is scaled by the log ratio of its counts in the two classes, r = log((1 + p) / |p|) - log((1 + q) / |q|);
scaled vectors have length one. A linear model with hinge loss is then fitted by dual coordinate descent.

The model is learned from a bounded sample: about `per_class` labelled ids of either class, chosen by a hash of the id. They
are few enough to be broadcast, so that no text is shuffled; class counts cover all of their texts and are added up by Spark. The
descent uses as many of these as hold about `most_features` indicators together; a row's loss weighs
what its class has lost by the sample. Model and counts have a fixed size of `2**BITS` entries. Scoring is a narrow map over whole texts.

Defined results: NULL and empty texts have no n-grams and score by the intercept. Labels other than 0 and 1 are ignored; an id
with several labels counts as the largest. Documents that share an id are separate rows. Without labels every score is 0.5; with labels of one class
only, it is that class. `predicted` is 1 from a score of 0.5 on. Empty tables give empty results; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterwise.llm.frames import Scratch, rows_of, text_buffers
from quarterwise.llm.words import hash_windows, hash_words, mixed, split_words, window_rows

BITS = 18
PER_CLASS = 20_000
MOST_FEATURES = 20_000_000
#: Upper bound of the dual variables, passes over the sample, and the violation at which they end.
PENALTY, PASSES, TOLERANCE = 1.0, 30, 0.02
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_CODES = np.arange(256)
#: Kinds of bytes as bits: capital, small letter, digit, other visible ASCII, part of a code point above ASCII.
_KIND = (
    ((_CODES >= 0x41) & (_CODES <= 0x5A)) * 1
    + ((_CODES >= 0x61) & (_CODES <= 0x7A)) * 2
    + ((_CODES >= 0x30) & (_CODES <= 0x39)) * 4
    + (_CODES >= 0x80) * 16
).astype(np.uint8)
_KIND[(_KIND == 0) & (_CODES > 0x20)] = 8


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by three."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features_of(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, places): the distinct hashed n-grams of each text are places[offsets[i]:offsets[i + 1]], in order."""
    texts, data = text_buffers(column)
    n = len(texts) - 1
    found: list[tuple[np.ndarray, np.ndarray]] = []  # (text, hash) of n-grams
    sizes = np.maximum(np.diff(texts) - 2, 0)
    if sizes.sum():
        runs = data[:-2].astype(_U) | data[1:-1].astype(_U) << _U(8) | data[2:].astype(_U) << _U(16)
        text = np.repeat(np.arange(n), sizes)
        at = np.arange(len(text)) + np.repeat(texts[:-1] - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
        found.append((text, (runs[at] + _U(1)) * _STEP))
    words = split_words(column)
    if len(words.starts):
        hashes = hash_words(words)
        begins = words.rows[:-1][words.counts() > 0]
        repeats = np.zeros(len(hashes), bool)
        repeats[1:] = hashes[1:] == hashes[:-1]
        repeats[begins] = False
        kinds = np.bitwise_or.reduceat(_KIND[words.data], words.starts).astype(_U)
        shapes = mixed(kinds | _KIND[words.data[words.ends - 1]].astype(_U) << _U(5) | repeats.astype(_U) << _U(10))
        for stream, lengths, mark in ((hashes, (1, 2), 0), (shapes, (1, 2, 3), 16)):
            for length in lengths:
                first, text = window_rows(words.rows, length)
                if len(first):
                    grams = stream if length == 1 else hash_windows(stream, length)
                    found.append((text, mixed(grams[first] + _U(mark + length))))
    if not found:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int32)
    # sorting and comparing neighbours is much faster than numpy's own way to distinct numbers
    keys = np.sort(np.concatenate([text.astype(np.int64) << bits | (h >> _U(64 - bits)).astype(np.int64) for text, h in found]))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return np.searchsorted(keys, np.arange(n + 1) << bits), (keys & ((1 << bits) - 1)).astype(np.int32)


def log_ratios(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Log ratio of each place's share among the counts of label 1 and of label 0, each count raised by one."""
    p, q = ones + 1.0, zeros + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


@dataclass(frozen=True)
class Model:
    """`ratios` scale the indicators, `weights` are the fitted weights times the ratios; `constant` is the score without a fit."""

    ratios: np.ndarray
    weights: np.ndarray
    intercept: float
    constant: float | None = None


def descend(
    rows: Sequence[np.ndarray], labels: np.ndarray, ratios: np.ndarray, bounds: np.ndarray, passes: int = PASSES, tolerance: float = TOLERANCE
) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights times ratios, intercept, dual variables) of the hinge-loss model; labels are 1 and -1.

    Each step minimises the dual over one variable; it costs one read and one update of the row's places.
    """
    squares = ratios**2
    norms = [float(np.sqrt(squares[r].sum())) for r in rows]
    diagonal = [1.0 + (n > 0) for n in norms]
    dual, weights, intercept = np.zeros(len(rows)), np.zeros(len(ratios)), 0.0
    order = np.random.default_rng(0)
    for _ in range(passes):
        worst = 0.0
        for i in order.permutation(len(rows)):
            row, y, norm, old, most = rows[i], labels[i], norms[i], dual[i], bounds[i]
            slope = y * (intercept + (weights[row].sum() / norm if norm else 0.0)) - 1.0
            projected = min(slope, 0.0) if old <= 0 else max(slope, 0.0) if old >= most else slope
            if projected:
                worst = max(worst, abs(projected))
                dual[i] = min(max(old - slope / diagonal[i], 0.0), most)
                step = (dual[i] - old) * y
                intercept += step
                if norm:
                    weights[row] += step / norm * squares[row]
        if worst < tolerance:
            break
    return weights, intercept, dual


def _surveyed(labelled: DataFrame, bits: int) -> DataFrame:
    """Counts of places by class, summed per task, and the features of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int64)
        for batch in rows_of(batches, ["text", "label", "chance"]):
            offsets, places = features_of(batch.column("text"), bits)
            labels = batch.column("label").to_numpy()
            for k in (0, 1):
                counts[k] += np.bincount(places[np.repeat(labels, np.diff(offsets)) == k], minlength=1 << bits)
            sets = [places[lo:hi].tobytes() for lo, hi in zip(offsets, offsets[1:])]
            yield packed(label=labels.tolist(), chance=batch.column("chance").to_pylist(), places=sets)
        there = np.flatnonzero(counts.any(axis=0))
        yield packed(place=there.tolist(), ones=counts[1][there].tolist(), zeros=counts[0][there].tolist())

    def packed(**columns: list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, [None] * n) for f in arrow}, arrow)

    arrow = pa.schema([("label", pa.int32()), ("chance", pa.float64()), ("places", pa.binary()), ("place", pa.int64()), ("ones", pa.int64()), ("zeros", pa.int64())])
    return labelled.mapInArrow(run, "label int, chance double, places binary, place long, ones long, zeros long")


def _chance(mark: str, *columns: str) -> Column:
    """A number from 0 to 1 by a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(mark), *columns), F.lit(1 << 30)) / F.lit(1 << 30)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    per_class: int = PER_CLASS,
    most_features: int = MOST_FEATURES,
    penalty: float = PENALTY,
    bits: int = BITS,
) -> Model:
    """Learn from the texts of `docs` that `labels` (doc_id and `label`, 0 or 1) marks."""
    marked = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shares = {k: min(1.0, per_class / sizes[k]) if sizes.get(k) else 0.0 for k in (0, 1)}
    drawn = marked.where(_chance("quality sample", "doc_id") < F.when(F.col("label") == 1, shares[1]).otherwise(shares[0]))
    # about twice per_class ids at most
    labelled = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    with Scratch() as scratch:
        surveyed = scratch.stored(_surveyed(labelled.select("text", "label", _chance("descent", "doc_id", "text").alias("chance")), bits), "quality-survey")
        counted = surveyed.where(F.col("place").isNotNull()).groupBy("place").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toPandas()
        sample = surveyed.where(F.col("label").isNotNull())
        held = sample.agg(F.sum(F.octet_length("places") / 4)).first()[0] or 0
        thinned = min(1.0, most_features / held) if held else 1.0
        taken = sample.where(F.col("chance") < thinned).select("label", "chance", "places").orderBy("chance", "places").toPandas()
    size = 1 << bits
    truth = np.where(taken["label"].to_numpy() == 1, 1.0, -1.0)
    if len(set(truth.tolist())) < 2:
        # one class, or none: there is nothing to tell apart
        constant = 0.5 if not len(truth) else float(truth[0] > 0)
        return Model(np.zeros(size), np.zeros(size), 0.0, constant)
    ones, zeros = np.zeros(size), np.zeros(size)
    ones[counted["place"]], zeros[counted["place"]] = counted["ones"], counted["zeros"]
    ratios = log_ratios(ones, zeros)
    lost = {k: max(sizes[k], 1) / max(int((truth == y).sum()), 1) for k, y in ((0, -1.0), (1, 1.0))}
    weight = np.where(truth > 0, lost[1], lost[0])
    rows = [np.frombuffer(p, np.int32) for p in taken["places"]]
    weights, intercept, _ = descend(rows, truth, ratios, penalty * weight / weight.mean())
    return Model(ratios, weights, intercept)


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row."""
    # plain values: executors need not know the class
    shared = docs.sparkSession.sparkContext.broadcast((model.ratios**2, model.weights, model.intercept, model.constant))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, weights, intercept, constant = shared.value
        for batch in rows_of(batches, ["doc_id", "text"]):
            offsets, places = features_of(batch.column("text"), bits)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            sums, norms = (np.bincount(row, x[places], batch.num_rows) for x in (weights, squares))
            margin = intercept + np.divide(sums, np.sqrt(norms), out=np.zeros(batch.num_rows), where=norms > 0)
            scores = 1 / (1 + np.exp(-np.clip(2 * margin, -500, 500))) if constant is None else np.full(batch.num_rows, constant)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
