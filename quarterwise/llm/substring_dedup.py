"""Removal of passages that repeat anywhere in the corpus, by suffix automata over reference shards.

A window is `LENGTH` consecutive words of a document. Every word covered by a window whose words
also start anywhere else goes.

The corpus is its own reference, so one automaton, or a broadcast of all, would grow with it.
It is cut into shards in which all occurrences of a window meet: a window belongs to its anchor,
the least hash among its runs of `GRAM` words. Neighbouring windows of one document with the same
anchor form a span. Spans whose anchor occurs once cannot repeat and are left where they are. The
others are collected by anchor, equal spans as one with a count. A shard is a bounded run of anchors:
its suffix automaton, with occurrence counts per state, is built from the distinct spans, and
the spans are streamed through it for matching statistics: the longest match at each word that occurs
twice or more. Where it reaches the threshold, a window ends that repeats. Maximal ranges go back
to their documents, and the words they cover are removed. Matches are of words, not hashes.

An anchor that occurs more than `HOT` times (a passage that very many documents share) would make its
shard large, since the windows at its edges differ everywhere. Its windows become spans of their own,
keyed by all their words, which spread evenly and collapse where they are read.

Defined results: NULL and empty texts have no words. Texts shorter than a window lose nothing. Rows
that share id and text are occurrences of each other. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterwise.llm.frames import rows_of, stored
from quarterwise.llm.words import UNSPACED, Words, hash_windows, hash_words, mixed, split_words, window_rows

LENGTH = 35
GRAM = 8
#: Windows of a span, occurrences of an anchor that is not hot, words of a shard.
MOST_WINDOWS = 64
HOT = 1000
SHARD_WORDS = 40_000


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` neighbours, in steps of doubled width."""
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def spans_of(words: Words, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first word within it, windows, anchor, whether it repeats within itself) of every span."""
    first, text = window_rows(words.rows, length)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, bool)
    hashes = hash_words(words)
    anchors = least_of(hash_windows(hashes, gram), length - gram + 1)[first]
    change = np.concatenate([[True], (text[1:] != text[:-1]) | (anchors[1:] != anchors[:-1])])
    begin = np.flatnonzero(change)
    place = np.arange(len(first)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(first)]])))
    begin = np.flatnonzero(change | (place % MOST_WINDOWS == 0))
    count = np.diff(np.concatenate([begin, [len(first)]]))
    span = np.repeat(np.arange(len(begin)), count)
    keys = hash_windows(hashes, length)[first] ^ mixed(span.astype(np.uint64))
    order = np.argsort(keys)
    twice = order[1:][keys[order][1:] == keys[order][:-1]]
    inner = np.zeros(len(begin), bool)
    inner[span[twice]] = True
    return text[begin], first[begin] - words.rows[text[begin]], count, anchors[begin].view(np.int64), inner


def _scan(id_type: str, length: int, gram: int):
    schema = f"doc_id {id_type}, tie long, n_words long, whole string, start int, windows int, anchor long, inner boolean"
    names = ["doc_id", "tie", "n_words", "whole", "start", "windows", "anchor", "inner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, ["doc_id", "tie", "text"]):
            words = split_words(batch.column("text"), UNSPACED)
            n = batch.num_rows
            digests = [
                hashlib.sha256(b" ".join(words.data[words.texts[i] : words.texts[i + 1]].tobytes().split())).hexdigest() for i in range(n)
            ]
            empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(words.counts()), pa.array(digests), *empty], names=names
            )
            text, start, windows, anchor, inner = spans_of(words, length, gram)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at),
                    batch.column("tie").take(at),
                    pa.nulls(len(at), pa.int64()),
                    pa.nulls(len(at), pa.string()),
                    pa.array(start.astype(np.int32)),
                    pa.array(windows.astype(np.int32)),
                    pa.array(anchor),
                    pa.array(inner),
                ],
                names=names,
            )

    return run, schema


def _cut(id_type: str, length: int, texts: bool):
    """Spans of the candidate documents: with the words of each, or with the place in its document."""
    schema = f"doc_id {id_type}, tie long, start int, windows int, anchor long, digest binary" + (", words binary" if texts else "")
    names = ["doc_id", "tie", "start", "windows", "anchor", "digest", *["words"] * texts]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), *[pa.binary()] * texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, ["doc_id", "tie", "text", "spans"]):
            at, rows = [], []
            for i, (text, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())):
                words = text.encode().split()
                for s in spans:
                    pieces = [(s["start"], s["windows"])] if not s["hot"] else [(s["start"] + k, 1) for k in range(s["windows"])]
                    for start, windows in pieces:
                        content = b" ".join(words[start : start + windows + length - 1])
                        digest = hashlib.blake2b(content, digest_size=16).digest()
                        anchor = int.from_bytes(digest[:8], "big", signed=True) if s["hot"] else s["anchor"]
                        at.append(i)
                        rows.append((start, windows, anchor, digest, content)[: len(types)])
            columns = zip(*rows) if rows else [[]] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            picked = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(picked), batch.column("tie").take(picked), *arrays], names=names)

    return run, schema


class Automaton:
    """Suffix automaton of several word sequences, each kept apart by a mark of its own, with occurrence counts."""

    def __init__(self, sequences: list[tuple[list[bytes], int]]) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        last = 0
        for mark, (sequence, copies) in enumerate(sequences):
            for word in sequence:
                last = self._extend(last, word, copies)
            last = self._extend(last, mark, 0)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(order):
            self.count[self.link[state]] += self.count[state]
        #: Length of the longest suffix of a state's own strings that occurs twice.
        self.twice = [0] * len(self.length)
        for state in order:
            self.twice[state] = self.length[state] if self.count[state] > 1 else self.twice[self.link[state]]

    def _extend(self, last: int, word: object, copies: int) -> int:
        new = len(self.length)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.count.append(copies)
        state = last
        while state != -1 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state == -1:
            return new
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            self.link[new] = target
            return new
        clone = len(self.length)
        self.next.append(dict(self.next[target]))
        self.length.append(self.length[state] + 1)
        self.link.append(self.link[target])
        self.count.append(0)
        while state != -1 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        self.link[target] = self.link[new] = clone
        return new

    def statistics(self, sequence: list[bytes]) -> Iterator[int]:
        """At each word of a sequence, the length of the longest match ending there that occurs twice or more."""
        state = matched = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            yield matched if self.count[state] > 1 else self.twice[self.link[state]] if state else 0


def _ranges(flags: list[bool]) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.array(flags, np.int8), [0]])))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _settle(length: int, shard_words: int):
    """Spans in order of their anchors to the ranges of their windows that repeat, shard by shard."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def shard(rows: list[tuple[int, bytes, int, int, bytes]]) -> pa.RecordBatch:
        by_anchor: dict[int, list] = {}
        for row in rows:
            by_anchor.setdefault(row[0], []).append(row)
        # a span with copies repeats as a whole; anchors with such spans only need no automaton
        open_ = [r for group in by_anchor.values() if any(x[2] == 1 for x in group) for r in group]
        automaton = Automaton([(r[4].split(b" "), r[2]) for r in open_])
        out = []
        for anchor, digest, copies, windows, words in rows:
            if copies > 1:
                out.append((anchor, digest, [{"lo": 0, "hi": windows}]))
                continue
            found = [n >= length for n in automaton.statistics(words.split(b" "))][length - 1 :]
            if any(found):
                out.append((anchor, digest, _ranges(found)))
        columns = zip(*out) if out else [[]] * 3
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), kind))]
        return pa.RecordBatch.from_arrays(arrays, names=["anchor", "digest", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "copies", "windows", "words"))):
                if size >= shard_words and row[0] != rows[-1][0]:
                    yield shard(rows)
                    rows, size = [], 0
                rows.append(row)
                size += row[3] + length - 1
        if rows:
            yield shard(rows)

    return run


def _remove(id_type: str, length: int):
    schema = f"doc_id {id_type}, tie long, n_removed long, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, ["doc_id", "tie", "text", "gone"]):
            removed, kept = [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                words = text.encode().split()
                marks = np.zeros(len(words) + 1, np.int64)
                for g in gone:
                    marks[g["lo"]] += 1
                    marks[g["hi"] + length - 1] -= 1
                stay = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
                removed.append(len(words) - len(stay))
                kept.append(b" ".join([words[i] for i in stay]).decode())
            arrays = [batch.column("doc_id"), batch.column("tie"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tie", "n_removed", "kept_text"])

    return run, schema


def _same(left: str, right: str) -> Column:
    """Rows of the same document; ids may be NULL."""
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.tie") == F.col(f"{right}.tie"))


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """Per document: doc_id, tie (hash of the text), n_words, n_removed, whole (digest of all words), kept_text.

    kept_text is NULL where nothing is removed, so that untouched texts need not be carried about.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # an empty text has no hash of its own to lose: NULL and empty are told apart by nothing here
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    scan, scan_schema = _scan(id_type, length, gram)
    scanned = stored(plain.mapInArrow(scan, scan_schema), "spans")
    base = scanned.where(F.col("anchor").isNull()).select("doc_id", "tie", "n_words", "whole")
    spans = scanned.where(F.col("anchor").isNotNull()).select("doc_id", "tie", "start", "windows", "anchor", "inner")
    common = (
        spans.groupBy("anchor")
        .agg(F.count("*").alias("times"), F.max("inner").alias("inner"))
        .where("times > 1 OR inner")
        .select("anchor", (F.col("times") > hot).alias("hot"))
    )
    # rows that share id and text have the same spans: a set
    per_doc = (
        spans.drop("inner").join(common, "anchor").groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "windows", "anchor", "hot")).alias("spans"))
    )
    listed = stored(per_doc, "span-lists")
    candidates = stored(plain.alias("d").join(listed.alias("s"), _same("d", "s")).select("d.*", "s.spans"), "candidates")
    cut, cut_schema = _cut(id_type, length, True)
    distinct = (
        candidates.mapInArrow(cut, cut_schema)
        .groupBy("anchor", "digest")
        .agg(F.count("*").alias("copies"), F.first("windows").alias("windows"), F.first("words").alias("words"))
    )
    settled = stored(
        distinct.repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_settle(length, shard_words), "anchor long, digest binary, ranges array<struct<lo: int, hi: int>>"),
        "settled",
    )
    place, place_schema = _cut(id_type, length, False)
    places = candidates.mapInArrow(place, place_schema)
    gone = (
        places.join(settled, ["anchor", "digest"])
        .select("doc_id", "tie", F.explode(F.transform("ranges", lambda r: F.struct((F.col("start") + r["lo"]).alias("lo"), (F.col("start") + r["hi"]).alias("hi")))).alias("g"))
        .groupBy("doc_id", "tie")
        .agg(F.collect_set("g").alias("gone"))
    )
    remove, remove_schema = _remove(id_type, length)
    left = stored(
        candidates.drop("spans").alias("c").join(gone.alias("g"), _same("c", "g")).select("c.*", "g.gone").mapInArrow(remove, remove_schema),
        "kept-texts",
    )
    changed = left.dropDuplicates(["doc_id", "tie"])
    return base.alias("b").join(changed.alias("k"), _same("b", "k"), "left").select(
        "b.doc_id", "b.tie", "b.n_words", F.coalesce("k.n_removed", F.lit(0)).cast("long").alias("n_removed"), "b.whole", "k.kept_text"
    )


def repeat_digests(docs: DataFrame, **settings) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    found = remove_repeats(docs, **settings)
    return found.select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2("kept_text", 256), F.col("whole")).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, **settings) -> DataFrame:
    """`docs` with the kept words, joined by one space, as the text of every document that lost some."""
    found = remove_repeats(docs, **settings).where("n_removed > 0").dropDuplicates(["doc_id", "tie"])
    joined = docs.alias("d").join(
        found.alias("f"),
        F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("f.tie")),
        "left",
    )
    return joined.select(*[F.coalesce("f.kept_text", "d.text").alias(c) if c == "text" else F.col(f"d.{c}") for c in docs.columns])
