"""Decontamination against benchmark items by a broadcast set of word n-gram hashes.

Items and documents fall into words of letters, digits and code points above ASCII, with A-Z
in lower case. A window is ten consecutive words of an item, or all words of a shorter one.
The hashes of all item windows are broadcast; documents are scanned in a narrow map, window by
window, and every hash hit is verified on the words themselves. A broadcast holds at most
`max_windows` windows: a larger benchmark is dealt into parts by a hash of the item, and the
documents pass through one part after another, each time written before the next part.

Defined results: NULL and empty texts have no words and are clean; items without words have no
windows. Repeated items count by their distinct item_id; a NULL item_id is written as an
empty string. Other columns are carried along untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterwise.llm.frames import free_name, rows_of
from quarterwise.llm.words import ALNUM, Words, hash_windows, hash_words, split_words
from quarterwise.session import materialise

LENGTH = 10
MAX_WINDOWS = 250_000
_BITS = 22

#: Found in a document: item ids, and hit words as [start, end) word positions and byte positions.
_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<first: long, last: long, start: long, stop: long>>"


def item_windows(bench: DataFrame, length: int = LENGTH) -> DataFrame:
    """(item_id, size, window, words) of every distinct window of an item; `window` is its hash."""
    schema = "item_id string, size int, window long, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, ["item_id", "text"]):
            words = split_words(batch.column("text"), ALNUM, lower=True)
            hashes = hash_words(words)
            rows: list[tuple] = []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                lo, hi = int(words.rows[i]), int(words.rows[i + 1])
                size = min(length, hi - lo)
                if size:
                    keys = hash_windows(hashes[lo:hi], size).view(np.int64)
                    rows += [(item or "", size, int(k), words.joined(np.arange(lo + j, lo + j + size))) for j, k in enumerate(keys)]
            columns = zip(*rows) if rows else [[]] * 4
            types = [pa.string(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["item_id", "size", "window", "words"])

    return bench.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, schema).distinct()


class Finder:
    """Looks windows up by size: a small bitmap first, then the sorted hashes, then the words."""

    def __init__(self, rows: list[tuple[str, int, int, bytes]]) -> None:
        self.items: dict[tuple[int, int, bytes], list[str]] = defaultdict(list)
        hashes: dict[int, set[int]] = defaultdict(set)
        for item, size, key, words in rows:
            self.items[size, key, words].append(item)
            hashes[size].add(key)
        self.sizes = {}
        for size, keys in sorted(hashes.items()):
            found = np.sort(np.fromiter(keys, np.int64, len(keys)).view(np.uint64))
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[(found >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.sizes[size] = (found, bitmap)

    def hits(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, size, items) of every verified window within one text."""
        for size, (known, bitmap) in self.sizes.items():
            windows = hash_windows(hashes, size)
            near = np.flatnonzero(bitmap[(windows >> np.uint64(64 - _BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, windows[near]), len(known) - 1)
            near = near[known[place] == windows[near]]
            inside = np.searchsorted(words.rows, near, side="right") == np.searchsorted(words.rows, near + size - 1, side="right")
            for at in near[inside].tolist():
                key = int(windows[at : at + 1].view(np.int64)[0])
                if found := self.items.get((size, key, words.joined(np.arange(at, at + size)))):
                    yield at, size, found


def _part(docs: DataFrame, rows: list[tuple], name: str, first: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    present = docs.columns
    columns = [c for c in present if first or c != name]
    found_type = T._parse_datatype_string(_FOUND)
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField(name, found_type)])
    pairs = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
    arrow_type = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pairs))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in rows_of(batches, present):
            words = split_words(batch.column("text"), ALNUM, lower=True)
            marks = np.zeros(len(words.starts) + 1, np.int64)
            items: dict[int, set[str]] = defaultdict(set)
            for at, size, found in finder.hits(words, hash_words(words)):
                marks[at] += 1
                marks[at + size] -= 1
                items[int(np.searchsorted(words.rows, at, side="right")) - 1].update(found)
            earlier = None if first else batch.column(name).to_pylist()
            out = []
            covered = np.cumsum(marks[:-1]) > 0
            for i in range(batch.num_rows):
                lo, hi = int(words.rows[i]), int(words.rows[i + 1])
                hit, names = covered[lo:hi], items.get(i, set())
                if earlier:
                    hit = hit.copy()
                    names = names | set(earlier[i]["items"])
                    for s in earlier[i]["spans"]:
                        hit[s["first"] : s["last"]] = True
                spans = []
                if names:
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
                    base = int(words.texts[i])
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        spans.append({"first": a, "last": b, "start": int(words.starts[lo + a]) - base, "stop": int(words.ends[lo + b - 1]) - base})
                out.append({"n_words": hi - lo, "n_hit": int(hit.sum()), "items": sorted(names), "spans": spans})
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(out, arrow_type)], names=schema.names)

    return docs.mapInArrow(run, schema)


def find_hits(docs: DataFrame, bench: DataFrame, length: int = LENGTH, max_windows: int = MAX_WINDOWS) -> tuple[DataFrame, str]:
    """`docs` with a struct column of what was found, and that column's name."""
    windows = materialise(item_windows(bench, length), "item-windows")
    parts = max(1, -(-windows.count() // max_windows))
    name, out = free_name(docs, "found"), docs
    for k in range(parts):
        own = windows.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(parts)) == k)
        # the size is known here: about max_windows rows
        rows = [tuple(r) for r in own.select("item_id", "size", "window", "words").collect()]
        out = _part(out if k == 0 else materialise(out, "found"), [(i, s, w, bytes(b)) for i, s, w, b in rows], name, k == 0)
    return out, name


def contamination(docs: DataFrame, bench: DataFrame, length: int = LENGTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    found, name = find_hits(docs.select("doc_id", "text"), bench, length, max_windows)
    f = F.col(name)
    return found.select(
        "doc_id",
        f.n_words.alias("n_words"),
        f.n_hit.alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"),
        (f.n_hit > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, bench: DataFrame, spans_only: bool = False, length: int = LENGTH, max_windows: int = MAX_WINDOWS
) -> DataFrame:
    """`docs` without contaminated documents, or, with `spans_only`, without their hit passages.

    A passage goes from the first byte of its first word to the last byte of its last one.
    """
    found, name = find_hits(docs, bench, length, max_windows)
    if not spans_only:
        return found.where(F.col(name).n_hit == 0).select(*docs.columns)
    raw = F.col("text").cast("binary")
    spans = F.col(name)["spans"]
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length("text").cast("long")))
    kept = F.transform(
        F.arrays_zip(bounds.alias("lo"), ends.alias("hi")),
        lambda p: F.decode(F.substring(raw, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")), "UTF-8"),
    )
    text = F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)
