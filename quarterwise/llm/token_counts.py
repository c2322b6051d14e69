"""Token counts that follow edits: a segment tree of pre-token runs per document.

A text is cut where the tokenizer's pre-token pattern always cuts: before a blank or line end
between two letters or digits. Runs of about `LEAF` characters are encoded one by one; their
lengths and token counts are the leaves of a segment tree of sums. An edit finds its leaves by
descending the tree; only these, and a neighbour whose cut touches the edit, are encoded
again, and the sums above them are updated. Counts before and after are those of the whole text.

The vocabulary file is read once by the driver, at most `MOST_BYTES` of it, and broadcast.

Defined results: NULL and empty texts have no tokens and no leaves. Edits are (start, stop,
replacement) in code points of the text before any edit, disjoint; NULL edits are none, positions
beyond the text are cut to it, a NULL replacement deletes. Other columns are carried along.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterwise.llm.frames import free_name, rows_of
from quarterwise.llm.secret_scan import base_spans

LEAF = 512
MOST_BYTES = 64_000_000
# Fixed value: the pre-token pattern that belongs to the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: No pre-token of PATTERN reaches over such a place, and none changes with what lies beyond it.
_CUT = re.compile(r"(?<=[^\W_])(?=[ \n][^\W_])")
#: Characters around a cut that make it one.
_AROUND = 2

Edit = tuple[int, int, str]


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: a line of base64 and a number for each."""
    with open(path, "rb") as file:
        raw = file.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"vocabulary file of more than {MOST_BYTES} bytes: {path}")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def encoder(ranks: dict[bytes, int], pattern: str = PATTERN) -> Callable[[str], int]:
    """A function from text to its number of tokens; special tokens are ordinary text."""
    own = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(own.encode_ordinary(text)) if text else 0


def leaves(text: str, size: int = LEAF) -> list[int]:
    """Lengths of consecutive runs of pre-tokens, each the shortest of at least `size` characters."""
    lengths, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + size)
        end = m.start() if m else len(text)
        lengths.append(end - at)
        at = end
    return lengths


class SegmentTree:
    """Sums of characters and tokens over the leaves of one text."""

    def __init__(self, lengths: Sequence[int], tokens: Sequence[int]) -> None:
        self.n = 1 << max(0, len(lengths) - 1).bit_length()
        pad = [0] * (self.n - len(lengths))
        self.chars = [0] * self.n + [*lengths, *pad]
        self.tokens = [0] * self.n + [*tokens, *pad]
        for i in range(self.n - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, its start) of the leaf that holds the character at `place`, or the last with characters."""
        i, start = 1, 0
        place = min(place, self.chars[1] - 1)
        while i < self.n:
            left = self.chars[2 * i]
            i = 2 * i
            if place - start >= left:
                start += left
                i += 1
        return i - self.n, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.n
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def replace(self, text: str, edit: Edit, count: Callable[[str], int]) -> tuple[str, int]:
        """The text after one edit, the tree kept up with it; and how many characters were encoded again."""
        start, stop, new = edit
        if not self.chars[1]:
            self.put(0, len(new), count(new))
            return new, len(new)
        first, lo = self.find(max(0, start - _AROUND))
        last, at = self.find(max(start, stop - 1) + _AROUND)
        hi = at + self.chars[last + self.n]
        region = text[lo:start] + new + text[stop:hi]
        for leaf in range(first + 1, last + 1):
            if self.chars[leaf + self.n]:
                self.put(leaf, 0, 0)
        self.put(first, len(region), count(region))
        return text[:lo] + region + text[hi:], len(region)


def apply_edits(text: str, tree: SegmentTree, edits: Sequence[Edit], count: Callable[[str], int]) -> tuple[str, int]:
    """All edits, last one first so that the positions of the others hold."""
    again = 0
    for start, stop, new in sorted(edits, reverse=True):
        start = min(max(0, start), len(text))
        text, n = tree.replace(text, (start, min(max(start, stop), len(text)), new or ""), count)
        again += n
    return text, again


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN, leaf: int = LEAF) -> tuple[DataFrame, str]:
    """`docs` with a struct of n_tokens and the tree's leaves (leaf_chars, leaf_tokens), and its name."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name, columns = free_name(docs, "tree"), docs.columns
    kind = "n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    ints = pa.list_(pa.int32())
    arrow = pa.struct([("n_tokens", pa.int64()), ("leaf_chars", ints), ("leaf_tokens", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(shared.value, pattern)
        for batch in rows_of(batches, columns):
            rows = []
            for text in batch.column("text").to_pylist():
                lengths, tokens, at = leaves(text or "", leaf), [], 0
                for n in lengths:
                    tokens.append(count(text[at : at + n]))
                    at += n
                rows.append({"n_tokens": sum(tokens), "leaf_chars": lengths, "leaf_tokens": tokens})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], names=schema.names)

    return docs.mapInArrow(run, schema), name


def recount(
    counted: DataFrame, tree: str, edits: str, ranks: dict[bytes, int], pattern: str = PATTERN, texts: bool = True
) -> tuple[DataFrame, str]:
    """`counted` with a struct of what the edits of column `edits` (array of start, stop, replacement) make of it.

    The struct holds n_tokens, n_edits, n_chars (after), encoded_chars (encoded again) and the tree's
    leaves, so that further edits can follow, and the text after the edits unless `texts` is off.
    """
    shared = counted.sparkSession.sparkContext.broadcast(ranks)
    name, columns = free_name(counted, "recounted"), counted.columns
    kind = "text string, n_tokens long, n_edits long, n_chars long, encoded_chars long, leaf_chars array<int>, leaf_tokens array<int>"
    schema = T.StructType([*counted.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    ints, long = pa.list_(pa.int32()), pa.int64()
    arrow = pa.struct(
        [("text", pa.string()), ("n_tokens", long), ("n_edits", long), ("n_chars", long), ("encoded_chars", long), ("leaf_chars", ints), ("leaf_tokens", ints)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(shared.value, pattern)
        for batch in rows_of(batches, columns):
            rows = []
            for text, known, wanted in zip(*(batch.column(c).to_pylist() for c in ("text", tree, edits))):
                sums = SegmentTree(known["leaf_chars"], known["leaf_tokens"])
                changes = [(e["start"], e["stop"], e["replacement"]) for e in wanted or []]
                after, again = apply_edits(text or "", sums, changes, count)
                rows.append(
                    {
                        "text": after if texts else None,
                        "n_tokens": sums.tokens[1],
                        "n_edits": len(changes),
                        "n_chars": sums.chars[1],
                        "encoded_chars": again,
                        "leaf_chars": sums.chars[sums.n :],
                        "leaf_tokens": sums.tokens[sums.n :],
                    }
                )
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], names=schema.names)

    return counted.mapInArrow(run, schema), name


# Personal data that is edited out, beside secrets.
_PERSONAL = re.compile(
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b|\b[0-9]{13,19}\b"
)


def redactions(text: str | None, replacement: str = "[REDACTED]") -> list[Edit]:
    """Edits that replace secrets and personal data, overlapping spans joined."""
    text = text or ""
    spans = sorted([(s, e) for s, _, e in base_spans(text)] + [m.span() for m in _PERSONAL.finditer(text)])
    joined: list[list[int]] = []
    for lo, hi in spans:
        if joined and lo < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], hi)
        else:
            joined.append([lo, hi])
    return [(lo, hi, replacement) for lo, hi in joined]


def with_redactions(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with the edits of `redactions` as an array column, and its name."""
    name, columns = free_name(docs, "edits"), docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string("array<struct<start: int, stop: int, replacement: string>>"))])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("replacement", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, columns):
            rows = [
                [{"start": s, "stop": e, "replacement": new} for s, e, new in redactions(text)] for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], names=schema.names)

    return docs.mapInArrow(run, schema), name


def edited_counts(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Per document: doc_id, n_tokens, n_leaves, and after redaction n_edits, n_tokens_after, n_chars_after, encoded_chars."""
    edited, edits = with_redactions(docs.select("doc_id", "text"))
    counted, tree = count_tokens(edited, ranks)
    done, after = recount(counted, tree, edits, ranks, texts=False)
    t, a = F.col(tree), F.col(after)
    return done.select(
        "doc_id",
        t.n_tokens.alias("n_tokens"),
        F.size(t.leaf_chars).cast("long").alias("n_leaves"),
        a.n_edits.alias("n_edits"),
        a.n_tokens.alias("n_tokens_after"),
        a.n_chars.alias("n_chars_after"),
        a.encoded_chars.alias("encoded_chars"),
    )
