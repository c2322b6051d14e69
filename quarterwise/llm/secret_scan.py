"""Secrets in texts: fixed patterns, and sliding-window entropy per character class.

Three patterns give the base spans: assignments, access keys and long hexadecimal runs,
leftmost and non-overlapping per kind. On top, candidate strings (long runs of token
characters) are scanned with a window of fixed width. Character counts are kept up to date
as the window moves, and with them the sum of n log n, so the Shannon entropy costs one
step per character. A window counts if all its characters belong to a class and its entropy reaches
that class's threshold, or the higher `letters_bits` where the candidate as a whole does not mix digits and
letters; neighbouring windows join to one span of kind `entropy`. Candidates on the allow-list (UUIDs, digits
only, repeated or counting placeholders, words, identifiers) are suppressed. Base spans always stay.

A narrow map over whole texts. NULL and empty texts have no spans; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarterwise.llm.frames import rows_of

Span = tuple[int, str, int]

# The base kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN = 8
LEAST_ACCESS = 16

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class CharacterClass:
    """Characters a window may hold, and the least entropy in bits per character."""

    characters: frozenset[str]
    least_bits: float


WINDOW = 20
CLASSES = (
    CharacterClass(frozenset("0123456789abcdef"), 3.0),
    CharacterClass(frozenset("0123456789ABCDEF"), 3.0),
    CharacterClass(frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"), 3.7),
)
#: The least entropy where a candidate has fewer than two digits or letters.
LETTERS_BITS = 3.8
_CONSONANTS = "[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]"
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9+/_=-]+",
    r"(.)\1+",
    r"(?:0123456789)?(?:abcdef(?:ghijklmnopqrstuvwxyz)?|ABCDEF(?:GHIJKLMNOPQRSTUVWXYZ)?)+[0-9]*",
    r"(?:[A-Za-z]+[/_=-])+[A-Za-z]*[0-9]{0,4}",
    # words in one case, with at most four consonants on end, and identifiers of capitalised parts
    rf"(?=[A-Za-z][a-z]*\Z|[A-Z]*\Z)(?:{_CONSONANTS}{{0,4}}[aeiouyAEIOUY])+{_CONSONANTS}{{0,4}}",
    r"[a-z]*(?:[A-Z]{1,5}[a-z]{2,})+[A-Z]{0,5}[0-9]{0,1}",
)


class AnyOf:
    """Several patterns as one test for a whole match."""

    def __init__(self, patterns: list[re.Pattern[str]]) -> None:
        self.patterns = patterns

    def fullmatch(self, text: str) -> bool:
        return any(p.fullmatch(text) for p in self.patterns)


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the three fixed patterns."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # a run of 32 or more starts where the whole run starts, so this finds the long runs and no others
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return found


def dense_runs(text: str, of: CharacterClass, window: int = WINDOW, mixed: bool = True) -> list[tuple[int, int]]:
    """Ranges covered by windows of the class whose entropy reaches the threshold and, if asked, that mix digits and letters."""
    table = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    whole = math.log2(window)
    counts: dict[str, int] = {}
    weight, digits, letters, inside = 0.0, 0, 0, 0
    runs: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        if c not in of.characters:
            counts, weight, digits, letters, inside = {}, 0.0, 0, 0, 0
            continue
        n = counts.get(c, 0)
        weight += table[n + 1] - table[n] if n < window else 0.0
        counts[c] = n + 1
        digits += c.isdigit()
        letters += c.isalpha()
        inside += 1
        if inside > window:
            old = text[i - window]
            n = counts[old]
            weight += table[n - 1] - table[n] if n <= window else 0.0
            counts[old] = n - 1
            digits -= old.isdigit()
            letters -= old.isalpha()
        if inside >= window and whole - weight / window >= of.least_bits and (not mixed or digits >= 2 and letters >= 2):
            start = i - window + 1
            if runs and start <= runs[-1][1]:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((start, i + 1))
    return runs


def entropy_spans(
    text: str, classes: Sequence[CharacterClass], allowed: AnyOf, window: int = WINDOW, letters_bits: float = LETTERS_BITS
) -> list[Span]:
    """Spans of dense windows in candidate strings that are not on the allow-list."""
    found = []
    higher = [CharacterClass(k.characters, max(k.least_bits, letters_bits)) for k in classes]
    for m in _CANDIDATE.finditer(text):
        candidate = m.group()
        if len(candidate) < window or allowed.fullmatch(candidate):
            continue
        n_digits, n_letters = (sum(map(f, candidate)) for f in (str.isdigit, str.isalpha))
        wanted = classes if n_digits >= 2 and n_letters >= 2 else higher
        ranges = sorted({r for k in wanted for r in dense_runs(candidate, k, window, mixed=False)})
        joined: list[list[int]] = []
        for lo, hi in ranges:
            if joined and lo <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], hi)
            else:
                joined.append([lo, hi])
        found += [(m.start() + lo, "entropy", m.start() + hi) for lo, hi in joined if not allowed.fullmatch(candidate[lo:hi])]
    return found


def _written(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in ordered)


_SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def scan_secrets(
    docs: DataFrame,
    classes: Sequence[CharacterClass] = CLASSES,
    allowed: Sequence[str] = ALLOWED,
    window: int = WINDOW,
) -> DataFrame:
    """doc_id with counts per kind, a digest of the base spans, and all spans as kind:start:end."""
    wanted = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(_SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = AnyOf([re.compile(a) for a in allowed])
        for batch in rows_of(batches, ["doc_id", "text"]):
            out: list[tuple] = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = entropy_spans(text or "", classes, allow, window)
                kinds = [s[1] for s in base]
                digest = hashlib.sha256(_written(base).encode()).hexdigest()
                out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, _written(base + more), len(more)))
            columns = zip(*out) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=schema.names)

    return wanted.mapInArrow(run, schema)
