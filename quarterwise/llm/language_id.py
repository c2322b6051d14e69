"""Language identification: words first, then shorter and shorter character n-grams.

A known word adds its log frequency in each language. An unseen word backs off to its
character n-grams (word edges marked): the longest length of which any n-gram is known
counts, as the mean over the known ones; a word without known characters adds nothing.

A word is a letter and the letters and combining marks after it, in lower case and composed
form (NFC), in learning as in prediction.

The model is fitted on a bounded sample of labelled rows: about `per_language` documents of
each language, chosen by a hash of the id, whole texts. Every word and n-gram of the sample is
known (callers may keep the most frequent only). It is stored sparsely, one entry per item and
language in which it occurs, and broadcast. Its size is counted before it leaves the executors:
beyond `max_entries` entries (16 bytes each, and a dictionary of the items) or `max_languages`
languages the fit stops with an error; a smaller `per_language` mends that. Prediction is a narrow map over
whole texts and needs no exchange.

Defined results: NULL text or a text without any letter gives `und` with score 0; so does
every text when there is nothing to learn from. Ties go to the language that comes first by
name. Rows and other columns are carried along untouched; added columns take a free name.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterwise.llm.frames import free_name, rows_of, stored

UNDETERMINED = "und"
PER_LANGUAGE = 4000
MAX_LANGUAGES = 500
MAX_ENTRIES = 20_000_000
LENGTHS = (4, 3, 2, 1)
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
# up to U+02FF there are no marks, and composed form changes nothing: a plain class does the same
_BEYOND = re.compile("[^\u0000-\u02ff]")
_NEAR_WORD = re.compile("[" + "".join(c for c in map(chr, range(0x300)) if c.isalpha()) + "]+")
_PIECE = 1_000_000
_CACHED = 200_000
_LONGEST = 64
_ADD = 0.5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Languages in name order; known words and n-grams with their row.

    A row's log frequency in a language is `base[kinds[row]]` of it, what an item never seen there has, plus
    `more` at the entries `starts[row]:starts[row + 1]`, whose languages are `where`.
    """

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    kinds: np.ndarray
    base: np.ndarray
    starts: np.ndarray
    where: np.ndarray
    more: np.ndarray

    def total(self, rows: list[int], weights: list[float]) -> np.ndarray:
        """The weighted sum of the rows' log frequencies."""
        at, w = np.array(rows, np.int64), np.array(weights, float)
        first, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        entries = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        seen = np.bincount(self.where[entries], np.repeat(w, n) * self.more[entries], len(self.languages))
        return seen + np.bincount(self.kinds[at], w, len(self.base)) @ self.base


def _no_model(languages: list[str]) -> Model:
    none = np.zeros(0, np.int64)
    return Model(languages, {}, {}, none, np.zeros((1 + len(LENGTHS), len(languages))), np.zeros(1, np.int64), none, np.zeros(0))


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case and composed form."""
    low = text.lower()
    if _BEYOND.search(low) is None:
        return _NEAR_WORD.findall(low)
    return _WORD.findall(unicodedata.normalize("NFC", low))


def _word_counts(sample: DataFrame) -> DataFrame:
    """(lang, item, n) of words; added up per batch of texts before the exchange."""
    schema = "lang string, item string, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, ["lang", "text"]):
            counts: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                for piece in _pieces(text):
                    counts.update((lang, w) for w in words_of(piece))
            langs, items = zip(*counts) if counts else ((), ())
            arrays = [pa.array(langs, pa.string()), pa.array(items, pa.string()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "item", "n"])

    return sample.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "item").agg(F.sum("n").alias("n"))


def _counted(sample: DataFrame, max_words: int | None, max_grams: int | None) -> DataFrame:
    """(kind, item, lang, n): kind 0 for words, else the n-gram length.

    With limits, the most frequent of each language are chosen; what is chosen has its count in every language.
    """
    words = stored(_word_counts(sample), "language-words")
    both = words.select("lang", "item", "n", F.lit(0).alias("kind"))
    for size in LENGTHS:
        marked = F.concat(F.lit("<"), "item", F.lit(">")) if size > 1 else F.col("item")
        at = F.explode(F.sequence(F.lit(1), F.greatest(F.length(marked) - size + 1, F.lit(1))))
        pieces = words.select("lang", "n", marked.alias("w"), at.alias("at")).select("lang", "n", F.substring("w", F.col("at"), F.lit(size)).alias("item"))
        part = pieces.where(F.length("item") == size).groupBy("lang", "item").agg(F.sum("n").alias("n"))
        both = both.unionByName(part.withColumn("kind", F.lit(size)))
    both = stored(both, "language-counts")
    if max_words is None and max_grams is None:
        return both
    best = Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "item")
    limit = F.when(F.col("kind") == 0, F.lit(max_words)).otherwise(F.lit(max_grams))
    kept = limit.isNull() | (F.col("place") <= limit)
    chosen = both.withColumn("place", F.row_number().over(best)).where(kept).select("kind", "item").distinct()
    return both.join(chosen, ["kind", "item"], "left_semi").select("kind", "item", "lang", "n")


def fit(
    labelled: DataFrame,
    per_language: int = PER_LANGUAGE,
    max_words: int | None = None,
    max_grams: int | None = None,
    max_languages: int = MAX_LANGUAGES,
    max_entries: int = MAX_ENTRIES,
) -> Model:
    """Learn from the text and lang of `labelled`, about `per_language` rows (by a hash of doc_id) per language.

    All words and n-grams of these rows are known, unless `max_words` or `max_grams` keeps the most frequent of each language.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("rows"))
    many = sizes.limit(max_languages + 1).collect()
    if len(many) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages if the model may grow with them")
    keep = {r["lang"]: min(1.0, per_language / r["rows"]) for r in many}
    if not keep:
        return _no_model([])
    share = F.create_map(*[F.lit(x) for pair in keep.items() for x in pair])[F.col("lang")]
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) < share * (1 << 30))
    counted = _counted(sample, max_words, max_grams)
    entries = counted.count()
    if entries > max_entries:
        raise ValueError(f"{entries} counts are more than {max_entries}; learn from fewer documents a language")
    # the largest sum of bytes is the bound on entries; dictionary codes keep the driver's copy small
    table = counted.toArrow()
    languages = sorted(keep)
    lang = table["lang"].combine_chunks().dictionary_encode()
    column = np.searchsorted(languages, lang.dictionary.to_pylist())[lang.indices.to_numpy()] if entries else np.zeros(0, np.int64)
    kind, n = table["kind"].to_numpy(), table["n"].to_numpy().astype(float)
    item = table["item"].combine_chunks()
    places: list[dict[str, int]] = [{}, {}]
    model = _no_model(languages)
    kinds, sizes_of, where, more, at = [model.kinds], [model.starts], [model.where], [model.more], 0
    for k, size in enumerate((0, *LENGTHS)):
        part = np.flatnonzero(kind == size)
        coded = item.take(pa.array(part)).dictionary_encode()
        code, items = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if not items:
            continue
        sums = np.bincount(column[part], n[part], len(languages)) + _ADD * len(items)
        model.base[k] = np.log(_ADD / sums)
        order = np.argsort(code, kind="stable")
        kinds.append(np.full(len(items), k))
        sizes_of.append(np.bincount(code, minlength=len(items)))
        where.append(column[part][order])
        more.append(np.log((n[part][order] + _ADD) / _ADD))
        places[size > 0].update(zip(items, range(at, at + len(items))))
        at += len(items)
    joined = [np.concatenate(x) for x in (kinds, where, more)]
    return Model(languages, *places, joined[0], model.base, np.cumsum(np.concatenate(sizes_of)), joined[1], joined[2])


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about a million characters, cut at blanks."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        cut = text.find(" ", end) if end < len(text) else -1
        end = len(text) if cut < 0 else cut
        yield text[at:end]
        at = end


class Scorer:
    """Scores texts by a model; remembers the n-grams of unseen words, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.unseen: dict[str, tuple[int, ...]] = {}

    def rows_of_unseen(self, word: str) -> tuple[int, ...]:
        """Rows of the word's known n-grams of the longest length that has any."""
        if (found := self.unseen.get(word)) is not None:
            return found
        found = ()
        for size in LENGTHS:
            marked = f"<{word}>" if size > 1 else word
            found = tuple(self.model.grams[g] for i in range(len(marked) - size + 1) if (g := marked[i : i + size]) in self.model.grams)
            if found:
                break
        if len(self.unseen) >= _CACHED:
            self.unseen.clear()
        if len(word) <= _LONGEST:
            self.unseen[word] = found
        return found

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts: Counter[str] = Counter()
        for piece in _pieces(text or ""):
            counts.update(words_of(piece))
        if not self.model.languages or not counts:
            return UNDETERMINED, 0.0
        total = np.zeros(len(self.model.languages))
        rows: list[int] = []
        weights: list[float] = []
        known = self.model.words
        for word, n in counts.items():
            if (row := known.get(word)) is not None:
                rows.append(row)
                weights.append(n)
            elif grams := self.rows_of_unseen(word):
                rows += grams
                weights += [n / len(grams)] * len(grams)
            if len(rows) >= _CACHED:
                total += self.model.total(rows, weights)
                rows, weights = [], []
        if rows:
            total += self.model.total(rows, weights)
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score added, under those names where they are free."""
    # plain values: executors need not know the class
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(free_name(docs, "lang_pred"), T.StringType()), T.StructField(free_name(docs, "score"), T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in rows_of(batches, columns):
            found = [scorer(text) for text in batch.column("text").to_pylist()]
            added = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return docs.mapInArrow(run, schema)
