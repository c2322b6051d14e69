"""Stupid-backoff scores of documents, as joins of their n-grams with count tables.

The model is the corpus itself, leaving out the document that is scored: its own occurrences are
taken off every count, so a text is not its own evidence. A word scores the relative frequency of
its n-gram of the highest order that occurs in another document, times `BACKOFF` for each order
given up; at the lowest order that is its share of all words, and a word found nowhere else
counts as half an occurrence. Logarithms are summed per document.

Counts of words, of words as contexts and of pairs are gathered per slice of text and added up, each in a table
dealt by hash. N-grams are exploded to one row per document and distinct n-gram and joined to the count table of pairs by a hash
join, without a sort; the table lacks pairs of one document only, which nobody else has. Two bounded tables are
broadcast and spare most rows a join: counts of the `KNOWN` most frequent words, and of up to `COMMON` frequent pairs. Pairs in
the latter, if both words are known, are scored where they are read and not shuffled, so no pair gathers very many rows in
one task. Rows with a rarer word are joined to the table of words. Documents are scored in a few passes, so that
disk holds the rows of one part of them at a time. Orders above 2 take passes over the last context word and add up the counts of
longer n-grams by windows over the rows of a pass.

Words are runs of letters, digits and code points above ASCII, A-Z in lower case. Words and pairs are known by
64-bit hashes. Defined results: NULL and empty texts have no words, a sum of 0 and a NULL mean. A
single document is scored against nothing. Rows that share id and text are separate documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterwise.llm.frames import Scratch, rows_of, stored
from quarterwise.llm.words import ALNUM, Words, hash_words, mixed, split_words

ORDER = 2
BACKOFF = 0.4
PASSES = 3
#: Passes of orders above 2, whose rows are wider.
WIDE_PASSES = 5
#: Words whose counts are broadcast at most.
KNOWN = 200_000
#: Pairs whose counts are broadcast at most.
COMMON = 65_536
#: Bytes of text whose words or pairs are added up before they are dealt; numpy takes some 60 times as much.
SLICE = 1_000_000
#: Bytes of text whose n-grams are exploded together; numpy and the rows take some 100 times as much.
EXPLODED = 500_000
#: Parts over which the rows of a common pair are dealt.
SALTS = 1024
_U = np.uint64
#: The hash that stands before the first word of a text.
START = 0x5B8F1D2A3C4E6F71
_STEP = _U(0x9E3779B97F4A7C15)


def _grams(words: Words, hashes: np.ndarray, order: int) -> list[np.ndarray]:
    """For every word, the hashes of the words of its n-gram, the word itself last."""
    columns = [hashes]
    begins = words.rows[:-1][words.counts() > 0]
    for _ in range(order - 1):
        shifted = np.empty_like(columns[0])
        shifted[1:] = columns[0][:-1]
        shifted[begins] = _U(START)
        columns.insert(0, shifted)
    return columns


def _key(columns: list[np.ndarray], texts: np.ndarray) -> np.ndarray:
    """One number per text and n-gram."""
    return reduce(lambda key, c: mixed(key * _STEP + c), columns, mixed(texts.astype(_U)))


def _times(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often each wanted key is among the keys."""
    ranked = np.sort(keys)
    return np.searchsorted(ranked, wanted, side="right") - np.searchsorted(ranked, wanted, side="left")


def _names(order: int) -> tuple[list[str], list[str], list[str]]:
    """Columns of the n-gram's words, of own counts of n-grams between pair and highest order, of own longer contexts."""
    return (
        [f"h{i}" for i in range(1, order + 1)],
        [f"own{k}" for k in range(2, order)],
        [f"ctx{k}" for k in range(3, order + 1)],
    )


def _looked_up(known: tuple[np.ndarray, ...], keys: np.ndarray, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key, and which keys are there; `known` is sorted by its first array."""
    if not len(known[0]):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
    return known[which][place], known[0][place] == keys


def _left(known: tuple[np.ndarray, ...], keys: np.ndarray, which: int, own: np.ndarray) -> pa.Array:
    """What is left of a known word's count without the document's own; of other words the own count, as -1 - own."""
    count, there = _looked_up(known, keys, which)
    return pa.array(np.where(there, count - own, -1 - own))


def _pairs(columns: list[np.ndarray]) -> np.ndarray:
    """One number per pair of neighbouring words."""
    return mixed(mixed(columns[-2]) * _STEP + columns[-1]).view(np.int64)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each group in it, size of each group) of equal keys."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), ranked[1:] != ranked[:-1]]))
    return order, first, np.diff(np.append(first, len(keys)))


def _own_counts(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs among the keys."""
    order, _, sizes = _grouped(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def _explode_pairs(id_type: str, words_known, pairs_known, backoff: float, leave_out: bool):
    """A row per document and distinct pair that needs more counts, and one per document with the sums over its other pairs.

    Words are there where their counts are not known; `context_left` and `word_left` are what other documents leave of known
    counts, -1 - own otherwise. Rows of sums have `s`, n 0, and in these columns the words backed off and the unknown ones.
    """
    schema = f"doc_id {id_type}, tie long, pair long, n int, context_left long, word_left long, context long, word long, s double"
    names = ["doc_id", "tie", "pair", "n", "context_left", "word_left", "context", "word", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, ["doc_id", "tie", "text"], EXPLODED):
            words = split_words(batch.column("text"), ALNUM, lower=True)
            before, hashes = _grams(words, hash_words(words), 2)
            texts = np.repeat(np.arange(batch.num_rows), words.counts())
            own_word, own_context = (_own_counts(_key([x], texts)) * leave_out for x in (hashes, before))
            order, first, n = _grouped(_key([before, hashes], texts))
            row = order[first]
            text, pair = texts[row], _pairs([before, hashes])[row]
            common, is_common = _looked_up(pairs_known.value, pair)
            contexts, context_there = _looked_up(words_known.value, before[row].view(np.int64), 2)
            times, word_there = _looked_up(words_known.value, hashes[row].view(np.int64), 1)
            context_left = np.where(context_there, contexts - own_context[row], -1 - own_context[row])
            word_left = np.where(word_there, times - own_word[row], -1 - own_word[row])
            direct = is_common & context_there & word_there

            x = np.flatnonzero(direct)
            others = common[x] - n[x] * leave_out
            hit = others > 0
            as_pair = np.log(np.maximum(others, 1)) - np.log(np.maximum(context_left[x], 1))
            score = np.where(hit, as_pair, math.log(backoff) + np.log(np.maximum(word_left[x], 0.5))) * n[x]
            per_text = lambda w: np.bincount(text[x], w, batch.num_rows).astype(float)
            backed, unknown = (per_text(k * n[x]).astype(np.int64) for k in (~hit, ~hit & (word_left[x] <= 0)))
            rest, sums = np.flatnonzero(~direct), np.zeros(batch.num_rows, np.int32)
            none = np.ones(len(rest), bool)
            arrays = [
                batch.column("doc_id"),
                batch.column("tie"),
                batch.column("tie"),  # deals the sums like any other row
                pa.array(sums),
                pa.array(backed),
                pa.array(unknown),
                *[pa.nulls(batch.num_rows, pa.int64())] * 2,
                pa.array(per_text(score)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            at = pa.array(text[rest])
            rare = lambda source, there: pa.array(source[row[rest]].view(np.int64), mask=there[rest])
            arrays = [
                batch.column("doc_id").take(at),
                batch.column("tie").take(at),
                pa.array(pair[rest]),
                pa.array(n[rest].astype(np.int32)),
                pa.array(context_left[rest]),
                pa.array(word_left[rest]),
                rare(before, context_there),
                rare(hashes, word_there),
                pa.array(np.zeros(len(rest)), mask=none),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run, schema


def _pair_sums(rows: DataFrame, pairs: DataFrame, words: DataFrame, backoff: float, leave_out: bool, scratch: Scratch) -> DataFrame:
    """(doc_id, tie, s, backed, unknown, lowest) sums over the pairs of a pass; see `_sums` for the words scored at the lowest order."""
    n = F.col("n")
    others = F.coalesce(F.col("total") - (n if leave_out else F.lit(0)), F.lit(0))
    joined = rows.join(pairs.hint("shuffle_hash"), "pair", "left").withColumn("others", others)
    hit = F.col("others") > 0
    left = F.when(hit, F.col("context_left")).otherwise(F.col("word_left"))
    known, summed = left >= 0, F.col("s").isNotNull()
    open_ = ~summed & ~known
    alone = F.log(F.greatest(left.cast("double"), F.lit(0.5))) + F.lit(math.log(backoff))
    score = n * F.when(hit, F.log(F.col("others")) - F.log(left)).otherwise(alone)
    zero = F.lit(0)
    # rows whose words are known add up to one per document, the others stay apart by their rare word
    last = scratch.stored(
        joined.select(
            "doc_id",
            "tie",
            F.when(open_, F.when(hit, F.col("context")).otherwise(F.col("word"))).alias("word"),
            F.when(open_, left).alias("left"),
            F.when(open_ & hit, F.col("others")).alias("others"),
            F.coalesce("s", F.when(known, score), F.lit(0.0)).alias("s"),
            F.when(open_, n).otherwise(zero).alias("rare"),
            F.when(summed, F.col("context_left")).when(hit, zero).otherwise(n).alias("backed"),
            F.when(summed, F.col("word_left")).when(known & ~hit & (left <= 0), n).otherwise(zero).alias("unknown"),
        )
        .groupBy("doc_id", "tie", "word", "left", "others")
        .agg(*[F.sum(c).alias(c) for c in ("s", "rare", "backed", "unknown")]),
        "last",
    )
    plain = last.where(F.col("word").isNull()).select("doc_id", "tie", "s", "backed", "unknown", F.col("backed").alias("lowest"))
    hit = F.col("others").isNotNull()
    rare = last.where(F.col("word").isNotNull()).join(words, "word")
    rest = F.when(hit, F.col("contexts")).otherwise(F.col("times")) + F.col("left") + 1
    alone = F.log(F.greatest(rest.cast("double"), F.lit(0.5))) + F.lit(math.log(backoff))
    looked_up = rare.select(
        "doc_id",
        "tie",
        (F.col("rare") * F.when(hit, F.log(F.col("others")) - F.log(rest)).otherwise(alone)).alias("s"),
        "backed",
        F.when(~hit & (rest <= 0), F.col("rare")).otherwise(0).alias("unknown"),
        F.col("backed").alias("lowest"),
    )
    sums = [F.sum(c).alias(c) for c in ("s", "backed", "unknown", "lowest")]
    return plain.unionByName(looked_up).groupBy("doc_id", "tie").agg(*sums)


def _most_frequent(table: DataFrame, most: int, *times: str) -> DataFrame:
    """The rows with the highest count (of several the greatest), no more than `most`, cut at a count and not by a sort of all rows."""
    step = F.floor(F.log2(F.greatest(*times, F.lit(1))) * 16).cast("int")
    # a histogram of at most a thousand steps
    steps = sorted(((r["step"], r["n"]) for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    lowest, held = None, 0
    for at, n in steps:
        if held + n > most:
            break
        lowest, held = at, held + n
    return table.where(F.lit(False) if lowest is None else step >= lowest)


def _explode(id_type: str, order: int, passes: int, turn: int, words_known, pairs_known, leave_out: bool):
    hashes_, owns, contexts = _names(order)
    names = ["doc_id", "tie", *hashes_, "n", *owns, *contexts, "context_left", "word_left", "pair_times"]
    schema = f"doc_id {id_type}, tie long, " + ", ".join(f"{h} long" for h in hashes_) + ", n int"
    schema += "".join(f", {c} int" for c in [*owns, *contexts]) + ", context_left long, word_left long, pair_times long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, ["doc_id", "tie", "text"], EXPLODED):
            words = split_words(batch.column("text"), ALNUM, lower=True)
            hashes = hash_words(words)
            texts = np.repeat(np.arange(batch.num_rows), words.counts())
            columns = _grams(words, hashes, order)
            here = np.flatnonzero(mixed(columns[-2] + _STEP) % _U(passes) == _U(turn)) if order > 1 else np.arange(len(texts))
            own = [c[here] for c in columns]
            texts_here = texts[here]
            _, first, n = np.unique(_key(own, texts_here), return_index=True, return_counts=True)
            row, row_texts = [c[first] for c in own], texts_here[first]
            # an n-gram or context that holds the last context word lies in this pass, a word alone may not
            times = lambda source, cut, where: _times(_key(source[cut], where), _key(row[cut], row_texts))
            counts = [times(own, slice(-k, None), texts_here) for k in range(2, order)]
            counts += [times(own, slice(-k, -1), texts_here) for k in range(3, order + 1)]
            in_word = times(columns, slice(-1, None), texts) * leave_out
            in_context = times(own, slice(-2, -1), texts_here) * leave_out
            common, is_common = _looked_up(pairs_known.value, _pairs(row))
            at = pa.array(row_texts)
            arrays = [
                batch.column("doc_id").take(at),
                batch.column("tie").take(at),
                *[pa.array(c.view(np.int64)) for c in row],
                *[pa.array(c.astype(np.int32)) for c in (n, *counts)],
                _left(words_known.value, row[-2].view(np.int64), 2, in_context),
                _left(words_known.value, row[-1].view(np.int64), 1, in_word),
                pa.array(common, mask=~is_common),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run, schema


def _survey(id_type: str):
    """Per slice: documents with their number of words, words with their counts as words and as contexts."""
    schema = f"doc_id {id_type}, tie long, n_words long, word long, times long, contexts long"
    names = ["doc_id", "tie", "n_words", "word", "times", "contexts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, ["doc_id", "tie", "text"], SLICE):
            words = split_words(batch.column("text"), ALNUM, lower=True)
            long = lambda n: pa.nulls(n, pa.int64())
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(words.counts()), *[long(rows)] * 3], names=names
            )
            before, hashes = _grams(words, hash_words(words), 2)
            both = np.concatenate([hashes, before])
            order, first, _ = _grouped(both)
            keys = both[order[first]]
            as_word = np.concatenate([[0], np.cumsum(order < len(hashes))])
            ends = np.append(first[1:], len(both)) if len(first) else first
            times = as_word[ends] - as_word[first]
            contexts = ends - first - times
            nothing = pa.nulls(len(keys), batch.column("doc_id").type)
            counts = [pa.array(c.astype(np.int64)) for c in (keys.view(np.int64), times, contexts)]
            yield pa.RecordBatch.from_arrays([nothing, *[long(len(keys))] * 2, *counts], names=names)

    return run, schema


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice: every pair, how often it occurs and in how many documents."""
    for batch in rows_of(batches, ["text"], SLICE):
        words = split_words(batch.column("text"), ALNUM, lower=True)
        texts = np.repeat(np.arange(batch.num_rows), words.counts())
        pairs = _pairs(_grams(words, hash_words(words), 2))
        order, first, times = _grouped(_key([pairs.view(_U)], texts))
        each = pairs[order[first]]
        order, first, docs = _grouped(each)
        n = np.add.reduceat(times[order], first) if len(first) else docs
        arrays = [pa.array(x.astype(np.int64)) for x in (each[order[first]], n, docs)]
        yield pa.RecordBatch.from_arrays(arrays, names=["pair", "n", "docs"])


def _log_share(count: Column, total: Column, given_up: int, backoff: float) -> Column:
    return F.log(count) - F.log(total) + F.lit(given_up * math.log(backoff))


def _sums(rows: DataFrame, words: DataFrame, order: int, backoff: float, leave_out: bool, scratch: Scratch) -> DataFrame:
    """(doc_id, tie, s, backed, unknown, lowest) sums over the rows of a pass.

    The words scored at the lowest order (`lowest` of them) have yet to be divided by the words of the
    other documents.
    """
    hashes, _, _ = _names(order)
    own = (lambda c: F.col(c)) if leave_out else (lambda c: F.lit(0))
    # rows of a common pair go anywhere, but rows of one longer n-gram still go together
    spread = F.xxhash64("doc_id", "tie") if order == 2 else F.xxhash64(hashes[-3])
    salted = rows.withColumn("salt", F.when(F.col("pair_times").isNotNull(), F.pmod(spread, F.lit(SALTS))).otherwise(0))
    summed = salted.withColumn(f"own{order}", F.col("n"))
    for k in range(2, order + 1):
        times = F.sum("n").over(Window.partitionBy(*hashes[-k:], "salt"))
        summed = summed.withColumn(f"others{k}", (F.coalesce("pair_times", times) if k == 2 else times) - own(f"own{k}"))
    level, others = F.lit(1), F.lit(None).cast("long")
    for k in range(2, order + 1):
        there = F.col(f"others{k}") > 0
        level, others = F.when(there, k).otherwise(level), F.when(there, F.col(f"others{k}")).otherwise(others)
    # pairs need the count of their first word as a context, words alone that of the word itself
    pair = F.col("level") >= 2
    last = scratch.stored(
        summed.withColumns({"level": level, "others": others}).select(
            "doc_id",
            "tie",
            "n",
            "level",
            "others",
            F.when(pair, F.col("context_left")).otherwise(F.col("word_left")).alias("left"),
            F.when(pair, F.col(hashes[-2])).otherwise(F.col(hashes[-1])).alias("word"),
            *(hashes if order > 2 else []),
            *[own(f"ctx{k}").alias(f"ctx{k}") for k in range(3, order + 1)],
        ),
        "last",
    )
    found = []
    for k in range(3, order + 1):
        context = hashes[-k:-1]
        contexts = last.groupBy(*context).agg(F.sum("n").alias("context_times"))
        hit = last.where(F.col("level") == k).join(contexts, context)
        share = _log_share(F.col("others"), F.col("context_times") - F.col(f"ctx{k}"), order - k, backoff)
        backed = F.lit(0) if k == order else F.col("n")
        found.append(hit.select("doc_id", "tie", (share * F.col("n")).alias("s"), backed.alias("backed"), F.lit(0).alias("unknown"), F.lit(0).alias("lowest")))
    # rarer words carry -1 - own instead
    short = last.where("level <= 2").select("doc_id", "tie", "n", "level", "others", "left", "word")
    count = F.coalesce(F.when(pair, F.col("contexts")).otherwise(F.col("times")), F.lit(0))
    rare = short.where("left < 0").join(words, "word", "left").withColumn("left", count + F.col("left") + 1)
    both = short.where("left >= 0").drop("word").unionByName(rare.select("doc_id", "tie", "n", "level", "others", "left"))
    left = F.col("left")
    as_pair = _log_share(F.col("others"), left, order - 2, backoff)
    alone = F.log(F.when(left > 0, left).otherwise(0.5)) + F.lit((order - 1) * math.log(backoff))
    found.append(
        both.select(
            "doc_id",
            "tie",
            (F.when(pair, as_pair).otherwise(alone) * F.col("n")).alias("s"),
            (F.col("n") if order > 2 else F.when(pair, 0).otherwise(F.col("n"))).alias("backed"),
            F.when(pair | (left > 0), 0).otherwise(F.col("n")).alias("unknown"),
            F.when(pair, 0).otherwise(F.col("n")).alias("lowest"),
        )
    )
    sums = [F.sum(c).alias(c) for c in ("s", "backed", "unknown", "lowest")]
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "tie").agg(*sums)


def score_documents(
    docs: DataFrame,
    order: int = ORDER,
    backoff: float = BACKOFF,
    passes: int | None = None,
    known: int = KNOWN,
    common: int = COMMON,
    leave_out: bool = True,
) -> DataFrame:
    """Per document: doc_id, n_words, log_score (natural), mean_log_score, n_backed_off, n_unknown.

    n_backed_off counts the words that the highest order does not know from other documents,
    n_unknown those found in no other document at all.
    """
    if order < 2:
        raise ValueError("order is at least 2")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    survey, survey_schema = _survey(id_type)
    broadcast = docs.sparkSession.sparkContext.broadcast
    with Scratch() as scratch:
        surveyed = scratch.stored(plain.mapInArrow(survey, survey_schema), "survey")
        sizes = stored(surveyed.where(F.col("n_words").isNotNull()).select("doc_id", "tie", "n_words"), "sizes")
        counted = surveyed.where(F.col("word").isNotNull()).groupBy("word")
        words = stored(counted.agg(F.sum("times").alias("times"), F.sum("contexts").alias("contexts")), "words")
    counted = plain.select("text").mapInArrow(_count_pairs, "pair long, n long, docs long").groupBy("pair")
    totals = counted.agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    # what is in one document only counts nothing where that document is left out
    pairs = stored(totals.where(F.col("docs") > 1 if leave_out else F.lit(True)).select("pair", "total"), "pairs")
    total = sizes.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    # these two tables are bounded by their limits
    top = _most_frequent(words, known, "times", "contexts").toPandas().sort_values("word")
    words_known = broadcast(tuple(top[c].to_numpy(np.int64) for c in ("word", "times", "contexts")))
    exact = _most_frequent(pairs, common, "total").toPandas().sort_values("pair")
    pairs_known = broadcast((exact["pair"].to_numpy(np.int64), exact["total"].to_numpy(np.int64)))
    parts = []
    passes = passes or (PASSES if order == 2 else WIDE_PASSES)
    for turn in range(passes):
        with Scratch() as scratch:
            if order == 2:
                explode, schema = _explode_pairs(id_type, words_known, pairs_known, backoff, leave_out)
                some = plain.where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(passes)) == turn)
                summed = _pair_sums(some.mapInArrow(explode, schema), pairs, words, backoff, leave_out, scratch)
            else:
                explode, schema = _explode(id_type, order, passes, turn, words_known, pairs_known, leave_out)
                summed = _sums(plain.mapInArrow(explode, schema), words, order, backoff, leave_out, scratch)
            parts.append(stored(summed, "pass-sums"))
    sums = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "tie").agg(*[F.sum(c).alias(c) for c in ("s", "backed", "unknown", "lowest")])
    copies = sizes.groupBy("doc_id", "tie").agg(F.first("n_words").alias("n_words"), F.count("*").alias("copies"))
    same = F.col("c.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("c.tie") == F.col("t.tie"))
    joined = copies.alias("c").join(sums.alias("t"), same, "left")
    rest = F.greatest(F.lit(total) - (F.col("n_words") if leave_out else F.lit(0)), F.lit(1))
    # rows that share id and text have added up; each is scored alike
    log_score = F.coalesce((F.col("s") - F.col("lowest") * F.log(rest)) / F.col("copies"), F.lit(0.0))
    each = lambda c: F.coalesce((F.col(c) / F.col("copies")).cast("long"), F.lit(0).cast("long"))
    scored = joined.select(
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        F.col("c.doc_id").alias("doc_id"),
        "n_words",
        log_score.alias("log_score"),
        F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("mean_log_score"),
        each("backed").alias("n_backed_off"),
        each("unknown").alias("n_unknown"),
    )
    return scored.drop("copy")
