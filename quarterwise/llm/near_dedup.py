"""Near-duplicate classes by BagMinHash signatures, bands and verified multiset overlap.

A text is the multiset of its five-word shingles (words of letters, digits and code points above
ASCII, A-Z in lower case; a shorter text is one shingle). Similarity is the weighted Jaccard
index: the sum of the lesser counts over the sum of the greater ones.

BagMinHash: every shingle carries Poisson processes over its discretised weight axis, one per
dyadic interval (0,1], (1,2], (2,4], ... A point has a time, a place on the weight axis and
a signature component; a document with weight w sees the points placed at or below w. An
interval that w cuts is thus split hierarchically by thinning. A component's value is its
earliest time, so two documents agree in a component with a probability equal to their
similarity. Points later than the latest component so far are never drawn, so a long text
needs little more than one point per shingle.

Texts with the same words collapse first. Signatures are cut into bands; documents that
share a band are candidates, and only (member, least member of the bucket) is emitted. Connected
candidates form clusters, and each is verified by exact overlaps: a search from every member
over those not yet reached, so no link is lost and no list of pairs is made. Clusters beyond
`block` members are cut into hash blocks that share some common members; whoever is not in
the largest class afterwards is compared with every block. So one task never holds more
than a few blocks, however large a group of near copies is.

Defined results: texts without words (NULL, empty, punctuation only) are each a class of
their own. A class is named by its least doc_id, which is the one kept. Rows that share
doc_id and text stand or fall together in `drop_near_copies`. Other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterwise.llm.components import connected_components
from quarterwise.llm.frames import free_name, rows_of
from quarterwise.llm.words import ALNUM, Words, hash_windows, hash_words, mixed, split_words, window_rows
from quarterwise.session import materialise

SHINGLE = 5
LEAST = 0.8
COMPONENTS = 128
BANDS, ROWS = 25, 5
#: Members of a verified block, and members that all blocks of a cluster share.
BLOCK, COMMON = 512, 32
_U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_STEP = _U(_GOLDEN)


def shingles(words: Words, hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle; a text of fewer words is one shingle."""
    first, text = window_rows(words.rows, size)
    keys = [hash_windows(hashes, size)[first] if len(first) else np.zeros(0, _U)]
    texts = [text]
    counts = words.counts()
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        if len(short):
            keys.append(hash_windows(hashes, k, seed=k)[words.rows[short]])
            texts.append(short)
    return np.concatenate(keys), np.concatenate(texts)


def multisets(keys: np.ndarray, texts: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, text, count) sorted by text: the multiset of each text."""
    packed = np.sort((texts.astype(_U) << _U(48)) | (keys >> _U(16)))  # rows_of gives fewer than 2**16 texts
    new = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([new, [len(packed)]])).astype(np.int64)
    packed = packed[new]
    return packed & _U((1 << 48) - 1), (packed >> _U(48)).astype(np.int64), counts


def bag_minhash(keys: np.ndarray, texts: np.ndarray, counts: np.ndarray, n_texts: int, components: int = COMPONENTS) -> np.ndarray:
    """Signatures, n_texts x components: the earliest time per component, infinite for empty multisets."""
    times = np.full(n_texts * components, np.inf)
    owner, seed, low, rate, limit = [], [], [], [], []
    lo, level = 0, 0
    while len(inside := np.flatnonzero(counts > lo)):
        hi = max(1, lo * 2)
        owner.append(texts[inside])
        seed.append(mixed(keys[inside] + _U(level * _GOLDEN % 2**64)))
        low.append(np.full(len(inside), float(lo)))
        rate.append(np.full(len(inside), float(hi - lo)))
        limit.append(counts[inside].astype(float))
        lo, level = hi, level + 1
    if not owner:
        return times.reshape(n_texts, components)
    at, key, base, speed, most = (np.concatenate(x) for x in (owner, seed, low, rate, limit))
    now, draw = np.zeros(len(at)), 0
    whole = speed == 1.0
    latest = np.full(n_texts, np.inf)
    while len(at):
        draw += 1
        random = mixed(key + _U(draw * _GOLDEN % 2**64))
        now = now - np.log(((random >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / speed
        live = now < latest[at]
        at, key, base, speed, most, now, random, whole = (x[live] for x in (at, key, base, speed, most, now, random, whole))
        seen = whole.copy()
        cut = np.flatnonzero(~whole)
        seen[cut] = base[cut] + (mixed(random[cut]) >> _U(11)).astype(np.float64) * 2.0**-53 * speed[cut] < most[cut]
        place = at * components + (random % _U(components)).astype(np.int64)
        np.minimum.at(times, place[seen], now[seen])
        latest = times.reshape(n_texts, components).max(axis=1)
    return times.reshape(n_texts, components)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per text and band."""
    bits = np.ascontiguousarray(signatures[:, : bands * rows]).view(_U).reshape(len(signatures), bands, rows)
    keys = mixed(np.arange(1, bands + 1, dtype=_U))[None, :] * np.ones((len(signatures), 1), _U)
    for r in range(rows):
        keys = mixed(keys * _STEP + bits[:, :, r])
    return keys.view(np.int64)


def signatures_of(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, tie, row, digest, bands) per document: digest of the words, and band keys."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, tie long, digest binary, bands array<long>"
    plain = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, ["doc_id", "text", "tie"]):
            words = split_words(batch.column("text"), ALNUM, lower=True)
            hashes = hash_words(words)
            n = batch.num_rows
            bags = multisets(*shingles(words, hashes), n)
            keys = band_keys(bag_minhash(*bags, n, max(COMPONENTS, bands * rows)), bands, rows)
            empty = words.counts() == 0
            digests = [
                None if empty[i] else hashlib.blake2b(hashes[words.rows[i] : words.rows[i + 1]].tobytes(), digest_size=16).digest()
                for i in range(n)
            ]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
            arrays = [batch.column("doc_id"), batch.column("tie"), pa.array(digests, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tie", "digest", "bands"])

    return plain.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


class Overlaps:
    """Exact weighted Jaccard indices among the texts of one group."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        words = split_words(column, ALNUM, lower=True)
        keys, texts = shingles(words, hash_words(words))
        # the n-th copy of a shingle is an element of its own: lesser counts become common elements
        order = np.lexsort((keys, texts))
        keys, texts = keys[order], texts[order]
        same = np.concatenate([[False], (keys[1:] == keys[:-1]) & (texts[1:] == texts[:-1])]) if len(keys) else np.zeros(0, bool)
        place = np.arange(len(keys))
        start = np.maximum.accumulate(np.where(same, 0, place)) if len(keys) else place
        elements = mixed(keys + (place - start).astype(_U) * _STEP)
        self.n = len(column)
        self.sizes = np.bincount(texts, minlength=self.n)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = np.unique(elements, return_inverse=True)[1]
        self.marks = np.zeros(int(self.ids.max()) + 1 if len(self.ids) else 0, bool)

    def of(self, i: int, others: np.ndarray) -> np.ndarray:
        """Similarities of text i with the given others."""
        own = self.ids[self.starts[i] : self.starts[i + 1]]
        self.marks[own] = True
        if len(others) * 4 < self.n:
            common = np.array([np.count_nonzero(self.marks[self.ids[self.starts[j] : self.starts[j + 1]]]) for j in others], np.int64)
        else:
            sums = np.concatenate([[0], np.cumsum(self.marks[self.ids])])
            common = (sums[self.starts[1:]] - sums[self.starts[:-1]])[others]
        self.marks[own] = False
        return common / np.maximum(1, len(own) + self.sizes[others] - common)

    def classes(self, least: float) -> np.ndarray:
        """For each text the first text of its class: the closure of all links within the group."""
        root = np.arange(self.n)
        left = np.arange(self.n)
        while len(left):
            first, left = left[0], left[1:]
            open_ = [first]
            while open_ and len(left):
                near = self.of(open_.pop(), left) >= least
                reached = left[near]
                root[reached] = first
                open_ += reached.tolist()
                left = left[~near]
        return root


def _close(least: float):
    def run(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        order = np.argsort(nodes)
        group = group.take(pa.array(order))
        nodes = nodes[order]
        return pa.table({"a": nodes, "b": nodes[Overlaps(group.column("text")).classes(least)]})

    return run


def _reach(least: float):
    def run(group: pa.Table) -> pa.Table:
        probe = group.column("probe").to_numpy(zero_copy_only=False)
        nodes, roots = group.column("node").to_numpy(), group.column("root").to_numpy()
        overlaps = Overlaps(group.column("text"))
        members = np.flatnonzero(~probe)
        found: set[tuple[int, int]] = set()
        for i in np.flatnonzero(probe):
            others = members[roots[members] != roots[i]]
            near = others[overlaps.of(i, others) >= least]
            found.update((int(nodes[i]), int(r)) for r in np.unique(roots[near]))
        rows = sorted(found)
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})

    return run


def candidate_clusters(signatures: DataFrame) -> DataFrame:
    """(node, root) of representatives connected by shared bands, only those with company."""
    keyed = signatures.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    # a member and its leasts are connected through the least of them, so that members share edges
    leasts = keyed.join(buckets, "key").groupBy("node").agg(F.array_sort(F.collect_set("least")).alias("leasts"))
    hub = F.col("leasts")[0]
    edges = leasts.select(F.explode(F.array_union(F.array("node"), "leasts")).alias("a"), hub.alias("b")).where("a <> b").distinct()
    return connected_components(edges)


def near_links(docs: DataFrame, representatives: DataFrame, least: float = LEAST, block: int = BLOCK, common: int = COMMON) -> DataFrame:
    """(a, b) links that connect each class of `representatives` (node, doc_id, tie, bands) and no others."""
    clusters = materialise(candidate_clusters(representatives), "clusters")
    sizes = clusters.groupBy(F.col("root").alias("cluster")).agg(F.count("*").alias("members"))
    placed = (
        clusters.join(sizes, F.col("root") == F.col("cluster"))
        .join(representatives.select("node", F.col("doc_id").alias("id"), F.col("tie").alias("t")), "node")
        .withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
        .select("node", "id", "t", "cluster", "blocks")
    )
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    # rows that share id and text are one document here
    found = source.join(placed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t")))
    texts = materialise(found.select("node", "text", "cluster", "blocks"), "cluster-texts")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # members with the least hashes, about `common` of them, go to every block of their cluster
    cut = F.pmod(F.xxhash64(F.lit("common"), "node"), F.lit(1 << 20))
    everywhere = (F.col("blocks") > 1) & (cut < F.lit(common * (1 << 20)) / (F.col("blocks") * block))
    spread = texts.withColumn("slice", F.when(everywhere, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))
    groups = spread.select("node", "text", "cluster", F.explode("slice").alias("part")).groupBy("cluster", "part")
    links = materialise(groups.applyInArrow(_close(least), "a long, b long").where("a <> b").distinct(), "near-links")
    large = texts.where("blocks > 1").select("node", "cluster", "blocks")
    if large.isEmpty():
        return links
    return links.unionByName(_links_across(texts.where("blocks > 1"), links, least, block))


def _links_across(texts: DataFrame, links: DataFrame, least: float, block: int) -> DataFrame:
    """Links between different classes of the same large cluster: who is not in its largest class meets every block."""
    inside = links.join(texts.select(F.col("node").alias("a")).distinct(), "a", "left_semi")
    roots = connected_components(inside)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    known = materialise(
        texts.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "text", "cluster", "blocks", own.alias("part")),
        "large-clusters",
    )
    ranks = known.groupBy("cluster", "root").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks"))
    totals = ranks.groupBy("cluster").agg(
        F.max(F.struct("n", "root"))["root"].alias("main"), (F.sum("n") - F.max("n")).alias("probes"), F.max("blocks").alias("blocks")
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    # a row per block, so that the members of a large cluster meet their totals in many tasks
    totals = totals.where("probes > 0").select("cluster", "main", "probes", every(F.col("blocks")).alias("part"))
    turns = F.ceil(F.col("probes") / block)
    members = known.join(totals, ["cluster", "part"])
    side = (
        members.where("root <> main")
        .withColumn("turn", F.pmod(F.xxhash64(F.lit("turn"), "node"), turns).cast("int"))
        .withColumn("part", every(F.col("blocks")))
        .withColumn("probe", F.lit(True))
    )
    met = members.withColumn("turn", every(turns)).withColumn("probe", F.lit(False))
    columns = ["node", "root", "text", "cluster", "part", "turn", "probe"]
    meet = side.select(*columns).unionByName(met.select(*columns))
    return materialise(meet.groupBy("cluster", "part", "turn").applyInArrow(_reach(least), "a long, b long").distinct(), "far-links")


def near_classes(
    docs: DataFrame,
    least: float = LEAST,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
    common: int = COMMON,
) -> DataFrame:
    """One row per document: doc_id, tie, class_id, class_size, kept."""
    signed = materialise(signatures_of(docs, bands, rows), "signatures")
    worded = signed.where(F.col("digest").isNotNull())
    chosen = worded.groupBy("digest").agg(F.min("row").alias("node"))
    representatives = materialise(
        worded.join(chosen.select("node"), F.col("row") == F.col("node")).select("node", "doc_id", "tie", "bands"), "representatives"
    )
    links = near_links(docs, representatives, least, block, common)
    roots = connected_components(links)
    named = chosen.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("class"))
    rows_named = signed.join(named, "digest", "left").select("doc_id", "tie", "row", F.coalesce("class", "row").alias("class"))
    members = materialise(rows_named, "class-members")
    totals = members.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"), F.count("*").alias("class_size"))
    return members.join(totals, "class").select(
        "doc_id",
        "tie",
        F.col("least.doc_id").alias("class_id"),
        "class_size",
        (F.col("row") == F.col("least.row")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """The documents that stay, one of each class, with all their columns."""
    classes = near_classes(docs, **settings)
    dropped = classes.groupBy(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie")).agg(F.max("kept").alias("stays")).where(~F.col("stays"))
    mark = free_name(docs, "text_tie")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col(mark) == F.col("gone_tie"))
    return docs.withColumn(mark, F.xxhash64("text")).join(dropped, same, "left_anti").select(*docs.columns)
