"""Mixing of sources to target weights, with block quotas split among output shards.

Documents fall into hash blocks per source. A source's target number of words becomes whole
passes over all its blocks plus one partial pass: blocks are drawn in a permuted order until
the next would go beyond the target; that block is cut into finer blocks in the same way, and
the last fine block into documents. The drawn blocks, repeats included, are then dealt to
output shards by a splitting tree: at each node the blocks are ranked by a hash and an exact
share goes to the left half of the shards, so that the quotas of the sources on either side are
a multivariate hypergeometric draw. Documents get their block's shard and are shuffled
within it. Everything follows from hashes of doc_id, so reruns agree.

Defined results: a NULL or blank text has size 0 and takes nothing. NULL is a source of its own,
ordered last. Rows that share a doc_id share a block; equal rows are taken equally often and reported each by its own words. An empty table gives an empty mix. Other
columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterwise.llm.frames import free_name, stored
from quarterwise.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Blocks of a source, and fine blocks of the block that is cut.
BLOCKS = 256
SHARDS = 32
#: Parts in which `dealt_mix` writes a mix, one after another.
GROUPS = 4
SEED = 17


def word_count(text: Column) -> Column:
    """Number of runs of code points other than blank and the ASCII controls 9 to 13; NULL has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to the same with sid, weight and target.

    The target is the lesser of `most` sizes and a common level times the weight; the level is
    where the targets add up to `share` of all sizes. Sources are taken in the order in which
    they reach their limit, so one running sum over the sources finds the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("sid", F.row_number().over(order) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1))
    whole = Window.partitionBy()
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(most))
    leveled = weighed.withColumns(
        {
            "wanted": F.sum("source_size").over(whole) * F.lit(float(share)),
            "full": F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
            "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("level", (F.col("wanted") - F.col("full")) / F.col("open"))
    # levels rise until the first source that stays below its limit, and not after it
    below = F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))
    leveled = leveled.withColumn("found", F.max(below).over(whole))
    return leveled.select(
        "source",
        "source_size",
        "sid",
        "weight",
        F.least(cap, F.coalesce(F.col("found") * F.col("weight"), cap)).alias("target"),
    )


def _block(level: int, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(f"{seed}:{level}"), F.col("doc_id")), F.lit(blocks)).cast("int")


def _cut(rows: DataFrame, block: Column, order: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (sid, size, room, ...) to (sid, block) drawn whole, and (sid, block, room) of the one that is cut."""
    sums = rows.groupBy("sid", block.alias("block")).agg(F.sum("size").alias("words"), F.max("room").alias("room"))
    to_here = Window.partitionBy("sid").orderBy(order, "block")
    run = sums.withColumn("upto", F.sum("words").over(to_here))
    drawn = run.where(F.col("upto") <= F.col("room")).select("sid", "block")
    cut = run.where((F.col("upto") > F.col("room")) & (F.col("upto") - F.col("words") < F.col("room")))
    return drawn, cut.select("sid", "block", (F.col("room") - F.col("upto") + F.col("words")).alias("room"))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    blocks: int = BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """Per document: doc_id, size, tie, source, sid, block, source_size, target, passes (times it is taken)."""
    sized = materialise(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sized"
    )
    sources = materialise(
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("room", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "of"),
        "mix-sources",
    )
    rows = sized.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("block", _block(0, blocks, seed))
    mixed = lambda k: F.xxhash64(F.lit(f"{seed}:order{k}"), F.col("sid"), F.col("block"))
    live = rows.where((F.col("room") > 0) & (F.col("size") > 0))
    drawn, cut = (materialise(x, "mix-blocks") for x in _cut(live, F.col("block"), mixed(0)))
    # the cut block of each source falls into fine blocks, and the one cut there into documents
    fine = live.drop("room").join(cut, ["sid", "block"]).withColumn("block", _block(1, blocks, seed))
    drawn_fine, cut_fine = (materialise(x, "mix-fine") for x in _cut(fine, F.col("block"), mixed(1)))
    fine_of = lambda x, *more: x.select("sid", F.col("block").alias("fine"), *more)
    marked = (
        rows.drop("room")
        .withColumn("fine", _block(1, blocks, seed))
        .join(drawn.withColumn("drawn", F.lit(True)), ["sid", "block"], "left")
        .join(cut.select("sid", "block", F.lit(True).alias("is_cut")), ["sid", "block"], "left")
        .join(fine_of(drawn_fine, F.lit(True).alias("drawn_fine")), ["sid", "fine"], "left")
        .join(fine_of(cut_fine, "room"), ["sid", "fine"], "left")
    )
    single = F.col("is_cut").isNotNull() & F.col("room").isNotNull() & (F.col("size") > 0)
    in_pass = F.col("drawn").isNotNull() | (F.col("is_cut").isNotNull() & F.col("drawn_fine").isNotNull())
    # equal rows come in one step, so that they are taken alike
    one_by_one = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(f"{seed}:last"), F.col("doc_id")), "doc_id", "size", "tie")
    alike = Window.partitionBy("sid", "doc_id", "size", "tie")
    settled = marked.where(~single).withColumn("extra", F.when(in_pass & (F.col("size") > 0), 1).otherwise(0))
    # the document that crosses the target is taken if that ends nearer to it
    nearer = F.sum("size").over(one_by_one) - F.sum("size").over(alike) / 2 <= F.col("room")
    singles = marked.where(single).withColumn("extra", F.when(nearer, 1).otherwise(0))
    return (
        settled.unionByName(singles)
        .withColumn("passes", F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("int"))
        .select("doc_id", "size", "tie", "source", "sid", "block", "source_size", "target", "passes")
    )


def split_units(units: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(sid, block, pass) with the output shard of each unit.

    A node of the tree stands for a range of shards. Its units are ranked by a hash, and the
    share of the left half, rounded, goes there. The number of units is bounded by sources
    times blocks times passes, whatever the number of documents.
    """
    tree = units.withColumns({"lo": F.lit(0), "hi": F.lit(shards)})
    for level in range(max(0, shards - 1).bit_length()):
        node = Window.partitionBy("lo", "hi")
        dealt = node.orderBy(F.xxhash64(F.lit(f"{seed}:tree{level}"), "sid", "block", "pass"), "sid", "block", "pass")
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        left = F.round(F.col("n") * (middle - F.col("lo")) / (F.col("hi") - F.col("lo")))
        goes_left = F.col("rank") <= left
        leaf = F.col("hi") - F.col("lo") <= 1
        tree = tree.withColumns({"n": F.count("*").over(node), "rank": F.row_number().over(dealt)}).select(
            *units.columns,
            F.when(leaf | goes_left, F.col("lo")).otherwise(middle).alias("lo"),
            F.when(leaf | ~goes_left, F.col("hi")).otherwise(middle).alias("hi"),
        )
    return tree.select(*units.columns, F.col("lo").alias("shard"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    blocks: int = BLOCKS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: documents, repeated as often as they are taken, with `shard` and `copy`.

    A shard is dealt over several partitions by a hash of document and copy, so many that the session's number of
    shuffle partitions is used, and shuffled within each by another hash. So no task holds a whole shard
    when there are fewer shards than partitions.
    """
    plan = materialise(plan_mix(docs, weights, share, most, blocks, seed), "mix-plan")
    return _dealt(docs, plan, _units(plan, shards, seed), shards, seed)


def _units(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """The drawn units of a plan with their shards."""
    copies = plan.where("passes > 0").select("sid", "block", F.explode(F.sequence(F.lit(1), "passes")).alias("pass"))
    return materialise(split_units(copies.distinct(), shards, seed), "mix-units")


def _dealt(docs: DataFrame, plan: DataFrame, units: DataFrame, shards: int, seed: int) -> DataFrame:
    """Documents of a plan as often as they are taken, each copy in its unit's shard."""
    size, tie, passes = (free_name(docs, x) for x in ("mix_size", "mix_tie", "mix_passes"))
    taken = (
        plan.where("passes > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(1), "passes")))
        .join(units, ["sid", "block", "pass"])
        .groupBy("doc_id", F.col("size").alias(size), F.col("tie").alias(tie), F.col("source").alias("mix_source"))
        .agg(F.sort_array(F.collect_set(F.struct(F.col("pass").alias("copy"), "shard"))).alias(passes))
    )
    keyed = docs.withColumns({size: word_count(F.col("text")), tie: F.xxhash64("text")}).alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", size, tie)]
    joined = keyed.join(taken.alias("t"), [*same, F.col("d.source").eqNullSafe(F.col("t.mix_source"))])
    shard, copy = free_name(docs, "shard"), free_name(docs, "copy")
    out = joined.select(*[F.col(f"d.{c}").alias(c) for c in docs.columns], F.explode(f"t.{passes}").alias("unit")).select(
        *docs.columns, F.col("unit.shard").alias(shard), F.col("unit.copy").alias(copy)
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards + 1
    part = F.pmod(F.xxhash64(F.lit(f"{seed}:part"), F.col("doc_id"), F.col(copy)), F.lit(parts))
    order = F.xxhash64(F.lit(f"{seed}:row"), F.col("doc_id"), F.col(copy))
    return out.repartition(F.col(shard), part).sortWithinPartitions(shard, order)


def dealt_mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    blocks: int = BLOCKS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """Per document what the mix holds of it: doc_id, size, source_size, target, taken (words), passes, shards (by copy).

    The mix is dealt, shuffled and written, texts and all, and `taken` and `shards` are read from what was written.
    It is written in `GROUPS` parts by a hash of the document, so that only one part's texts are in an exchange at a time.
    """
    plan = materialise(plan_mix(docs, weights, share, most, blocks, seed), "mix-plan")
    units = _units(plan, shards, seed)
    group = F.pmod(F.xxhash64(F.lit(f"{seed}:group"), F.col("doc_id")), F.lit(GROUPS))
    rows = docs.select("doc_id", "text", "source")
    parts = [stored(_dealt(rows.where(group == g), plan.where(group == g), units, shards, seed), "mix") for g in range(GROUPS)]
    written = reduce(DataFrame.unionByName, parts)
    found = (
        written.groupBy("doc_id", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), "source")
        .agg(F.count("*").alias("rows"), F.sort_array(F.collect_set(F.struct("copy", "shard"))).alias("dealt"))
        # equal rows are dealt alike: what is written of them together is divided among them
        .withColumn("taken", (F.col("rows") * F.col("size") / (F.col("rows") / F.size("dealt"))).cast("long"))
    )
    same = reduce(lambda x, y: x & y, [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("doc_id", "size", "tie", "source")])
    joined = plan.alias("p").join(found.alias("f"), same, "left")
    return joined.select(
        "p.doc_id",
        "p.size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "passes",
        F.coalesce("dealt.shard", F.array().cast("array<int>")).alias("shards"),
    )
