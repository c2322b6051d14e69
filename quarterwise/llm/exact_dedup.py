"""Exact deduplication with frequent texts settled apart from the rest.

A Misra-Gries style summary of the digests (Spark's `approx_top_k`, a frequent-items
sketch) names texts that may be frequent. An exact count over all rows verifies them and
finds the row that stays. These few winners are broadcast, so that copies of frequent texts
are settled where they are read; only the other digests are shuffled.

Defined results: a NULL text counts as empty, and empty texts are equal to each other.
Of equal texts the row with the largest doc_id stays; NULL ids come last, and of rows that
share both id and text exactly one stays. An empty table gives an empty result. Other
columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterwise.llm.frames import free_name
from quarterwise.session import materialise

#: Winners that are broadcast at most, and digests the summary follows.
FREQUENT, TRACKED = 512, 8192


def digest(text: Column, normalise: Callable[[Column], Column] | None = None) -> Column:
    """SHA-256 of the normalised text in UTF-8, lowercase hex; NULL is empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.sha2(normalise(whole) if normalise else whole, 256)


def frequent_winners(digests: DataFrame, frequent: int = FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """(digest, keep, group_size) of at most `frequent` digests, counted exactly over all rows.

    `digests` holds digest, doc_id and row, a number that is different in every row.
    """
    top = digests.agg(F.expr(f"approx_top_k(digest, {frequent}, {tracked})").alias("top"))
    named = top.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("digest"))
    return (
        digests.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    )


def exact_groups(
    docs: DataFrame,
    normalise: Callable[[Column], Column] | None = None,
    frequent: int = FREQUENT,
    tracked: int = TRACKED,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = materialise(
        docs.select("doc_id", digest(F.col("text"), normalise).alias("digest")).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    winners = materialise(frequent_winners(digests, frequent, tracked), "winners")
    copies = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(winners), "digest", "left_anti").select(
        "digest",
        "doc_id",
        "row",
        F.max(F.struct("doc_id", "row")).over(group).alias("keep"),
        F.count("*").over(group).alias("group_size"),
    )
    return copies.unionByName(rest).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(
    docs: DataFrame,
    normalise: Callable[[Column], Column] | None = None,
    frequent: int = FREQUENT,
    tracked: int = TRACKED,
) -> DataFrame:
    """The documents that stay, with all their columns.

    Copies of frequent texts go before the exchange; each remaining group is ranked in one
    task, and is no larger than the summary's threshold for frequent digests.
    """
    mark, rank = free_name(docs, "text_digest"), free_name(docs, "copy_rank")
    marked = docs.withColumn(mark, digest(F.col("text"), normalise))
    digests = marked.select(F.col(mark).alias("digest"), "doc_id", F.lit(0).alias("row"))
    winners = materialise(frequent_winners(digests, frequent, tracked), "winners")
    won = winners.select(F.col("digest").alias(mark), F.struct(F.col("keep.doc_id").alias("id")).alias(free_name(docs, "won")))
    won_name = won.columns[1]
    left = marked.join(F.broadcast(won), mark, "left").where(
        F.col(won_name).isNull() | F.col(won_name)["id"].eqNullSafe(F.col("doc_id"))
    )
    order = Window.partitionBy(mark).orderBy(F.col("doc_id").desc_nulls_last())
    return left.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns)
