"""Train and validation splits without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quarterwise.session import materialise
from quarterwise.spec import PanelSpec

_ROW = "__row"


def numbered(df: DataFrame) -> DataFrame:
    """The rows stored with a number that tells even equal rows apart."""
    return materialise(df.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")


def key_at_position(df: DataFrame, order: Sequence[str], position: int) -> Row | None:
    """The order key of the row at `position` (from 1) when sorted by `order`; None if there is no such row.

    An action over the order columns alone, which must tell rows apart. They are range-partitioned,
    sorted and stored with their place in their range; one count per range then tells the range and the
    place of the row. Since no two keys are equal, Spark can cut any range, however many rows share
    their leading columns, and no task ranks more than its own range.
    """
    placed = materialise(
        df.select(*order)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        # range number in the upper bits, place inside the range in the lower 33
        .withColumn("__id", F.monotonically_increasing_id()),
        "positions",
    )
    ranges = placed.groupBy(F.shiftright("__id", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # one row per range, that is per shuffle partition
    upto = F.sum("n").over(Window.orderBy("part"))
    found = ranges.withColumn("upto", upto).where((F.col("upto") - F.col("n") < position) & (F.col("upto") >= position)).first()
    if found is None:
        return None
    inside = position - (found.upto - found.n) - 1
    return placed.where(F.col("__id") == (found.part << 33) + inside).drop("__id").first()


def _literal(df: DataFrame, order: Sequence[str], key: Row) -> Column:
    return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, key)])


def chronological_split(df: DataFrame, frac: float = 0.8, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Label the first int(n * frac) rows by (time, entity) "train", the rest "val".

    The rows are stored with a number, so that ties, even between equal rows, are cut at
    exactly that many. Counts per date, an action, tell the date at which the cut falls; among that
    date's rows the one at the cut is found. Labels then need no exchange. Undated rows sort last.
    """
    df = numbered(df)
    day = F.col(spec.time).cast("date")
    # bounded by the calendar: a few hundred dates a year, whatever the number of rows
    per_day = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy(F.col("day").asc_nulls_last()))
    placed = per_day.select("day", "n", running.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    k = (F.col("total") * F.lit(frac)).cast("bigint")
    cut = placed.withColumn("k", k).where((F.col("upto") - F.col("n") < F.col("k")) & (F.col("k") <= F.col("upto"))).first()
    if cut is None:  # int(n * frac) is 0
        return df.drop(_ROW).withColumn("split", F.lit("val"))
    on_day = day.isNull() if cut.day is None else day == F.lit(cut.day)
    before = day.isNotNull() if cut.day is None else day < F.lit(cut.day)
    order = [spec.time, spec.entity, "__tie", _ROW]
    tied = df.withColumn("__tie", spec.tie(df))
    key = key_at_position(tied.where(on_day), order, cut.k - cut.upto + cut.n)
    first = before | (on_day & (F.struct(*order) <= _literal(tied, order, key)))
    return tied.withColumn("split", F.when(first, "train").otherwise("val")).drop("__tie", _ROW)


def head_split(df: DataFrame, order: Sequence[str], fraction: float = 0.2) -> DataFrame:
    """Label the first max(1, int(n * fraction)) rows by `order` "val", the rest "train".

    Rows that tie are told apart by a stored number. Finding the cut is an action; labels need no exchange.
    """
    df, order = numbered(df), [*order, _ROW]
    n = df.agg(F.greatest(F.lit(1), (F.count(F.lit(1)) * F.lit(fraction)).cast("bigint"))).first()[0]
    key = key_at_position(df, order, n)
    if key is None:  # no rows
        return df.drop(_ROW).withColumn("split", F.lit("train"))
    return df.withColumn("split", F.when(F.struct(*order) <= _literal(df, order, key), "val").otherwise("train")).drop(_ROW)


def hash_split(df: DataFrame, keys: Sequence[str], fraction: float = 0.2) -> DataFrame:
    """Label about `fraction` of the rows "val" by a hash of their key: stable under any partitioning.

    A missing part of a key counts as a mark of its own, so that it matters which part is missing.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in keys]
    share = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("split", F.when(share < F.lit(int(fraction * 2**32)), "val").otherwise("train"))
