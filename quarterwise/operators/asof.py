"""As-of join: each row with the last row of another table at or before its own time.

Both tables go into one global order by (key, time), which is cut into ranges; a range holds part of one key or many
keys, so a key with most of the rows is spread like any other. Within a range the last row
seen is carried forward; the last row of each (range, key) is carried on to the ranges after it.

  left + right --exchange by range of (key, time), sort--> stored with range and place
    |                                       |
    |                                       +-> last right row per (range, key) -> window over ranges
    +-- window over (range, key): last right row before --left join on (range, key)--^
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterwise.session import materialise

_TIME, _SIDE, _TIE, _LEFT, _RIGHT, _POS, _RANGE = (f"__{x}" for x in ("time", "side", "tie", "left", "right", "pos", "range"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    take: Mapping[str, str],
    strict: bool = True,
    keep_unmatched: bool = True,
    order: Sequence[str] = (),
) -> DataFrame:
    """The rows of `left` with columns of the last row of `right` that has the same `by` and an earlier time.

    `take` names the new columns and the columns of `right` they come from. With `strict` the row of `right` has to be
    earlier, otherwise it may be of the same time. Of rows of `right` that share key and time the last by `order` counts,
    then the one with the larger hash of the taken values. A NULL key or time matches nothing. Rows without a match stay with NULLs,
    unless `keep_unmatched` is false. Every row of `left` gives at most one row; equal rows give equal rows.
    """
    clash = [c for c in take if c in left.columns]
    if clash:
        raise ValueError(f"columns of both tables: {clash}")
    keys = [f"__k{i}" for i in range(len(by))]
    named = lambda df, time: [*[F.col(c).alias(k) for k, c in zip(keys, by)], F.col(time).alias(_TIME)]
    taken = F.struct(*[F.col(c).alias(name) for name, c in take.items()])
    sort = F.struct(*[F.col(c) for c in order], F.xxhash64(*take.values()))
    blank = lambda df, e: F.lit(None).cast(df.select(e.alias("x")).schema["x"].dataType)
    row = F.struct(*left.columns)
    # at one time, a left row comes first if only earlier rows count, else last
    rows = left.select(*named(left, left_time), F.lit(0 if strict else 2).alias(_SIDE), blank(right, sort).alias(_TIE), row.alias(_LEFT), blank(right, taken).alias(_RIGHT))
    dated = right.where(F.col(right_time).isNotNull())
    for c in by:
        dated = dated.where(F.col(c).isNotNull())
    others = dated.select(*named(right, right_time), F.lit(1).alias(_SIDE), sort.alias(_TIE), blank(left, row).alias(_LEFT), taken.alias(_RIGHT))
    place = [*keys, _TIME, _SIDE, _TIE]
    placed = materialise(
        rows.unionByName(others).repartitionByRange(*place).sortWithinPartitions(*place).withColumn(_POS, F.monotonically_increasing_id()),
        "asof-order",
    ).withColumn(_RANGE, F.shiftright(_POS, 33))
    before = Window.partitionBy(_RANGE, *keys).orderBy(_POS).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("__near", F.last(_RIGHT, ignorenulls=True).over(before)).where(F.col(_SIDE) != 1)
    ends = placed.where(F.col(_SIDE) == 1).groupBy(_RANGE, *keys).agg(F.max_by(_RIGHT, _POS).alias("__end"))
    # one row per range and key; a range with left rows only needs one as well
    spans = placed.groupBy(_RANGE, *keys).agg(F.lit(1).alias("__one")).drop("__one")
    listed = spans.join(ends, _same(spans, ends, keys), "left").select(spans[_RANGE], *[spans[k] for k in keys], "__end")
    along = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = listed.withColumn("__far", F.last("__end", ignorenulls=True).over(along)).where(F.col("__far").isNotNull())
    joined = near.join(carried, _same(near, carried, keys), "left").withColumn("__got", F.coalesce("__near", "__far"))
    if not keep_unmatched:
        joined = joined.where(F.col("__got").isNotNull())
    return joined.select(*[F.col(_LEFT)[c].alias(c) for c in left.columns], *[F.col("__got")[name].alias(name) for name in take])


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Same range and key; rows with a NULL key match nothing, so plain equality does."""
    cond = a[_RANGE] == b[_RANGE]
    for k in keys:
        cond = cond & (a[k] == b[k])
    return cond
