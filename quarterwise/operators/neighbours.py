"""Values from earlier and later rows of the same entity, safe for long histories.

A plain window over the entity puts a whole history into one task, which fails to
scale when one entity holds a large share of the table. If the caller declares slices, the
window runs over (entity, slice), and only the few rows next to a slice border travel between slices:

  rows --exchange(entity, slice)--> window: neighbours inside the slice
   |                                   |
   +-- border rows, a few per slice    +-- left join on (entity, slice), already
       -> window over the entity           partitioned that way
       -> border values of nearby slices --^

Every slice has at least one row, so the k slices before it always hold the k rows
before its first row. The result equals the plain window, row for row.

Sliced, the input is read twice, the second time for the key, order and value columns only;
store it first if it is costly to compute (`in_slices` does where slices go by position). Without slices it is one exchange and one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterwise.session import materialise
from quarterwise.spec import POSITION, POSITION_UNIT, PanelSpec

_SLICE = "__slice"
_RN = "__rn"
_AFTER = "__after"


def in_slices(df: DataFrame, spec: PanelSpec) -> tuple[DataFrame, list[str | Column], Column | None]:
    """What `with_neighbours` takes: rows, their order within an entity, and the slices the spec declares.

    By position, the rows are stored in the order of (entity, time, tie, number), cut into ranges by
    Spark's sample of them. Each row has a number of its own, so that even rows equal in every column are cut. The
    rows are stored before the sample is taken: a lost task then finds the same numbers again.
    """
    if spec.slice_unit != POSITION_UNIT:
        return df, [spec.time, spec.tie(df)], spec.slice_expr(df)
    told_apart = materialise(df.withColumn(POSITION, F.monotonically_increasing_id()), "numbered")
    order = [*[F.col(k) for k in spec.keys], F.col(spec.time).asc_nulls_last(), spec.tie(df), F.col(POSITION)]
    ranges = told_apart.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialise(ranges.withColumn(POSITION, F.monotonically_increasing_id()), "positions")
    return stored, [POSITION], spec.slice_expr(stored)


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    slice_by: Column | None,
    wanted: Mapping[str, tuple[str | Column, int]],
) -> DataFrame:
    """Add columns holding a value from `offset` rows away (negative: earlier).

    wanted maps a new column name to (column, offset). `slice_by` must never decrease
    along `order` within a key and must not be NULL; None leaves histories whole, for
    tables whose longest history is known to be short. Rows with a NULL key are dropped,
    as a group-by on the key would drop them. Where there is no such row the new
    column is NULL.
    """
    back = max([-o for _, o in wanted.values() if o < 0], default=0)
    ahead = max([o for _, o in wanted.values() if o > 0], default=0)
    order_cols = {f"__o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    # a struct around each value tells "no such row" from "that row holds NULL";
    # columns named by text are carried once, however many offsets are asked for
    field_of = {name: f"__v_{col if isinstance(col, str) else name}" for name, (col, _) in wanted.items()}
    values = {field_of[name]: _wrap(col) for name, (col, _) in wanted.items()}

    present = df.where(_all_not_null(keys))
    if slice_by is None:
        whole = Window.partitionBy(*keys).orderBy(*[c.asc_nulls_last() for c in order_cols.values()])
        return present.withColumns(
            {name: (F.lag(col, -o) if o < 0 else F.lead(col, o)).over(whole) for name, (col, o) in wanted.items()}
        )
    sliced = present.withColumns({_SLICE: slice_by, **order_cols, **values})
    group = [*keys, _SLICE]
    ascending = [F.col(c).asc_nulls_last() for c in order_cols]
    in_slice = Window.partitionBy(*group).orderBy(*ascending)

    positioned = sliced.withColumn(_RN, F.row_number().over(in_slice))
    if ahead:
        positioned = positioned.withColumn(_AFTER, _rows_after(in_slice, ahead - 1))
    local = {
        f"__l_{name}": (F.lag(field_of[name], -o) if o < 0 else F.lead(field_of[name], o)).over(in_slice)
        for name, (_, o) in wanted.items()
    }
    borders = _slice_borders(sliced.select(*group, *order_cols, *values), keys, order_cols, values, back, ahead)
    joined = positioned.withColumns(local).join(borders, group, "left")

    out = {}
    for name, (_, o) in wanted.items():
        field = field_of[name]
        if o < 0:
            k = -o
            far = F.try_element_at("__prev", F.least(F.col(_RN) - F.lit(k + 1), F.lit(-1)).cast("int"))
            out[name] = F.when(F.col(_RN) > k, F.col(f"__l_{name}")["x"]).otherwise(far[field]["x"])
        else:
            far = F.try_element_at("__next", F.greatest(F.lit(o) - F.col(_AFTER), F.lit(1)))
            out[name] = F.when(F.col(f"__l_{name}").isNotNull(), F.col(f"__l_{name}")["x"]).otherwise(far[field]["x"])
    return joined.select(*[F.col(c) for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def _slice_borders(narrow, keys, order_cols, values, back, ahead):
    """Per (key, slice): the last `back` rows before it and the first `ahead` after it."""
    group = [*keys, _SLICE]
    asc = [F.col(c).asc_nulls_last() for c in order_cols]
    desc = [F.col(c).desc_nulls_first() for c in order_cols]
    fields = list(values)
    aggs = {}
    if back and ahead:
        w = Window.partitionBy(*group).orderBy(*asc)
        edge = narrow.withColumns({"__up": F.row_number().over(w), "__down": _rows_after(w, back) + 1})
        edge = edge.where((F.col("__up") <= ahead) | (F.col("__down") <= back))
    elif back:  # a lone rank limit is applied before the exchange as well
        edge = narrow.withColumn("__down", F.row_number().over(Window.partitionBy(*group).orderBy(*desc)))
        edge = edge.where(F.col("__down") <= back)
    else:
        edge = narrow.withColumn("__up", F.row_number().over(Window.partitionBy(*group).orderBy(*asc)))
        edge = edge.where(F.col("__up") <= ahead)
    if back:
        item = F.when(F.col("__down") <= back, F.struct((-F.col("__down")).alias("p"), *fields))
        aggs["__tail"] = F.sort_array(F.collect_list(item))
    if ahead:
        item = F.when(F.col("__up") <= ahead, F.struct(F.col("__up").alias("p"), *fields))
        aggs["__head"] = F.sort_array(F.collect_list(item))
    summary = edge.groupBy(*group).agg(*[c.alias(n) for n, c in aggs.items()])

    along = Window.partitionBy(*keys).orderBy(_SLICE)
    cols = {}
    if back:
        none = F.slice("__tail", 1, 0)
        cols["__prev"] = F.concat(*[F.coalesce(F.lag("__tail", j).over(along), none) for j in range(back, 0, -1)])
    if ahead:
        none = F.slice("__head", 1, 0)
        cols["__next"] = F.concat(*[F.coalesce(F.lead("__head", j).over(along), none) for j in range(1, ahead + 1)])
    return summary.withColumns(cols).select(*group, *cols)


def _rows_after(window, limit: int) -> Column:
    """How many rows follow within the window's partition, counted up to `limit`."""
    steps = [F.when(F.lead(F.lit(True), j).over(window), 1).otherwise(0) for j in range(1, limit + 1)]
    return sum(steps, F.lit(0))


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, rank: str) -> DataFrame:
    """The last `n` rows per key, newest ranked 1.

    Spark applies the rank limit before the exchange too, so a key sends at most `n`
    rows per input task however many rows it has.
    """
    desc = [(F.col(c) if isinstance(c, str) else c).desc_nulls_first() for c in order]
    ranked = df.where(_all_not_null(keys)).withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*desc)))
    return ranked.where(F.col(rank) <= n)


def _all_not_null(keys):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def _wrap(col):
    return F.struct((F.col(col) if isinstance(col, str) else col).alias("x"))
