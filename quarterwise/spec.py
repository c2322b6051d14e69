"""Parameters that describe a panel table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The column names a panel of company fundamentals uses.
ENTITY = "Company"
TIME = "Date"
KPI = "Revenues"
EXOG = ("OperatingExpenses", "GrossProfit", "Assets", "StockholdersEquity")
LAG_FEATURES = ("lag_1", "lag_2", "diff_1", "growth_1", "mean_2")
MODEL_FEATURES = (*LAG_FEATURES, "month", "year", *EXOG)

#: Column with the place of a stored row in its order, and the slice unit that goes by it.
POSITION, POSITION_UNIT = "__position", "position"


@dataclass(frozen=True)
class PanelSpec:
    """One row per (entity, time); `kpi` is forecast, `exog` are carried along.

    A panel with one row per entity and quarter has histories that the calendar bounds, and
    they stay whole: one exchange. For tables with long histories the caller declares
    `slice_unit`, the calendar unit that cuts a history into slices, so that it is spread over
    many tasks at the cost of a second pass. `tie_slices` above 1 also cuts the rows of one
    (entity, time) by a hash; use it for tables that break the one-row-per-key rule with
    very many rows on one date. Rows that are equal in KPI and exogenous columns too share
    their hash and are not cut further. `slice_unit` "position" cuts by the place in a stored
    order instead, at the cost of storing the rows twice: slices are of like size whatever the
    dates and however many rows are equal.
    """

    entity: str = ENTITY
    time: str = TIME
    kpi: str = KPI
    exog: tuple[str, ...] = EXOG
    min_points: int = 3
    horizon: int = 1
    slice_unit: str = "none"
    tie_slices: int = 1

    @property
    def keys(self) -> list[str]:
        return [self.entity]

    def tie(self, df: DataFrame) -> Column:
        """A fixed order for rows that share entity and time."""
        present = [c for c in (self.kpi, *self.exog) if c in df.columns]
        return F.xxhash64(*present)

    def slice_expr(self, df: DataFrame) -> Column | None:
        """Slice number, growing with (time, tie); undated rows come last. None if histories stay whole.

        Undated rows of an entity have no defined order, so they are cut by hash
        alone and never pile up in a single slice.
        """
        if self.slice_unit == "none" and self.tie_slices <= 1:
            return None
        if self.slice_unit == POSITION_UNIT:
            return F.shiftright(F.col(POSITION), 33)  # the range; see neighbours.in_slices
        bits = F.shiftright(self.tie(df), 58)  # -32..31, in the order of the hash
        t = F.col(self.time)
        if self.tie_slices > 1:
            step = max(1, 64 // self.tie_slices)
            part = F.floor(bits / F.lit(step))
            dated = F.datediff(t, F.lit("1970-01-01").cast("date")).cast("bigint") * 64 + part
        else:
            dated = _unit_number(t, self.slice_unit)
        return F.coalesce(dated, F.lit(1 << 40).cast("bigint") + bits)


def _unit_number(t: Column, unit: str) -> Column:
    months = F.year(t).cast("bigint") * 12 + F.month(t) - 1
    if unit == "year":
        return F.year(t).cast("bigint")
    if unit == "quarter":
        return F.floor(months / 3)
    if unit == "month":
        return months
    if unit == "day":
        return F.datediff(t, F.lit("1970-01-01").cast("date")).cast("bigint")
    raise ValueError(f"unknown slice unit: {unit}")
