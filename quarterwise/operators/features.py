"""Lag, growth and next-period features per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterwise.functions.numbers import growth
from quarterwise.operators.neighbours import in_slices, latest_rows, with_neighbours
from quarterwise.spec import LAG_FEATURES, POSITION, PanelSpec

# The calendar columns of a supervised table, in this order.
SUPERVISED_CALENDAR = ("year", "quarter", "month")


def add_calendar(df: DataFrame, spec: PanelSpec = PanelSpec(), quarter: bool = True) -> DataFrame:
    t = F.col(spec.time)
    cols = {"month": F.month(t), "year": F.year(t)}
    if quarter:
        cols["quarter"] = F.quarter(t)
    return df.withColumns(cols)


def _lags(df, spec, extra=None):
    wanted = {"lag_1": (spec.kpi, -1), "lag_2": (spec.kpi, -2), **(extra or {})}
    rows, order, slices = in_slices(df, spec)
    return with_neighbours(rows, spec.keys, order, slices, wanted).drop(POSITION)


def _rates(kpi: Column) -> dict[str, Column]:
    # mean_2 is an expression, not a frame average: it is NULL if either value is
    return {
        "diff_1": kpi - F.col("lag_1"),
        "growth_1": growth(kpi, F.col("lag_1")),
        "mean_2": (kpi + F.col("lag_1")) / F.lit(2),
    }


def timeseries_features(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Features for every row; rows without a KPI stay, so lags may be NULL."""
    out = _lags(df, spec).withColumns(_rates(F.col(spec.kpi)))
    return add_baselines(add_calendar(out, spec, quarter=False))


def last_row_features(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Features of each entity's newest row with a KPI, for entities with enough such rows.

    Only the newest max(3, min_points) rows per entity are shuffled; lags and the
    min-rows gate are read off them.
    """
    filled = df.where(F.col(spec.kpi).isNotNull())
    keep = max(3, spec.min_points)
    recent = latest_rows(filled, spec.keys, [spec.time, spec.tie(df)], keep, "__rn")
    newest_first = Window.partitionBy(*spec.keys).orderBy("__rn")
    out = recent.withColumns(
        {
            "lag_1": F.lead(spec.kpi, 1).over(newest_first),
            "lag_2": F.lead(spec.kpi, 2).over(newest_first),
            "__gate": F.lead(F.lit(True), max(spec.min_points, 1) - 1).over(newest_first),
        }
    )
    out = out.where((F.col("__rn") == 1) & F.col("__gate")).drop("__rn", "__gate")
    out = out.withColumns(_rates(F.col(spec.kpi)))
    return add_baselines(add_calendar(out, spec, quarter=False))


def add_baselines(df: DataFrame) -> DataFrame:
    """Naive and drift forecasts of the row itself, from the two values before it."""
    return df.withColumns(
        {
            "arima_naive": F.col("lag_1"),
            "arima_drift": F.col("lag_1") + (F.col("lag_1") - F.col("lag_2")),
        }
    )


def supervised(df: DataFrame, spec: PanelSpec = PanelSpec(), label_date: bool = False) -> DataFrame:
    """Features at t with the KPI `horizon` rows later as `y_next`; rows without it are dropped.

    With `label_date` the date the label was taken from is kept as well.
    """
    extra = {"y_next": (spec.kpi, spec.horizon)}
    if label_date:
        extra["label_date"] = (spec.time, spec.horizon)
    out = _lags(df, spec, extra).where(F.col("y_next").isNotNull())
    out = add_calendar(out.withColumns(_rates(F.col(spec.kpi))), spec)
    return out.select(*_supervised_columns(df, spec), "y_next", *(["label_date"] if label_date else []))


def supervised_strict(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Features of row t from earlier rows only; the label is the KPI at t itself."""
    present = [c for c in spec.exog if c in df.columns]
    before = {f"__{c}": (c, -1) for c in present}
    out = _lags(df, spec, before).where(F.col(spec.kpi).isNotNull())
    out = out.withColumns(
        {
            "diff_1": F.col("lag_1") - F.col("lag_2"),
            "growth_1": growth(F.col("lag_1"), F.col("lag_2")),
            "mean_2": (F.col("lag_1") + F.col("lag_2")) / F.lit(2),
            "y_next": F.col(spec.kpi),
            "label_date": F.col(spec.time),
            **{c: F.col(f"__{c}") for c in present},
        }
    )
    return add_calendar(out, spec).select(*_supervised_columns(df, spec), "y_next", "label_date")


def _supervised_columns(df, spec):
    return [
        spec.entity,
        spec.time,
        *SUPERVISED_CALENDAR,
        *LAG_FEATURES,
        *[c for c in spec.exog if c in df.columns],
    ]


def leakage_contrast(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The same lag beside a same-period target and beside a next-period target."""
    rows, order, slices = in_slices(df, spec)
    out = with_neighbours(rows, spec.keys, order, slices, {"lag_1": (spec.kpi, -1), "y_next": (spec.kpi, 1)})
    kpi, lag, nxt = F.col(spec.kpi), F.col("lag_1"), F.col("y_next")
    return out.where(lag.isNotNull()).select(
        spec.entity,
        spec.time,
        "lag_1",
        kpi.alias("target_same"),
        nxt.alias("target_next"),
        (lag.isNotNull() & kpi.isNotNull()).alias("usable_same"),
        (lag.isNotNull() & nxt.isNotNull()).alias("usable_next"),
    )


def last_n(df: DataFrame, n: int, columns: Sequence[str] | None = None, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The last n rows of every entity."""
    out = latest_rows(df, spec.keys, [spec.time, spec.tie(df)], n, "rank_from_end")
    return out.select(spec.entity, spec.time, *(columns or [spec.kpi]), "rank_from_end")


def preview(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in a given order, for looking at."""
    return df.orderBy(*order).limit(n)


def feature_coverage(
    df: DataFrame,
    base: Sequence[str] = ("lag_1", "month", "year"),
    gated: Sequence[tuple[Sequence[str], float]] = (
        (("lag_2", "diff_1", "growth_1", "mean_2"), 0.5),
        (("OperatingExpenses", "GrossProfit", "Assets", "StockholdersEquity"), 0.7),
    ),
) -> DataFrame:
    """One row per candidate feature: how full it is and whether it is used.

    Base features are always used; the others only when strictly fuller than their gate.
    """
    candidates = [(c, None) for c in base] + [(c, g) for cols, g in gated for c in cols if c in df.columns]
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"n_{i}") for i, (c, _) in enumerate(candidates)])
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("feature"),
                F.col(f"n_{i}").alias("n_filled"),
                F.lit(g).cast("double").alias("gate"),
            )
            for i, (c, g) in enumerate(candidates)
        ]
    )
    out = counted.select("n_rows", F.explode(entries).alias("e")).select("n_rows", "e.*")
    used = F.col("gate").isNull() | (F.col("n_filled") > F.col("n_rows") * F.col("gate"))
    return out.withColumn("used", used)


def gated_features(df: DataFrame, **gates) -> list[str]:
    """Names of the features that pass their gate; a dozen short rows reach the driver."""
    rows = feature_coverage(df, **gates).where("used").orderBy("position").select("feature").collect()
    return [r.feature for r in rows]


def present_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """The features the table has; an error if it has none."""
    found = [c for c in features if c in df.columns]
    if not found:
        raise ValueError(f"none of the features {list(features)} is in the table")
    return found
