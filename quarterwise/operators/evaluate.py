"""Forecast metrics, volatility and prediction intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterwise.functions.numbers import rmse
from quarterwise.operators.neighbours import in_slices
from quarterwise.spec import PanelSpec

# The forecast column behind each model name, the decay, the variance
# floor and the width of a 95 % interval.
MODEL_COLUMNS = {"naive": "arima_naive", "drift": "arima_drift", "xgb": "xgb_point"}
DECAY = 0.94
VARIANCE_FLOOR = 1e-12
Z_95 = 1.96


def metrics_by_model(df: DataFrame, kpi: str, models: dict[str, str] = MODEL_COLUMNS) -> DataFrame:
    """MAE and RMSE per model. A model without any usable row stays, with NULLs.

    Each model is one pair of aggregates in the same pass, so no row is multiplied.
    """
    y = F.col(kpi)
    aggs = []
    for name, column in models.items():
        err = y - (F.col(column) if column in df.columns else F.lit(None).cast("double"))
        aggs.append(F.avg(F.abs(err)).alias(f"mae_{name}"))
        aggs.append(rmse(err * err).alias(f"rmse_{name}"))
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs).where(F.col("n") > 0)
    rows = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"mae_{m}").alias("MAE"), F.col(f"rmse_{m}").alias("RMSE")) for m in models]
    )
    return one.select(F.inline(rows))


def pooled_metrics(df: DataFrame, actual: str = "actual", forecast: str = "xgb_point", by: Sequence[str] = ()) -> DataFrame:
    """Rows, MAE and RMSE of one forecast, pooled or per group."""
    err = F.col(actual) - F.col(forecast)
    return df.groupBy(*by).agg(
        F.count(err).alias("n_rows"), F.avg(F.abs(err)).alias("mae"), rmse(err * err).alias("rmse")
    )


def ewma_volatility(df: DataFrame, residual: Column, order: Sequence[str], decay: float = DECAY) -> DataFrame:
    """sqrt of the exponentially weighted variance of residuals taken in row order: one row, `sigma`.

    var_i = decay * var_{i-1} + (1 - decay) * r_i^2 is a weighted sum with weight
    decay^(rows after i). Rows are range-partitioned and sorted newest first; each
    partition sums its own rows with the weight of its local position, and the few
    partition sums are then scaled by decay^(rows in newer partitions). All rows count.
    """
    newest_first = [F.col(c).desc_nulls_first() for c in order]
    squared = df.select(*order, (residual * residual).alias("r2")).where(F.col("r2").isNotNull())
    placed = (
        squared.repartitionByRange(*newest_first)
        .sortWithinPartitions(*newest_first)
        # partition number in the upper bits, position inside the partition in the lower 33
        .withColumn("id", F.monotonically_increasing_id())
    )
    position = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    parts = placed.groupBy(F.shiftright("id", 33).alias("part")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.lit(1 - decay) * F.pow(F.lit(decay), position) * F.col("r2")).alias("v"),
    )
    # one entry per shuffle partition
    listed = parts.agg(F.sort_array(F.collect_list(F.struct("part", "n", "v"))).alias("parts"))
    start = F.struct(F.lit(0).cast("bigint").alias("newer"), F.lit(0.0).alias("v"))
    total = F.aggregate(
        "parts",
        start,
        lambda acc, p: F.struct(
            (acc["newer"] + p["n"]).alias("newer"),
            (acc["v"] + F.pow(F.lit(decay), acc["newer"]) * p["v"]).alias("v"),
        ),
    )
    return listed.select(total.alias("t")).select(_sigma(F.col("t.newer"), F.col("t.v")).alias("sigma"))


def ewma_state(df: DataFrame, residual: Column, spec: PanelSpec = PanelSpec(), decay: float = DECAY) -> DataFrame:
    """Per entity what the volatility of later rows needs: n_residuals, weighted (the variance so far), first_time, last_time.

    Where `spec` declares slices, the sum is made slice by slice, so that a long history is split.
    """
    df, _, slices = in_slices(df, spec)
    rows = df.where(F.col(spec.entity).isNotNull()).select(
        spec.entity,
        (F.lit(0) if slices is None else slices).alias("slice"),
        F.col(spec.time).alias("t"),
        spec.tie(df).alias("tie"),
        (residual * residual).alias("r2"),
    )
    rows = rows.where(F.col("r2").isNotNull())
    inside = Window.partitionBy(spec.entity, "slice").orderBy(F.col("t").desc_nulls_first(), F.col("tie").desc())
    slices = (
        rows.withColumn("pos", F.row_number().over(inside) - 1)
        .groupBy(spec.entity, "slice")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.lit(1 - decay) * F.pow(F.lit(decay), F.col("pos")) * F.col("r2")).alias("v"),
            F.min("t").alias("first_time"),
            F.max("t").alias("last_time"),
        )
    )
    newer = Window.partitionBy(spec.entity).orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    scaled = slices.withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0)))
    return scaled.groupBy(spec.entity).agg(
        F.sum("n").alias("n_residuals"),
        F.sum(F.pow(F.lit(decay), F.col("newer")) * F.col("v")).alias("weighted"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    )


def merge_ewma_states(older: DataFrame, newer: DataFrame, spec: PanelSpec = PanelSpec(), decay: float = DECAY) -> DataFrame:
    """The state of both batches of rows, whose sizes do not matter any more; the job stops where a newer row is not later.

    One row per entity on either side. Merging is associative: states of many batches may be merged in any grouping that keeps
    their order.
    """
    a, b = older.alias("a"), newer.alias("b")
    both = a.join(b, spec.entity, "full_outer")
    late = F.col("b.first_time") <= F.col("a.last_time")
    n = F.coalesce("b.n_residuals", F.lit(0))
    merged = F.coalesce("a.weighted", F.lit(0.0)) * F.pow(F.lit(decay), n) + F.coalesce("b.weighted", F.lit(0.0))
    told = F.concat(F.lit("rows that are not later than the state of "), F.col(spec.entity).cast("string"))
    return both.select(
        spec.entity,
        (F.coalesce("a.n_residuals", F.lit(0)) + n).alias("n_residuals"),
        F.when(F.coalesce(late, F.lit(False)), F.raise_error(told).cast("double")).otherwise(merged).alias("weighted"),
        F.coalesce("a.first_time", "b.first_time").alias("first_time"),
        F.coalesce("b.last_time", "a.last_time").alias("last_time"),
    )


def volatility_of_state(state: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """entity, n_residuals, sigma of a state."""
    return state.select(spec.entity, "n_residuals", _sigma(F.col("n_residuals"), F.col("weighted")).alias("sigma"))


def ewma_volatility_by_entity(
    df: DataFrame, residual: Column, spec: PanelSpec = PanelSpec(), decay: float = DECAY
) -> DataFrame:
    """The same volatility per entity."""
    return volatility_of_state(ewma_state(df, residual, spec, decay), spec)


def _sigma(n: Column, variance: Column) -> Column:
    return F.when(n > 0, F.sqrt(variance + F.lit(VARIANCE_FLOOR))).otherwise(F.lit(0.0))


def prediction_interval(df: DataFrame, kpi: str, order: Sequence[str], point: str = "xgb_point") -> DataFrame:
    """Add pi_lower and pi_upper, 1.96 pooled volatilities around the forecast."""
    sigma = ewma_volatility(df, F.col(kpi) - F.col(point), order).scalar()
    return (
        df.withColumn("__sigma", sigma)
        .withColumns(
            {
                "pi_lower": F.col(point) - F.lit(Z_95) * F.col("__sigma"),
                "pi_upper": F.col(point) + F.lit(Z_95) * F.col("__sigma"),
            }
        )
        .drop("__sigma")
    )


def chart_table(df: DataFrame, spec: PanelSpec = PanelSpec(), point: str = "xgb_point") -> DataFrame:
    """First actual and forecast per entity, in billions."""
    order = F.struct(F.col(spec.time), F.xxhash64("actual", point))
    first = df.where(F.col(spec.entity).isNotNull()).groupBy(spec.entity).agg(
        F.min_by("actual", order).alias("a"), F.min_by(point, order).alias("p")
    )
    return first.select(spec.entity, (F.col("a") / F.lit(1e9)).alias("actual_B"), (F.col("p") / F.lit(1e9)).alias(f"{point}_B"))
