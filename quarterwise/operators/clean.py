"""Bring raw, mixed-type records into a typed panel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterwise.functions.calendar import lenient_date, strict_date
from quarterwise.functions.numbers import NOT_AVAILABLE, blank_to_null, lenient_double, null_to_blank
from quarterwise.spec import PanelSpec


def clean_panel(df: DataFrame, spec: PanelSpec = PanelSpec(), lenient_dates: bool = True) -> DataFrame:
    """Keep entity, time, KPI and exogenous columns; add missing ones; cast leniently."""
    parse = lenient_date if lenient_dates else strict_date

    def number(name: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast("double").alias(name)
        return lenient_double(blank_to_null(F.col(name).cast("string"))).alias(name)

    return df.select(
        F.col(spec.entity) if spec.entity in df.columns else F.lit(None).cast("string").alias(spec.entity),
        parse(F.col(spec.time)).alias(spec.time),
        *[number(c) for c in (spec.kpi, *spec.exog)],
    )


def sentinel_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: blank_to_null(F.col(c)) for c in columns})


def null_to_sentinel(df: DataFrame) -> DataFrame:
    return df.select(*[null_to_blank(F.col(c)).alias(c) for c in df.columns])


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is NULL."""
    return df.na.drop("all")


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold no value at all; one aggregate over the table decides."""
    # an action, because the schema of the result depends on it: one row comes back
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if filled[c] > 0])


def tag_entity(df: DataFrame, name: str, entity: str = "Company") -> DataFrame:
    """Add the entity's name as the first column."""
    return df.select(F.lit(name).alias(entity), *[c for c in df.columns if c != entity])


def union_entities(frames: Sequence[DataFrame], entity: str = "Company") -> DataFrame:
    """Union by column name; columns a frame lacks are NULL; entity comes first."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return whole.select(entity, *[c for c in whole.columns if c != entity])


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(columns))


def nonnull_profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, non-null rows, share filled. One pass over the table."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"c_{i}") for i, c in enumerate(df.columns)])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c_{i}").alias("n_filled")) for i, c in enumerate(df.columns)])
    )
    return counted.select("n_rows", pairs.alias("p")).select(
        "p.column_name", "n_rows", "p.n_filled", F.try_divide("p.n_filled", "n_rows").alias("share_filled")
    )


__all__ = [
    "NOT_AVAILABLE",
    "clean_panel",
    "complete_cases",
    "drop_null_columns",
    "drop_null_rows",
    "nonnull_profile",
    "null_to_sentinel",
    "sentinel_to_null",
    "tag_entity",
    "union_entities",
]
