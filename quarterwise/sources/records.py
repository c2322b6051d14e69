"""Readers for record files, Parquet artifacts and chat lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterwise.operators.chat import MESSAGE_SCHEMA
from quarterwise.session import path_exists
from quarterwise.spec import PanelSpec


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_json_panel(spark: SparkSession, path: str, spec: PanelSpec = PanelSpec(), lines: bool = True) -> DataFrame:
    """Record file to all-text columns; numbers and 'N/A' may be mixed in a column.

    JSON Lines by default. Without `lines` each file is one JSON array, which one task reads whole.
    """
    schema = text_schema([spec.entity, spec.time, spec.kpi, *spec.exog])
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_artifact(spark: SparkSession, *paths: str) -> DataFrame:
    """The first Parquet path that exists."""
    for path in paths:
        if path_exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"none of these exists: {list(paths)}")


def read_chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a chat file, raw and parsed; lines that cannot be read keep a NULL parse."""
    return spark.read.text(path).select(F.col("value"), F.from_json("value", MESSAGE_SCHEMA).alias("parsed"))


def read_tagged_files(spark: SparkSession, path: str, columns: Sequence[str], entity: str = "Company") -> DataFrame:
    """CSV files in one folder per entity (`Company=...`); the folder name becomes a column."""
    schema = T.StructType([*text_schema(columns).fields, T.StructField(entity, T.StringType())])
    out = spark.read.schema(schema).option("header", True).csv(path)
    return out.select(entity, *columns)
