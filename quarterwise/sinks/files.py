"""Writers for artifacts, exports, per-entity outputs and chat files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterwise.functions.numbers import NOT_AVAILABLE
from quarterwise.operators.clean import null_to_sentinel
from quarterwise.operators.facts import raw_fact_sheet


def write_artifact(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_twice(df: DataFrame, first: str, second: str) -> None:
    """The same rows to two places. The second copy is made from the first, not computed again."""
    write_artifact(df, first)
    write_artifact(df.sparkSession.read.parquet(first), second)


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header and 'N/A' for missing entries."""
    df.write.mode("overwrite").option("header", True).option("nullValue", NOT_AVAILABLE).csv(path)
    return path


def write_json_records(df: DataFrame, path: str) -> str:
    """JSON Lines, every entry as text, 'N/A' for missing entries."""
    null_to_sentinel(df).write.mode("overwrite").json(path)
    return path


def write_by_entity(df: DataFrame, path: str, entity: str = "Company", fmt: str = "parquet") -> str:
    """One folder per entity. Rebalancing gathers small entities and splits large ones by measured size."""
    writer = df.hint("rebalance", entity).write.mode("overwrite").option("header", True).option("nullValue", NOT_AVAILABLE)
    writer.partitionBy(entity).format(fmt).save(path)
    return path


def write_chat(df: DataFrame, path: str, record: str = "record", split: str = "split") -> str:
    """JSON Lines of records, one folder per split."""
    df.select(F.col(split), F.col(record).alias("value")).write.mode("overwrite").partitionBy(split).text(path)
    return path


def write_answers(df: DataFrame, path: str, key: str, answer: str, by: Sequence[str] = ()) -> str:
    """Keyed answers as JSON Lines {key, answer}, in one folder per value of `by`, such as company or year.

    One file per answer would be as many files as rows.
    """
    keyed = df.select(F.col(key).alias("key"), F.col(answer).alias("answer"), *by)
    (keyed.hint("rebalance", *by) if by else keyed).write.mode("overwrite").partitionBy(*by).json(path)
    return path


def write_raw_facts(df: DataFrame, path: str, columns: Sequence[str] = ("tag", "form", "end", "value", "uom", "accn")) -> str:
    """Fact sheet without helper columns, in (tag, period) order across the files."""
    return write_artifact(raw_fact_sheet(df, columns), path)
