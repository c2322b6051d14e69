"""Readers for nested company-facts documents and parallel-array filing lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterwise.operators.facts import TAGS

# The shape of the two kinds of document.
FACT_SCHEMA = "form string, `end` string, val double, accn string"
FACTS_SCHEMA = f"""
    Company string,
    facts struct<`us-gaap`: map<string, struct<units: map<string, array<
        struct<{FACT_SCHEMA}>>>>>>
"""
FILINGS_SCHEMA = """
    Company string,
    filings struct<recent: struct<form: array<string>, filingDate: array<string>,
        reportDate: array<string>, accessionNumber: array<string>>>
"""


def read_company_facts(
    spark: SparkSession, path: str, tags: Sequence[str] | None = TAGS, multi_line: bool = False
) -> DataFrame:
    """Company-facts documents to long facts, all tags in one pass.

    `ord` numbers the facts of a (document, tag) in document order: unit first, then the
    position in the unit's list.
    """
    docs = spark.read.schema(FACTS_SCHEMA).option("multiLine", multi_line).json(path)
    return explode_company_facts(docs, tags)


def explode_company_facts(docs: DataFrame, tags: Sequence[str] | None = TAGS) -> DataFrame:
    by_tag = docs.select("Company", F.explode(F.col("facts")["us-gaap"]).alias("tag", "body"))
    if tags is not None:
        by_tag = by_tag.where(F.col("tag").isin(*tags))
    by_unit = by_tag.select("Company", "tag", F.posexplode("body.units").alias("unit_pos", "uom", "rows"))
    flat = by_unit.select("Company", "tag", "uom", "unit_pos", F.posexplode("rows").alias("pos", "r"))
    return flat.select(
        "Company",
        "tag",
        F.col("r.form").alias("form"),
        F.col("r.end").alias("end"),
        F.col("r.val").alias("value"),
        "uom",
        F.col("r.accn").alias("accn"),
        (F.shiftleft(F.col("unit_pos").cast("bigint"), 32) + F.col("pos")).alias("ord"),
    )


def read_filings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    docs = spark.read.schema(FILINGS_SCHEMA).option("multiLine", multi_line).json(path)
    return zip_filings(docs)


def zip_filings(docs: DataFrame) -> DataFrame:
    """Parallel arrays to one row per filing; pairing stops at the shortest array."""
    names = ["form", "filingDate", "reportDate", "accessionNumber"]
    arrays = [F.coalesce(F.col(f"filings.recent.{n}"), F.array().cast("array<string>")) for n in names]
    shortest = F.least(*[F.size(a) for a in arrays])
    zipped = F.arrays_zip(*[F.slice(a, F.lit(1), shortest).alias(n) for a, n in zip(arrays, names)])
    rows = docs.select("Company", F.explode(zipped).alias("f"))
    return rows.select("Company", *[F.col(f"f.{n}").alias(n) for n in names]).withColumn(
        "reportDate", F.nullif(F.col("reportDate"), F.lit(""))
    )
