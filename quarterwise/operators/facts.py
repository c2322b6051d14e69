"""From filed facts to one wide row per entity and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tags read from filings, the per-share tag and the accepted forms.
TAGS = (
    "Revenues",
    "CostOfRevenue",
    "GrossProfit",
    "OperatingExpenses",
    "OperatingIncomeLoss",
    "NetIncomeLoss",
    "EarningsPerShareDiluted",
    "Assets",
    "Liabilities",
    "StockholdersEquity",
    "CashAndCashEquivalentsAtCarryingValue",
    "NetCashProvidedByUsedInOperatingActivities",
    "NetCashProvidedByUsedInInvestingActivities",
    "NetCashProvidedByUsedInFinancingActivities",
)
PER_SHARE_TAG = "EarningsPerShareDiluted"
FORMS = ("10-Q", "10-K")
LOOK_BACK_DAYS = 3650
LATEST_PERIODS = 40


def strip_hyphens(accession: Column) -> Column:
    return F.replace(accession, F.lit("-"), F.lit(""))


def filter_facts(
    facts: DataFrame, tags: Sequence[str] | None = TAGS, per_share_tag: str = PER_SHARE_TAG, forms: Sequence[str] = FORMS
) -> DataFrame:
    """Facts from accepted forms, complete, in dollars (or per share, for that tag)."""
    unit_ok = F.when(F.col("tag") == per_share_tag, F.lower("uom").contains("share")).otherwise(F.col("uom") == "USD")
    keep = (
        F.col("form").isin(*forms)
        & F.col("end").isNotNull()
        & F.col("value").isNotNull()
        & F.col("accn").isNotNull()
        & unit_ok
    )
    if tags is not None:
        keep = keep & F.col("tag").isin(*tags)
    return facts.where(keep)


def allowed_filings(
    filings: DataFrame, as_of: str, look_back_days: int = LOOK_BACK_DAYS, forms: Sequence[str] = FORMS
) -> DataFrame:
    """Filings of an accepted form filed within the look-back before `as_of`, with a bare accession key."""
    since = F.date_sub(F.lit(as_of).cast("date"), look_back_days)
    filed = F.col("filingDate").try_cast("date")
    kept = filings.where(F.col("form").isin(*forms) & (filed >= since) & (F.col("accessionNumber") != ""))
    return kept.withColumn("accn_stripped", strip_hyphens(F.col("accessionNumber")))


def newest_filings(filings: DataFrame) -> DataFrame:
    """Filings sorted newest first, for presentation."""
    return filings.orderBy(F.col("filingDate").desc(), F.col("accessionNumber"))


def facts_of_filings(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts whose accession, hyphens removed, is among the allowed filings.

    Spark picks the join: a broadcast when the accession list is measured small, else a
    shuffled semi join whose skewed keys adaptive execution splits.
    """
    keyed = facts.withColumn("accn_stripped", strip_hyphens(F.col("accn")))
    return keyed.join(filings.select("accn_stripped").distinct(), "accn_stripped", "left_semi")


def latest_periods(facts: DataFrame, n: int = LATEST_PERIODS, period: str = "end") -> DataFrame:
    """The newest n distinct periods."""
    return facts.where(F.col(period).isNotNull()).select(period).distinct().orderBy(F.col(period).desc()).limit(n)


def facts_in_latest_periods(facts: DataFrame, n: int = LATEST_PERIODS, period: str = "end") -> DataFrame:
    """Facts of the newest n periods; the period list has at most n rows, so it is broadcast."""
    return facts.join(F.broadcast(latest_periods(facts, n, period)), period, "left_semi")


def pivot_last(
    facts: DataFrame, tags: Sequence[str], keys: Sequence[str], order: str = "ord", period: str = "end"
) -> DataFrame:
    """One row per key and period, one column per tag, holding the last value in fact order.

    `order` is a number, so that "last" stays a hash aggregate with map-side combine.
    """
    dated = facts.withColumn("Date", F.date_format(period, "yyyy-MM-dd"))
    return dated.groupBy(*keys, "Date").pivot("tag", sorted(tags)).agg(F.max_by("value", order))


def raw_fact_sheet(facts: DataFrame, columns: Sequence[str] = ("tag", "form", "end", "value", "uom", "accn")) -> DataFrame:
    """Facts without helper columns, range-partitioned and sorted by tag and period."""
    sheet = facts.select(*columns)
    # the accession joins the range key so that one busy (tag, end) can span partitions
    return sheet.repartitionByRange("tag", "end", "accn").sortWithinPartitions("tag", "end", "accn")
