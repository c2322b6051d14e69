"""Panels, facts and predictions derived from the supplied tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterwise.functions.calendar import quarter_end
from quarterwise.functions.numbers import null_to_blank
from quarterwise.operators.features import timeseries_features
from quarterwise.session import materialise
from quarterwise.spec import PanelSpec

# The dates of the one-fold backtest, and the first test date of the walk-forward as a
# position among the panel's dates: two rows have to come before it.
TRAIN_END = "2000-12-31"
TEST_DATE = "2001-03-31"
FIRST_WALK = 2

SPARSE = PanelSpec(exog=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hundredths(c):
    """Two-digit amounts and rates as whole hundredths: sums of them are exact and cheap."""
    return F.rint(F.col(c) * 100).cast("bigint")


def _total(c, digits):
    """Exact total of whole units of 10^-digits, as a double; an overflow stops the job."""
    return (F.sum(c) / F.lit(10**digits)).alias(c)


def fin_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense panel: one row per nation and quarter."""
    lines = table(spark, sf_dir, "lineitem")
    per_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(_hundredths("l_extendedprice") * _hundredths("l_discount")).alias("opex"),
        F.sum(_hundredths("l_extendedprice") * (F.lit(100) - _hundredths("l_discount"))).alias("gross"),
        F.sum(_hundredths("l_quantity")).alias("assets"),
        F.sum(_hundredths("l_extendedprice") * _hundredths("l_tax")).alias("equity"),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderdate").cast("date").alias("d"),
        _hundredths("o_totalprice").alias("rev"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(per_order, "o_orderkey", "left").join(customers, "c_custkey").join(nations, "n_nationkey")
    grouped = joined.groupBy("n_nationkey", F.col("n_name").alias("Company"), quarter_end(F.col("d")).alias("Date")).agg(
        _total("rev", 2), _total("opex", 4), _total("gross", 4), _total("assets", 2), _total("equity", 4)
    )
    qi = (F.year("Date") - 1995) * 4 + F.quarter("Date") - 1
    mark = F.col("n_nationkey") * 31 + qi
    return grouped.select(
        "Company",
        "Date",
        F.when(mark % 13 == 0, None).when(mark % 17 == 0, 0.0).otherwise(F.col("rev")).alias("Revenues"),
        F.col("opex").alias("OperatingExpenses"),
        F.col("gross").alias("GrossProfit"),
        F.col("assets").alias("Assets"),
        F.when((F.col("n_nationkey") + qi) % 5 >= 2, F.col("equity")).alias("StockholdersEquity"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel as a stored table, for queries that read it more than once.

    It is small next to the order lines it is made from, which are then scanned once.
    """
    return materialise(fin_series(spark, sf_dir), "panel")


def panel_dates(rows: DataFrame) -> list[str]:
    """The dates of a panel in order; bounded by the calendar, a quarter each."""
    return [str(r.Date) for r in rows.select("Date").where("Date IS NOT NULL").distinct().orderBy("Date").collect()]


def sparse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(fin_sparse(spark, sf_dir), "sparse-panel")


def fin_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular panel: one row per customer and quarter with orders."""
    per_customer = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"), quarter_end(F.col("o_orderdate")).alias("Date"))
        .agg(F.sum(_hundredths("o_totalprice")).alias("rev"))
    )
    names = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("Company"))
    return per_customer.join(names, "c_custkey").select("Company", "Date", (F.col("rev") / F.lit(100)).alias("Revenues"))


# The tags of the facts view and the one that is counted per share.
FACT_TAGS = ("click", "error", "purchase", "signup", "view")
FACT_PER_SHARE = "signup"
FACTS_AS_OF, FACTS_LOOK_BACK = "2024-01-31", 10


def fin_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts, one per event."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    user = F.col("user_id").cast("string")
    return e.select(
        F.concat(F.lit("U"), user).alias("Company"),
        F.col("event_type").alias("tag"),
        F.when(i % 5 == 0, "10-K").when(i % 5 == 4, "8-K").otherwise("10-Q").alias("form"),
        F.col("ts").cast("date").alias("end"),
        "value",
        F.when(F.col("event_type") == FACT_PER_SHARE, F.when(i % 3 == 0, "USD").otherwise("USD/shares"))
        .otherwise(F.when(i % 7 == 0, "EUR").otherwise("USD"))
        .alias("uom"),
        F.concat(F.lpad(user, 10, "0"), F.lit("-24-"), F.lpad(F.dayofmonth("ts").cast("string"), 6, "0")).alias("accn"),
        i.alias("ord"),
    )


def fin_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per company, form and filing."""
    day = F.date_format("end", "yyyy-MM-dd")
    facts = fin_facts(spark, sf_dir)
    return facts.select(
        "Company", "form", day.alias("filingDate"), day.alias("reportDate"), F.col("accn").alias("accessionNumber")
    ).distinct()


def fin_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel as dirty text."""
    series = fin_series(spark, sf_dir)
    qi = (F.year("Date") - 1995) * 4 + F.quarter("Date") - 1
    numbers = [c for c in series.columns if c not in ("Company", "Date")]
    return series.select(
        "Company",
        F.when(qi % 9 == 8, "not-a-date").otherwise(F.date_format("Date", "yyyy-MM-dd")).alias("Date"),
        *[null_to_blank(F.col(c)).alias(c) for c in numbers],
    )


def fin_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, baselines and a formula in place of the model's forecast."""
    feats = timeseries_features(fin_series(spark, sf_dir))
    return feats.withColumns(
        {
            "quarter": F.quarter("Date"),
            "xgb_point": F.lit(0.7) * F.col("lag_1") + F.lit(0.3) * F.col("lag_2"),
        }
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stored table."""
    return materialise(fin_pred(spark, sf_dir), "predictions")
