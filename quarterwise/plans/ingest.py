"""Registered queries: readers, fact filters, pivots and writers.

Reader and writer queries write the whole view to a new folder and return what they
read back from it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterwise.operators import chat, clean, facts, features, normalise
from quarterwise.plans import views as v
from quarterwise.plans.sql import sql
from quarterwise.session import new_folder
from quarterwise.sinks import answers, files, upsert
from quarterwise.sources import filings, large_json, records

_RAW = ["Date", "Revenues", "OperatingExpenses", "GrossProfit", "Assets", "StockholdersEquity"]
_FACT = ["Company", "tag", "form", "end_dt", "value", "uom", "accn"]


def _facts_out(df, *more):
    return df.withColumn("end_dt", F.col("end").cast("date")).select(*_FACT, *more)


#: Small ranges, so that files made of the smaller tables are cut too; the session's setting suits large files.
_SPLIT_BYTES = 1 << 18


def _panel_arrays(spark, sf):
    """JSON array files, one per company, with numbers unquoted beside 'N/A' texts."""
    raw = v.fin_raw(spark, sf)
    # a company has at most one row per quarter here, so its array is bounded by the calendar
    arrays = raw.groupBy("Company").agg(F.collect_list(F.struct(*raw.columns)).alias("rows"))
    text = F.regexp_replace(F.to_json("rows"), r':"(-?[0-9][0-9.E]*)"', ":$1")
    path = new_folder(spark, "json-panel")
    arrays.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def src_json_panel(spark, sf):
    return clean.clean_panel(records.read_json_panel(spark, _panel_arrays(spark, sf), lines=False))


def src_json_split(spark, sf):
    """The same arrays, each read in many ranges."""
    schema = records.text_schema(["Company", *_RAW])
    return clean.clean_panel(large_json.read_json_array(spark, _panel_arrays(spark, sf), schema, _SPLIT_BYTES))


def src_tagged_files(spark, sf):
    raw = v.fin_raw(spark, sf)
    path = new_folder(spark, "tagged")
    files.write_by_entity(raw, path, fmt="csv")
    return clean.clean_panel(records.read_tagged_files(spark, path, _RAW))


def _fact_documents(df):
    """Nested documents, at most 1000 events each."""
    row = F.struct("ord", "form", F.date_format("end", "yyyy-MM-dd").alias("end"), F.col("value").alias("val"), "accn")
    # all three groupings meet within (Company, part): the events are dealt once
    dealt = df.withColumn("part", F.floor(F.col("ord") / 1000)).repartition("Company", "part")
    units = dealt.groupBy("Company", "part", "tag", "uom").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    bare = F.transform("rows", lambda r: F.struct(r["form"].alias("form"), r["end"].alias("end"), r["val"].alias("val"), r["accn"].alias("accn")))
    tags = units.groupBy("Company", "part", "tag").agg(F.map_from_entries(F.collect_list(F.struct("uom", bare))).alias("units"))
    docs = tags.groupBy("Company", "part").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("units")))).alias("us-gaap"))
    return docs.select("Company", F.struct("us-gaap").alias("facts"))


def src_company_facts(spark, sf):
    path = new_folder(spark, "company-facts")
    _fact_documents(v.fin_facts(spark, sf)).write.json(path)
    return _facts_out(filings.read_company_facts(spark, path, v.FACT_TAGS))


def src_facts_split(spark, sf):
    """The same documents, several to a file, read in ranges that cut through them."""
    path = new_folder(spark, "large-facts")
    _fact_documents(v.fin_facts(spark, sf)).write.json(path)
    return _facts_out(large_json.read_large_facts(spark, path, v.FACT_TAGS, _SPLIT_BYTES))


def src_filings_zip(spark, sf):
    """Parallel arrays of which one is longer than the others; the surplus is not paired."""
    names = ["form", "filingDate", "reportDate", "accessionNumber"]
    # at most one filing per company, form and day, so the arrays are bounded by the calendar
    rows = v.fin_filings(spark, sf).groupBy("Company").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("r"))
    arrays = [F.col(f"r.{n}") for n in names]
    arrays[2] = F.concat(arrays[2], F.array(F.lit("2099-12-31")))
    recent = F.struct(*[a.alias(n) for a, n in zip(arrays, names)])
    path = new_folder(spark, "filings")
    rows.select("Company", F.struct(recent.alias("recent")).alias("filings")).write.json(path)
    return filings.read_filings(spark, path)


def _kept(spark, sf):
    return facts.filter_facts(v.fin_facts(spark, sf), v.FACT_TAGS, v.FACT_PER_SHARE)


def facts_filter(spark, sf):
    return _facts_out(_kept(spark, sf), "ord")


def _allowed(spark, sf):
    return facts.allowed_filings(v.fin_filings(spark, sf), v.FACTS_AS_OF, v.FACTS_LOOK_BACK)


def facts_allowed_filings(spark, sf):
    return facts.newest_filings(_allowed(spark, sf))


def facts_semi_accession(spark, sf):
    return _facts_out(facts.facts_of_filings(_kept(spark, sf), _allowed(spark, sf)), "accn_stripped", "ord")


def facts_latest_periods(spark, sf):
    return _facts_out(facts.facts_in_latest_periods(_kept(spark, sf), 20), "ord")


def facts_pivot_last(spark, sf):
    return facts.pivot_last(_kept(spark, sf), v.FACT_TAGS, ["Company"])


def sink_raw_facts(spark, sf):
    path = new_folder(spark, "raw-facts")
    files.write_raw_facts(_kept(spark, sf), path)
    return records.read_artifact(spark, path).withColumnRenamed("end", "end_dt")


def sink_parquet_roundtrip(spark, sf):
    path = new_folder(spark, "supervised")
    files.write_artifact(features.supervised(v.panel(spark, sf)), path)
    return records.read_artifact(spark, path + "-absent", path)


def sink_two_targets(spark, sf):
    first, second = new_folder(spark, "first"), new_folder(spark, "second")
    files.write_twice(v.fin_series(spark, sf), first, second)
    return records.read_artifact(spark, second)


def sink_upsert_dedupe(spark, sf):
    """Quarters 1-3, then quarters 2-4 with every row twice: the second of the later pair stays.

    The later batch brings interval columns that the table lacks so far; a third batch, of one
    year, lacks them again.
    """
    pred = v.predictions(spark, sf)
    path = new_folder(spark, "predictions")
    upsert.upsert_predictions(pred.where(F.col("quarter") <= 3), path)
    twice = pred.where(F.col("quarter") >= 2).withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    point = F.col("xgb_point") + F.col("seq") * 10
    upsert.upsert_predictions(twice.withColumns({"xgb_point": point, "pi_lower": point - 5, "pi_upper": point + 5}), path, order=["seq"])
    upsert.upsert_predictions(pred.where("year = 1996 AND quarter = 1"), path)
    return upsert.read_predictions(spark, path)


def sink_csv_na_roundtrip(spark, sf):
    path = new_folder(spark, "csv")
    files.write_csv(v.fin_series(spark, sf), path)
    schema = records.text_schema(["Company", *_RAW])
    return clean.clean_panel(spark.read.schema(schema).option("header", True).csv(path), lenient_dates=False)


def sink_json_na_roundtrip(spark, sf):
    path = new_folder(spark, "json")
    files.write_json_records(v.fin_series(spark, sf), path)
    return clean.clean_panel(records.read_json_panel(spark, path), lenient_dates=False)


def sink_partitioned(spark, sf):
    path = new_folder(spark, "by-company")
    pred = v.fin_pred(spark, sf).select("Company", "Date", "Revenues", "xgb_point")
    files.write_by_entity(pred, path)
    return records.read_artifact(spark, path)


def sink_answers(spark, sf):
    """Keyed answers, written and read back."""
    pred = normalise.finalise(v.fin_pred(spark, sf), "Net Revenues")
    key = normalise.answer_key(*[F.col(c) for c in ("Company", "KPI", "year", "quarter")])
    answer = F.to_json(F.struct(F.col("xgb_point").alias("final_forecast"), F.col("KPI").alias("explanation")))
    path = new_folder(spark, "answers")
    files.write_answers(pred.select(key.alias("k"), answer.alias("a")), path, "k", "a")
    back = chat.parse_answers(spark.read.schema("key string, answer string").json(path))
    return back.select("key", "how", "final_forecast", "explanation")


def sink_answer_store(spark, sf):
    """Answers stored by key, and the store asked for every key of the irregular panel."""
    pred = normalise.finalise(v.fin_pred(spark, sf), "Net Revenues")
    key = normalise.answer_key(*[F.col(c) for c in ("Company", "KPI", "year", "quarter")])
    path = new_folder(spark, "answer-store")
    keyed = pred.select(key.alias("k"), F.col("Revenues").cast("string").alias("a"))
    answers.write_answer_store(keyed, path, "k", "a", buckets=16)
    wanted = v.fin_pred(spark, sf).select("Company", F.add_months("Date", F.when(F.month("Date") == 12, 120).otherwise(0)).alias("day"))
    wanted = wanted.withColumn("k", normalise.answer_key(F.col("Company"), F.lit("Net Revenues"), F.year("day"), F.quarter("day")))
    found = answers.answers_of(wanted.select("Company", "k"), path, "k")
    return found.select("Company", F.col("k").alias("key"), F.col("answer").isNotNull().alias("found"), F.col("answer").cast("double").alias("revenues"))


QUERIES = {
    f.__name__: f
    for f in (
        src_json_panel,
        src_json_split,
        src_tagged_files,
        src_company_facts,
        src_facts_split,
        src_filings_zip,
        facts_filter,
        facts_allowed_filings,
        facts_semi_accession,
        facts_latest_periods,
        facts_pivot_last,
        sink_raw_facts,
        sink_parquet_roundtrip,
        sink_two_targets,
        sink_answer_store,
        sink_upsert_dedupe,
        sink_csv_na_roundtrip,
        sink_json_na_roundtrip,
        sink_partitioned,
        sink_answers,
    )
}

_F = 'Company, tag, form, end_dt, "value", uom, accn'
_SUP = """Company, "Date", "year", "quarter", "month", lag_1, lag_2, diff_1, growth_1, mean_2, OperatingExpenses,
    GrossProfit, Assets, StockholdersEquity, y_next"""
_LATEST = """SELECT * FROM fin_kept WHERE end_dt IN (SELECT DISTINCT end_dt FROM fin_kept ORDER BY end_dt DESC LIMIT 20)"""

ORACLE = {
    "src_json_panel": sql("SELECT * FROM fin_clean", "fin_clean"),
    "src_json_split": sql("SELECT * FROM fin_clean", "fin_clean"),
    "src_tagged_files": sql("SELECT * FROM fin_clean", "fin_clean"),
    "src_company_facts": sql(f"SELECT {_F} FROM fin_facts", "fin_facts"),
    "src_facts_split": sql(f"SELECT {_F} FROM fin_facts", "fin_facts"),
    "src_filings_zip": sql("SELECT * FROM fin_filings", "fin_filings"),
    "facts_filter": sql(f"SELECT {_F}, ord FROM fin_kept", "fin_kept"),
    "facts_allowed_filings": sql("SELECT * FROM fin_allowed", "fin_allowed"),
    "facts_semi_accession": sql(f"SELECT {_F}, accn_stripped, ord FROM fin_allowed_facts", "fin_allowed_facts"),
    "facts_latest_periods": sql(f"SELECT {_F}, ord FROM ({_LATEST})", "fin_kept"),
    "facts_pivot_last": sql(
        "SELECT Company, strftime(end_dt, '%Y-%m-%d') AS \"Date\", "
        + ", ".join(f"arg_max(\"value\", ord) FILTER (WHERE tag = '{t}') AS \"{t}\"" for t in v.FACT_TAGS)
        + " FROM fin_kept GROUP BY 1, 2",
        "fin_kept",
    ),
    "sink_raw_facts": sql('SELECT tag, form, end_dt, "value", uom, accn FROM fin_kept', "fin_kept"),
    "sink_parquet_roundtrip": sql(f"SELECT {_SUP} FROM fin_sup", "fin_sup"),
    "sink_two_targets": sql("SELECT * FROM fin_series", "fin_series"),
    "sink_answer_store": sql(
        """, k AS (SELECT Company, CASE WHEN month("Date") = 12 THEN year("Date") + 10 ELSE year("Date") END AS y, quarter("Date") AS q FROM fin_pred)
           SELECT k.Company, replace(concat(k.Company, '_Net Revenues_', y, 'Q', q, '.json'), ' ', '_') AS key,
             p.Revenues IS NOT NULL AS found, p.Revenues AS revenues
           FROM k LEFT JOIN fin_pred p ON k.Company = p.Company AND y = p."year" AND q = p."quarter" """,
        "fin_pred",
    ),
    "sink_upsert_dedupe": sql(
        """SELECT Company, "Date", CASE WHEN "quarter" = 1 THEN xgb_point ELSE xgb_point + 20 END AS xgb_point, arima_naive,
             arima_drift, "year", "quarter", "month", Revenues, CASE WHEN "quarter" > 1 THEN xgb_point + 20 - 5 END AS pi_lower,
             CASE WHEN "quarter" > 1 THEN xgb_point + 20 + 5 END AS pi_upper FROM fin_pred""",
        "fin_pred",
    ),
    "sink_csv_na_roundtrip": sql("SELECT * FROM fin_series", "fin_series"),
    "sink_json_na_roundtrip": sql("SELECT * FROM fin_series", "fin_series"),
    "sink_answers": sql(
        """SELECT replace(concat(Company, '_', 'Net Revenues', '_', "year", 'Q', "quarter", '.json'), ' ', '_') AS "key",
             'whole' AS how, xgb_point AS final_forecast, 'Net Revenues' AS explanation FROM fin_pred""",
        "fin_pred",
    ),
    "sink_partitioned": sql('SELECT Company, "Date", Revenues, xgb_point FROM fin_pred', "fin_pred"),
}
