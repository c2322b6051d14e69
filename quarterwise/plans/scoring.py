"""Registered queries: metrics, volatility, intervals, backtests, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterwise.operators import asof, backtest, evaluate, features, normalise
from quarterwise.plans import views as v
from quarterwise.plans.sql import sql
from quarterwise.session import materialise

ORDER = ["Company", "Date"]


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def eval_metrics_by_model(spark, sf):
    return _rounded(evaluate.metrics_by_model(v.fin_pred(spark, sf), "Revenues"), 2, "MAE", "RMSE")


def eval_ewma_vol(spark, sf):
    residual = F.col("Revenues") - F.col("xgb_point")
    return _rounded(evaluate.ewma_volatility(v.fin_pred(spark, sf), residual, ORDER), 2, "sigma")


def eval_ewma_vol_by_company(spark, sf):
    residual = F.col("Revenues") - F.col("xgb_point")
    return _rounded(evaluate.ewma_volatility_by_entity(v.fin_pred(spark, sf), residual), 2, "sigma")


def eval_ewma_incremental(spark, sf):
    """The same from a stored state of the rows up to the training end and the rows after it."""
    residual = F.col("Revenues") - F.col("xgb_point")
    pred = v.predictions(spark, sf)
    before = F.col("Date") <= v.TRAIN_END
    state = materialise(evaluate.ewma_state(pred.where(before), residual), "ewma-state")
    merged = evaluate.merge_ewma_states(state, evaluate.ewma_state(pred.where(~before), residual))
    return _rounded(evaluate.volatility_of_state(merged), 2, "sigma")


def eval_prediction_interval(spark, sf):
    out = evaluate.prediction_interval(v.predictions(spark, sf), "Revenues", ORDER)
    return _rounded(out, 2, "pi_lower", "pi_upper").select("Company", "Date", "xgb_point", "pi_lower", "pi_upper")


def report_actual_vs_pred(spark, sf):
    known = v.fin_pred(spark, sf).withColumnRenamed("Revenues", "actual").na.drop(subset=["actual", "xgb_point"])
    return evaluate.chart_table(known)


def bt_train_rows(spark, sf):
    rows = backtest.training_rows(features.supervised(v.panel(spark, sf), label_date=True), v.TRAIN_END)
    return rows.select("Company", "Date", "label_date", "lag_1", "growth_1", "y_next")


def bt_train_rows_strict(spark, sf):
    sup = features.supervised(v.panel(spark, sf), label_date=True)
    return backtest.training_rows(sup, v.TRAIN_END, strict=True).select("Company", "Date", "label_date", "y_next")


def bt_test_rows(spark, sf):
    return backtest.test_rows(v.fin_series(spark, sf), v.TEST_DATE)


def bt_asof_exog(spark, sf):
    panel = v.fin_series(spark, sf)
    return backtest.asof_rows(panel, v.TEST_DATE, ["OperatingExpenses", "GrossProfit", "Assets", "StockholdersEquity"])


def bt_asof_join(spark, sf):
    """Every row of the irregular panel with its company's last row before it."""
    rows = v.sparse_panel(spark, sf)
    take = {"asof_date": "Date", "asof_revenues": "Revenues"}
    return asof.asof_join(rows, rows, ["Company"], "Date", "Date", take)


def bt_asof_events(spark, sf):
    """Every purchase with the user's last view at or before it; a view may come at the same time."""
    events = v.table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("who"), "event_type", F.col("event_id").alias("ord"), "value", "ts"
    )
    views, bought = events.where("event_type = 'view'"), events.where("event_type = 'purchase'").drop("event_type")
    take = {"view_ord": "ord", "view_value": "value"}
    return asof.asof_join(bought, views, ["who"], "ts", "ts", take, strict=False, order=["ord"]).drop("ts")


def bt_leakage_report(spark, sf):
    panel = v.panel(spark, sf)
    train = backtest.training_rows(features.supervised(panel, label_date=True), v.TRAIN_END)
    tests = backtest.test_rows(panel, v.TEST_DATE)
    both = [
        backtest.leakage_report(rows, tests, v.TRAIN_END, v.TEST_DATE).withColumn("labels", F.lit(name))
        for name, rows in (("dated", train), ("undated", train.drop("label_date")))
    ]
    return both[0].unionByName(both[1])


def _compared(spark, sf, actual):
    panel = v.panel(spark, sf)
    rows = backtest.naive_drift(backtest.test_rows(panel, v.TEST_DATE))
    truth = backtest.actuals(features.supervised(panel), panel, [v.TEST_DATE], actual=actual)
    return backtest.compare(rows, truth, ["arima_naive", "arima_drift"])


def bt_compare(spark, sf):
    return _compared(spark, sf, "next")


def bt_compare_strict(spark, sf):
    return _compared(spark, sf, "at_test_date")


def eval_backtest_metrics(spark, sf):
    return _rounded(evaluate.pooled_metrics(_compared(spark, sf, "next"), forecast="arima_drift"), 1, "mae", "rmse")


def bt_history_report(spark, sf):
    panel = v.panel(spark, sf)
    return backtest.history_report(panel, features.supervised(panel), v.TRAIN_END, v.TEST_DATE)


def _walk(panel, spec, actual="next"):
    sup = features.supervised(panel, spec)
    out = backtest.walk_forward_scores(panel, sup, v.panel_dates(panel)[v.FIRST_WALK :], spec, actual)
    # whole units: means of two-digit amounts often end on a half at one or two digits,
    # where the order of summation would decide the rounding
    return _rounded(out, 0, "naive_mae", "naive_rmse", "drift_mae", "drift_rmse")


def bt_walk_forward(spark, sf):
    return _walk(v.panel(spark, sf), v.PanelSpec())


def bt_walk_forward_strict(spark, sf):
    return _walk(v.panel(spark, sf), v.PanelSpec(), "at_test_date")


def bt_walk_forward_sparse(spark, sf):
    return _walk(v.sparse_panel(spark, sf), v.SPARSE)


def bt_walk_forward_rows(spark, sf):
    panel = v.sparse_panel(spark, sf)
    return backtest.walk_forward_rows(panel, v.panel_dates(panel)[v.FIRST_WALK :], v.SPARSE)


def norm_aliases(spark, sf):
    foreign = v.fin_pred(spark, sf).select(
        F.col("Company").alias("ticker"),
        F.lit("Revenues").alias("metric"),
        F.col("Revenues").alias("y_true"),
        F.col("arima_naive").alias("last_value"),
        F.col("xgb_point").alias("xgb_pred"),
        F.col("Date").alias("target_date"),
    )
    return normalise.normalise_predictions(materialise(foreign, "foreign"))


def norm_finalize(spark, sf):
    """Rows of the second quarter lose their date, and with it the year they carry."""
    bare = v.fin_pred(spark, sf).drop("Company", "arima_drift").withColumn("extra", F.month("Date"))
    bare = bare.withColumn("Date", F.when(F.col("quarter") != 2, F.col("Date")))
    return normalise.finalise(bare, "Revenues")


def norm_year_quarter(spark, sf):
    base = features.add_calendar(v.panel(spark, sf)).select("Company", "Date", "year", "quarter")
    y = (F.col("year") + 20).cast("string")
    q = F.col("quarter").cast("string")
    label = (
        F.when(F.col("quarter") == 1, F.concat(y, F.lit("Q"), q))
        .when(F.col("quarter") == 2, F.concat(y, F.lit("-Q"), q))
        .when(F.col("quarter") == 3, F.concat(F.lit("fy "), y, F.lit(" q"), q))
        .otherwise("n/a")
    )
    by_label = base.select("Company", "Date", label.alias("Period"))
    by_target = base.select("Company", "Date", F.col("year").alias("target_year"), F.col("quarter").alias("target_quarter"))
    by_date = base.select("Company", "Date", F.lit("n/a").alias("Period"), F.col("Date").cast("string").alias("report_date"))
    parts = [
        normalise.resolve_year_quarter(d).select(F.lit(n).alias("source"), "Company", "Date", "year", "quarter")
        for n, d in (("label", by_label), ("target", by_target), ("date", by_date))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def proj_answer_key(spark, sf):
    df = normalise.finalise(v.fin_series(spark, sf), "Total Revenues")
    key = normalise.answer_key(*[F.col(c) for c in ("Company", "KPI", "year", "quarter")])
    return df.select("Company", "Date", key.alias("answer_key"))


QUERIES = {
    f.__name__: f
    for f in (
        eval_metrics_by_model,
        eval_ewma_vol,
        eval_ewma_vol_by_company,
        eval_ewma_incremental,
        eval_prediction_interval,
        eval_backtest_metrics,
        report_actual_vs_pred,
        bt_train_rows,
        bt_train_rows_strict,
        bt_test_rows,
        bt_asof_exog,
        bt_asof_join,
        bt_asof_events,
        bt_leakage_report,
        bt_compare,
        bt_compare_strict,
        bt_history_report,
        bt_walk_forward,
        bt_walk_forward_strict,
        bt_walk_forward_sparse,
        bt_walk_forward_rows,
        norm_aliases,
        norm_finalize,
        norm_year_quarter,
        proj_answer_key,
    )
}

_METRICS = " UNION ALL ".join(
    f"""SELECT '{m}' AS model, round(avg(abs(Revenues - {c})), 2) AS "MAE",
        round(sqrt(avg((Revenues - {c}) * (Revenues - {c}))), 2) AS "RMSE" FROM fin_pred"""
    for m, c in (("naive", "arima_naive"), ("drift", "arima_drift"), ("xgb", "xgb_point"))
)
_RESID = """, res AS (SELECT Company, "Date", (Revenues - xgb_point) * (Revenues - xgb_point) AS r2 FROM fin_pred
      WHERE Revenues IS NOT NULL AND xgb_point IS NOT NULL),
    pooled AS (SELECT sqrt(sum((1 - CAST(0.94 AS DOUBLE)) * pow(CAST(0.94 AS DOUBLE), rn - 1) * r2) + 1e-12) AS sigma
      FROM (SELECT r2, row_number() OVER (ORDER BY Company DESC, "Date" DESC) AS rn FROM res))"""

_BY_COMPANY = """ SELECT Company, count(*) AS n_residuals,
      round(sqrt(sum((1 - CAST(0.94 AS DOUBLE)) * pow(CAST(0.94 AS DOUBLE), rn - 1) * r2) + 1e-12), 2) AS sigma
    FROM (SELECT Company, r2, row_number() OVER (PARTITION BY Company ORDER BY "Date" DESC) AS rn FROM res)
    GROUP BY Company"""


def _walk_rows_sql(panel: str, exog: str = "", first: int = v.FIRST_WALK) -> str:
    carried = "".join(f", {c}" for c in exog.split())
    return f"""
    , f AS (SELECT DISTINCT "Date" AS test_date FROM {panel} ORDER BY 1 OFFSET {first}),
    p AS (SELECT "Date", Company, Revenues AS lag_1, lag(Revenues) OVER (PARTITION BY Company ORDER BY "Date") AS lag_2{carried} FROM {panel}),
    g AS (SELECT test_date, Company FROM f, (SELECT DISTINCT Company FROM {panel})),
    t AS (SELECT g.test_date, p.* EXCLUDE ("Date") FROM g ASOF JOIN p ON g.Company = p.Company AND g.test_date > p."Date"
      WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL)"""


def walk_sql(panel: str, actual: str, body: str, first: int = v.FIRST_WALK) -> str:
    return f"""{_walk_rows_sql(panel, first=first)},
    l AS (SELECT *, lead(Revenues) OVER (PARTITION BY Company ORDER BY "Date") AS y FROM {panel}),
    c AS (SELECT t.*, {actual} AS actual, lag_1 + (lag_1 - lag_2) AS drift
      FROM t JOIN l ON t.Company = l.Company AND t.test_date = l."Date" WHERE {actual} IS NOT NULL)
    {body}"""


_WALK = """SELECT test_date, count(*) AS n_entities, round(avg(abs(actual - lag_1)), 0) AS naive_mae,
      round(sqrt(avg((actual - lag_1) * (actual - lag_1))), 0) AS naive_rmse,
      round(avg(abs(actual - drift)), 0) AS drift_mae,
      round(sqrt(avg((actual - drift) * (actual - drift))), 0) AS drift_rmse FROM c GROUP BY test_date"""
_WALK_ROWS = """ SELECT Company, test_date AS "Date", lag_1, lag_2, lag_1 - lag_2 AS diff_1,
      lag_1 / nullif(lag_2, 0) - 1 AS growth_1, (lag_1 + lag_2) / 2 AS mean_2, CAST(year(test_date) AS INTEGER) AS "year",
      CAST(quarter(test_date) AS INTEGER) AS "quarter", CAST(month(test_date) AS INTEGER) AS "month" FROM t"""

ORACLE = {
    "eval_metrics_by_model": sql(_METRICS, "fin_pred"),
    "eval_ewma_vol": sql(_RESID + " SELECT round(sigma, 2) AS sigma FROM pooled", "fin_pred"),
    "eval_ewma_vol_by_company": sql(_RESID + _BY_COMPANY, "fin_pred"),
    "eval_ewma_incremental": sql(_RESID + _BY_COMPANY, "fin_pred"),
    "eval_prediction_interval": sql(
        _RESID
        + """ SELECT Company, "Date", xgb_point, round(xgb_point - 1.96::DOUBLE * sigma, 2) AS pi_lower,
               round(xgb_point + 1.96::DOUBLE * sigma, 2) AS pi_upper FROM fin_pred, pooled""",
        "fin_pred",
    ),
    "eval_backtest_metrics": sql(
        """SELECT count(*) AS n_rows, round(avg(abs(actual - arima_drift)), 1) AS mae,
             round(sqrt(avg((actual - arima_drift) * (actual - arima_drift))), 1) AS rmse FROM fin_compare""",
        "fin_compare",
    ),
    "report_actual_vs_pred": sql(
        """SELECT Company, Revenues / 1e9 AS "actual_B", xgb_point / 1e9 AS "xgb_point_B" FROM (
             SELECT *, row_number() OVER (PARTITION BY Company ORDER BY "Date") AS rn FROM fin_pred
             WHERE Revenues IS NOT NULL AND xgb_point IS NOT NULL) WHERE rn = 1""",
        "fin_pred",
    ),
    "bt_train_rows": sql(
        """SELECT Company, "Date", label_date, lag_1, growth_1, y_next FROM fin_sup WHERE "Date" <= DATE '2000-12-31'""",
        "fin_sup",
    ),
    "bt_train_rows_strict": sql(
        """SELECT Company, "Date", label_date, y_next FROM fin_sup
           WHERE "Date" <= DATE '2000-12-31' AND label_date <= DATE '2000-12-31'""",
        "fin_sup",
    ),
    "bt_test_rows": sql("SELECT * FROM fin_test", "fin_test"),
    "bt_asof_exog": sql(
        """SELECT Company, "Date" AS asof_date, OperatingExpenses, GrossProfit, Assets, StockholdersEquity
           FROM past_two WHERE rn = 1""",
        "past_two",
    ),
    "bt_asof_join": sql(
        """SELECT l.*, r."Date" AS asof_date, r.Revenues AS asof_revenues
           FROM fin_sparse l ASOF LEFT JOIN fin_sparse r ON l.Company = r.Company AND r."Date" < l."Date"  """,
        "fin_sparse",
    ),
    "bt_asof_events": """
        WITH v AS (SELECT user_id, ts, max(event_id) AS view_ord, arg_max(value, event_id) AS view_value
                   FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
        SELECT concat('U', b.user_id) AS who, b.event_id AS "ord", b.value, view_ord, view_value
        FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts >= v.ts
    """,
    "bt_leakage_report": sql(
        """, tr AS (SELECT * FROM fin_sup WHERE "Date" <= DATE '2000-12-31'),
           k AS (SELECT unnest(['dated', 'undated']) AS labels)
           SELECT 'train_date' AS "check", count(*) AS n_rows, count(*) FILTER (WHERE "Date" > DATE '2000-12-31') AS violations,
             max("Date") AS last_date, TRUE AS evaluated, labels FROM tr, k GROUP BY labels
           UNION ALL SELECT 'label_date', count(*), CASE WHEN labels = 'dated' THEN count(*) FILTER (WHERE label_date >= DATE '2001-03-31') END,
             CASE WHEN labels = 'dated' THEN max(label_date) END, labels = 'dated', labels FROM tr, k GROUP BY labels
           UNION ALL SELECT 'test_date', count(*), count(*) FILTER (WHERE "Date" < DATE '2001-03-31'), max("Date"), TRUE, labels
             FROM fin_test, k GROUP BY labels
           UNION ALL SELECT 'y_next_in_test', count(*), 0, NULL, TRUE, labels FROM fin_test, k GROUP BY labels""",
        "fin_sup",
        "fin_test",
    ),
    "bt_compare": sql("SELECT * FROM fin_compare", "fin_compare"),
    "bt_compare_strict": sql(
        """SELECT t.Company, t."Date", s.Revenues AS actual, t.lag_1 AS arima_naive, t.lag_1 + t.diff_1 AS arima_drift
           FROM fin_test t JOIN fin_series s ON t.Company = s.Company AND t."Date" = s."Date" WHERE s.Revenues IS NOT NULL""",
        "fin_test",
    ),
    "bt_history_report": sql(
        """, s AS (SELECT Company, count(*) FILTER (WHERE "Date" <= DATE '2000-12-31') AS n_supervised FROM fin_sup GROUP BY 1),
           r AS (SELECT Company, count(*) FILTER (WHERE "Date" < DATE '2001-03-31') AS n_before,
               count(*) FILTER (WHERE "Date" < DATE '2001-03-31' AND Revenues IS NOT NULL) AS n_filled
             FROM fin_series GROUP BY 1),
           d AS (SELECT Company, "Date", row_number() OVER (PARTITION BY Company ORDER BY "Date" DESC) AS rn
             FROM fin_series WHERE "Date" < DATE '2001-03-31' AND Revenues IS NOT NULL)
           SELECT s.Company, n_before, n_filled, n_supervised, d1."Date" AS last_date, d2."Date" AS second_last_date,
             n_filled >= 2 AS enough
           FROM s JOIN r ON s.Company = r.Company LEFT JOIN d d1 ON s.Company = d1.Company AND d1.rn = 1
             LEFT JOIN d d2 ON s.Company = d2.Company AND d2.rn = 2""",
        "fin_sup",
        "fin_series",
    ),
    "bt_walk_forward": sql(walk_sql("fin_series", "y", _WALK), "fin_series"),
    "bt_walk_forward_strict": sql(walk_sql("fin_series", "l.Revenues", _WALK), "fin_series"),
    "bt_walk_forward_sparse": sql(walk_sql("fin_sparse", "y", _WALK), "fin_sparse"),
    "bt_walk_forward_rows": sql(_walk_rows_sql("fin_sparse") + _WALK_ROWS, "fin_sparse"),
    "norm_aliases": sql(
        """SELECT Company, 'Revenues' AS "KPI", Revenues AS actual, arima_naive, xgb_point, "Date" AS target_date,
             "year", "quarter", NULL::DOUBLE AS arima_drift FROM fin_pred""",
        "fin_pred",
    ),
    "norm_finalize": sql(
        """SELECT 'Unknown' AS Company, 'Revenues' AS "KPI", CASE WHEN "quarter" <> 2 THEN "Date" END AS "Date",
             CASE WHEN "quarter" <> 2 THEN "year" END AS "year", CASE WHEN "quarter" <> 2 THEN "quarter" END AS "quarter", "month",
             Revenues, xgb_point,
             arima_naive, NULL::DOUBLE AS arima_drift, OperatingExpenses, GrossProfit, Assets, StockholdersEquity,
             lag_1, lag_2, diff_1, growth_1, mean_2, "month" AS extra FROM fin_pred""",
        "fin_pred",
    ),
    "norm_year_quarter": sql(
        """SELECT 'label' AS source, Company, "Date", CASE WHEN "quarter" < 4 THEN CAST("year" + 20 AS INTEGER) END AS "year",
             CASE WHEN "quarter" < 4 THEN "quarter" END AS "quarter" FROM fin_pred
           UNION ALL SELECT 'target', Company, "Date", "year", "quarter" FROM fin_pred
           UNION ALL SELECT 'date', Company, "Date", "year", "quarter" FROM fin_pred""",
        "fin_pred",
    ),
    "proj_answer_key": sql(
        """SELECT Company, "Date", replace(concat(Company, '_', 'Total Revenues', '_', "year", 'Q', "quarter", '.json'), ' ', '_')
             AS answer_key FROM fin_pred""",
        "fin_pred",
    ),
}
