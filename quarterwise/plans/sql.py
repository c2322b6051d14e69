"""The same views as SQL text, for checking results with another engine."""

from __future__ import annotations

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "per_order": (
        (),
        """SELECT l_orderkey,
             sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS opex,
             sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS gross,
             sum(CAST(l_quantity AS DECIMAL(12,2))) AS assets,
             sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS equity
           FROM lineitem GROUP BY l_orderkey""",
    ),
    "fin_grouped": (
        ("per_order",),
        """SELECT n_nationkey AS k, n_name AS Company,
             CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "Date",
             sum(CAST(o_totalprice AS DECIMAL(12,2))) AS rev,
             sum(opex) AS opex, sum(gross) AS gross, sum(assets) AS assets, sum(equity) AS equity
           FROM orders LEFT JOIN per_order ON o_orderkey = l_orderkey
             JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           GROUP BY 1, 2, 3""",
    ),
    "fin_numbered": (
        ("fin_grouped",),
        """SELECT *, (year("Date") - 1995) * 4 + quarter("Date") - 1 AS qi FROM fin_grouped""",
    ),
    "fin_series": (
        ("fin_numbered",),
        """SELECT Company, "Date",
             CASE WHEN (k * 31 + qi) % 13 = 0 THEN NULL WHEN (k * 31 + qi) % 17 = 0 THEN 0.0
                  ELSE CAST(rev AS DOUBLE) END AS Revenues,
             CAST(opex AS DOUBLE) AS OperatingExpenses, CAST(gross AS DOUBLE) AS GrossProfit,
             CAST(assets AS DOUBLE) AS Assets,
             CASE WHEN (k + qi) % 5 >= 2 THEN CAST(equity AS DOUBLE) END AS StockholdersEquity
           FROM fin_numbered""",
    ),
    "fin_lags": (
        ("fin_series",),
        """SELECT *, lag(Revenues, 1) OVER w AS lag_1, lag(Revenues, 2) OVER w AS lag_2,
             lead(Revenues, 1) OVER w AS y_next, lead("Date", 1) OVER w AS label_date
           FROM fin_series WINDOW w AS (PARTITION BY Company ORDER BY "Date")""",
    ),
    "fin_feat": (
        ("fin_lags",),
        """SELECT *, Revenues - lag_1 AS diff_1, Revenues / nullif(lag_1, 0) - 1 AS growth_1,
             (Revenues + lag_1) / 2 AS mean_2,
             CAST(month("Date") AS INTEGER) AS "month", CAST(year("Date") AS INTEGER) AS "year",
             CAST(quarter("Date") AS INTEGER) AS "quarter",
             lag_1 AS arima_naive, lag_1 + (lag_1 - lag_2) AS arima_drift
           FROM fin_lags""",
    ),
    "fin_sup": (("fin_feat",), "SELECT * FROM fin_feat WHERE y_next IS NOT NULL"),
    "fin_pred": (
        ("fin_feat",),
        "SELECT *, CAST(0.7 AS DOUBLE) * lag_1 + CAST(0.3 AS DOUBLE) * lag_2 AS xgb_point FROM fin_feat",
    ),
    "fin_sparse": (
        (),
        """SELECT c_name AS Company,
             CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "Date",
             CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS Revenues
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    ),
    "fin_facts": (
        (),
        """SELECT concat('U', user_id) AS Company, event_type AS tag,
             CASE event_id % 5 WHEN 0 THEN '10-K' WHEN 4 THEN '8-K' ELSE '10-Q' END AS form,
             CAST(ts AS DATE) AS end_dt, "value",
             CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'USD' ELSE 'USD/shares' END
                  WHEN event_id % 7 = 0 THEN 'EUR' ELSE 'USD' END AS uom,
             concat(lpad(CAST(user_id AS VARCHAR), 10, '0'), '-24-', lpad(CAST(day(ts) AS VARCHAR), 6, '0')) AS accn,
             event_id AS ord
           FROM events""",
    ),
    "fin_kept": (
        ("fin_facts",),
        """SELECT * FROM fin_facts WHERE form IN ('10-Q', '10-K') AND end_dt IS NOT NULL AND "value" IS NOT NULL
             AND accn IS NOT NULL
             AND CASE WHEN tag = 'signup' THEN contains(lower(uom), 'share') ELSE uom = 'USD' END""",
    ),
    "fin_filings": (
        ("fin_facts",),
        """SELECT DISTINCT Company, form, strftime(end_dt, '%Y-%m-%d') AS filingDate,
             strftime(end_dt, '%Y-%m-%d') AS reportDate, accn AS accessionNumber FROM fin_facts""",
    ),
    "fin_allowed": (
        ("fin_filings",),
        """SELECT *, replace(accessionNumber, '-', '') AS accn_stripped FROM fin_filings
           WHERE form IN ('10-Q', '10-K') AND CAST(filingDate AS DATE) >= DATE '2024-01-21'""",
    ),
    "fin_allowed_facts": (
        ("fin_kept", "fin_allowed"),
        """SELECT *, replace(accn, '-', '') AS accn_stripped FROM fin_kept
           WHERE replace(accn, '-', '') IN (SELECT accn_stripped FROM fin_allowed)""",
    ),
    "fin_raw": (
        ("fin_series",),
        """SELECT Company,
             CASE WHEN ((year("Date") - 1995) * 4 + quarter("Date") - 1) % 9 = 8 THEN 'not-a-date'
                  ELSE strftime("Date", '%Y-%m-%d') END AS "Date",
             coalesce(CAST(Revenues AS VARCHAR), 'N/A') AS Revenues,
             coalesce(CAST(OperatingExpenses AS VARCHAR), 'N/A') AS OperatingExpenses,
             coalesce(CAST(GrossProfit AS VARCHAR), 'N/A') AS GrossProfit,
             coalesce(CAST(Assets AS VARCHAR), 'N/A') AS Assets,
             coalesce(CAST(StockholdersEquity AS VARCHAR), 'N/A') AS StockholdersEquity
           FROM fin_series""",
    ),
    "fin_clean": (
        ("fin_raw",),
        """SELECT Company, TRY_CAST("Date" AS DATE) AS "Date",
             TRY_CAST(Revenues AS DOUBLE) AS Revenues,
             TRY_CAST(OperatingExpenses AS DOUBLE) AS OperatingExpenses,
             TRY_CAST(GrossProfit AS DOUBLE) AS GrossProfit, TRY_CAST(Assets AS DOUBLE) AS Assets,
             TRY_CAST(StockholdersEquity AS DOUBLE) AS StockholdersEquity
           FROM fin_raw""",
    ),
    "past_two": (
        ("fin_series",),
        """SELECT *, row_number() OVER (PARTITION BY Company ORDER BY "Date" DESC) AS rn
           FROM fin_series WHERE "Date" < DATE '2001-03-31'""",
    ),
    "fin_test": (
        ("past_two",),
        """SELECT a.Company, DATE '2001-03-31' AS "Date", a.Revenues AS lag_1, b.Revenues AS lag_2,
             a.Revenues - b.Revenues AS diff_1, a.Revenues / nullif(b.Revenues, 0) - 1 AS growth_1,
             (a.Revenues + b.Revenues) / 2 AS mean_2,
             CAST(2001 AS INTEGER) AS "year", CAST(1 AS INTEGER) AS "quarter", CAST(3 AS INTEGER) AS "month",
             a.OperatingExpenses, a.GrossProfit, a.Assets, a.StockholdersEquity
           FROM past_two a JOIN past_two b ON a.Company = b.Company AND a.rn = 1 AND b.rn = 2
           WHERE a.Revenues IS NOT NULL AND b.Revenues IS NOT NULL""",
    ),
    "fin_compare": (
        ("fin_test", "fin_sup"),
        """SELECT t.Company, t."Date", s.y_next AS actual, t.lag_1 AS arima_naive, t.lag_1 + t.diff_1 AS arima_drift
           FROM fin_test t JOIN fin_sup s ON t.Company = s.Company AND t."Date" = s."Date" """,
    ),
}


def sql(body: str, *views: str) -> str:
    """`body` with the named views, and those they rest on, put in front as CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in _VIEWS[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n{_VIEWS[n][1]}\n)" for n in ordered) + "\n" + body
