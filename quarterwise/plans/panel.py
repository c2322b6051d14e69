"""Registered queries: cleaning, features, splits, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterwise.functions.calendar import quarter_end
from quarterwise.operators import clean, features, splits
from quarterwise.plans import views as v
from quarterwise.plans.sql import sql
from quarterwise.session import materialise
from quarterwise.spec import MODEL_FEATURES, PanelSpec

_SERIES = 'Company, "Date", Revenues, OperatingExpenses, GrossProfit, Assets, StockholdersEquity'
_RATES = 'lag_1, lag_2, diff_1, growth_1, mean_2'
_SUP = f'Company, "Date", "year", "quarter", "month", {_RATES}, OperatingExpenses, GrossProfit, Assets, StockholdersEquity, y_next'


def clean_panel(spark, sf):
    return clean.clean_panel(v.fin_raw(spark, sf))


def clean_drop_null_rows(spark, sf):
    pair = clean.clean_panel(v.fin_raw(spark, sf)).select("Revenues", "StockholdersEquity")
    return clean.drop_null_rows(pair)


def clean_drop_null_cols(spark, sf):
    # Liabilities is not in the input, so it comes out of cleaning without any value
    wide = PanelSpec(exog=(*PanelSpec().exog, "Liabilities"))
    return clean.drop_null_columns(materialise(clean.clean_panel(v.fin_raw(spark, sf), wide), "clean"))


def union_companies(spark, sf):
    panel = v.panel(spark, sf)
    with_kpi = panel.where(F.col("Revenues").isNotNull()).select("Company", "Date", "Revenues", "Assets")
    without = panel.where(F.col("Revenues").isNull()).select("Company", "Date", "GrossProfit")
    return clean.union_entities(
        [clean.tag_entity(with_kpi, "reported", "Sheet"), clean.tag_entity(without, "unreported", "Sheet")], "Sheet"
    )


def filter_complete_case(spark, sf):
    return clean.complete_cases(v.fin_series(spark, sf), ["Revenues", "StockholdersEquity"])


def profile_nonnull(spark, sf):
    return clean.nonnull_profile(v.fin_series(spark, sf))


def feat_timeseries(spark, sf):
    return features.timeseries_features(v.fin_series(spark, sf)).drop("arima_naive", "arima_drift")


def feat_baselines(spark, sf):
    out = features.timeseries_features(v.fin_series(spark, sf))
    return out.select("Company", "Date", "Revenues", "lag_1", "lag_2", "arima_naive", "arima_drift")


def feat_supervised(spark, sf):
    return features.supervised(v.fin_series(spark, sf))


def feat_supervised_strict(spark, sf):
    return features.supervised_strict(v.fin_series(spark, sf))


def feat_last_row(spark, sf):
    return features.last_row_features(v.fin_series(spark, sf))


def feat_last_row_sparse(spark, sf):
    return features.last_row_features(v.fin_sparse(spark, sf), v.SPARSE)


def feat_timeseries_sparse(spark, sf):
    return features.timeseries_features(v.fin_sparse(spark, sf), v.SPARSE)


def feat_timeseries_sliced(spark, sf):
    """The same features where histories are declared long: slices by year."""
    spec = PanelSpec(exog=(), slice_unit="year")
    return features.timeseries_features(v.sparse_panel(spark, sf), spec)


def feat_timeseries_by_position(spark, sf):
    """The same features with slices cut by stored position."""
    spec = PanelSpec(exog=(), slice_unit="position")
    return features.timeseries_features(v.sparse_panel(spark, sf), spec)


def feat_leakage_contrast(spark, sf):
    return features.leakage_contrast(v.fin_series(spark, sf))


def feat_calendar(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("Date"))
    return features.add_calendar(orders).withColumns(
        {"date_text": F.date_format("Date", "yyyy-MM-dd"), "quarter_end": quarter_end(F.col("Date"))}
    )


def feature_coverage(spark, sf):
    sup = features.supervised(v.fin_series(spark, sf))
    return features.feature_coverage(sup)


def feature_present(spark, sf):
    """Rows complete in those of the asked features that the irregular panel has: it has no exogenous columns."""
    feats = features.timeseries_features(v.fin_sparse(spark, sf), v.SPARSE)
    found = features.present_features(feats, MODEL_FEATURES)
    return clean.complete_cases(feats.select("Company", "Date", *found), found)


def last_n_per_entity(spark, sf):
    return features.last_n(v.fin_sparse(spark, sf), 10, spec=v.SPARSE)


def preview_head(spark, sf):
    return features.preview(v.fin_series(spark, sf), ["Company", "Date"], 5)


def split_chronological(spark, sf):
    return splits.chronological_split(features.supervised(v.fin_series(spark, sf))).select("Company", "Date", "y_next", "split")


def split_chronological_sparse(spark, sf):
    return splits.chronological_split(v.fin_sparse(spark, sf), 0.8, v.SPARSE)


def split_head(spark, sf):
    rows = features.last_row_features(v.fin_sparse(spark, sf), v.SPARSE).select("Company", "Date", "Revenues")
    return splits.head_split(rows, ["Company"], 0.2)


def split_hash(spark, sf):
    return splits.hash_split(v.fin_series(spark, sf), ["Company", "Date"]).select("Company", "Date", "split")


QUERIES = {
    f.__name__: f
    for f in (
        clean_panel,
        clean_drop_null_rows,
        clean_drop_null_cols,
        union_companies,
        filter_complete_case,
        profile_nonnull,
        feat_timeseries,
        feat_timeseries_sparse,
        feat_timeseries_sliced,
        feat_timeseries_by_position,
        feat_baselines,
        feat_supervised,
        feat_supervised_strict,
        feat_last_row,
        feat_last_row_sparse,
        feat_leakage_contrast,
        feat_calendar,
        feature_coverage,
        feature_present,
        last_n_per_entity,
        preview_head,
        split_chronological,
        split_chronological_sparse,
        split_head,
        split_hash,
    )
}

_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count("{c}") AS n_filled,
        CAST(count("{c}") AS DOUBLE) / count(*) AS share_filled FROM fin_series"""
    for c in ("Company", "Date", "Revenues", "OperatingExpenses", "GrossProfit", "Assets", "StockholdersEquity")
)
_GATES = [("lag_1", None), ("month", None), ("year", None)]
_GATES += [(c, 0.5) for c in ("lag_2", "diff_1", "growth_1", "mean_2")]
_GATES += [(c, 0.7) for c in ("OperatingExpenses", "GrossProfit", "Assets", "StockholdersEquity")]
_COVERAGE = " UNION ALL ".join(
    f"""SELECT count(*) AS n_rows, CAST({i} AS INTEGER) AS "position", '{c}' AS feature, count("{c}") AS n_filled,
        CAST({'NULL' if g is None else g} AS DOUBLE) AS gate,
        {'TRUE' if g is None else f'count("{c}") > count(*) * {g}'} AS used FROM fin_sup"""
    for i, (c, g) in enumerate(_GATES)
)


def _last_row(source: str, carried: str) -> str:
    return f"""
    , filled AS (SELECT *, row_number() OVER d AS rn, count(*) OVER (PARTITION BY Company) AS n,
         lead(Revenues, 1) OVER d AS lag_1, lead(Revenues, 2) OVER d AS lag_2
       FROM {source} WHERE Revenues IS NOT NULL WINDOW d AS (PARTITION BY Company ORDER BY "Date" DESC))
    SELECT {carried}, lag_1, lag_2, Revenues - lag_1 AS diff_1, Revenues / nullif(lag_1, 0) - 1 AS growth_1,
      (Revenues + lag_1) / 2 AS mean_2, CAST(month("Date") AS INTEGER) AS "month", CAST(year("Date") AS INTEGER) AS "year",
      lag_1 AS arima_naive, lag_1 + (lag_1 - lag_2) AS arima_drift
    FROM filled WHERE rn = 1 AND n >= 3"""


ORACLE = {
    "clean_panel": sql("SELECT * FROM fin_clean", "fin_clean"),
    "clean_drop_null_rows": sql(
        "SELECT Revenues, StockholdersEquity FROM fin_clean WHERE Revenues IS NOT NULL OR StockholdersEquity IS NOT NULL",
        "fin_clean",
    ),
    "clean_drop_null_cols": sql("SELECT * FROM fin_clean", "fin_clean"),
    "union_companies": sql(
        """SELECT 'reported' AS Sheet, Company, "Date", Revenues, Assets, NULL::DOUBLE AS GrossProfit
           FROM fin_series WHERE Revenues IS NOT NULL
           UNION ALL SELECT 'unreported', Company, "Date", NULL, NULL, GrossProfit FROM fin_series WHERE Revenues IS NULL""",
        "fin_series",
    ),
    "filter_complete_case": sql(
        "SELECT * FROM fin_series WHERE Revenues IS NOT NULL AND StockholdersEquity IS NOT NULL", "fin_series"
    ),
    "profile_nonnull": sql(_PROFILE, "fin_series"),
    "feat_timeseries": sql(f'SELECT {_SERIES}, {_RATES}, "month", "year" FROM fin_feat', "fin_feat"),
    "feat_timeseries_sparse": sql(
        """, lags AS (SELECT *, lag(Revenues, 1) OVER w AS lag_1, lag(Revenues, 2) OVER w AS lag_2 FROM fin_sparse
             WINDOW w AS (PARTITION BY Company ORDER BY "Date"))
           SELECT *, Revenues - lag_1 AS diff_1, Revenues / nullif(lag_1, 0) - 1 AS growth_1, (Revenues + lag_1) / 2 AS mean_2,
             CAST(month("Date") AS INTEGER) AS "month", CAST(year("Date") AS INTEGER) AS "year",
             lag_1 AS arima_naive, lag_1 + (lag_1 - lag_2) AS arima_drift FROM lags""",
        "fin_sparse",
    ),
    "feat_baselines": sql(
        'SELECT Company, "Date", Revenues, lag_1, lag_2, arima_naive, arima_drift FROM fin_feat', "fin_feat"
    ),
    "feat_supervised": sql(f"SELECT {_SUP} FROM fin_sup", "fin_sup"),
    "feat_supervised_strict": sql(
        """, s AS (SELECT *, lag(OperatingExpenses) OVER w AS o1, lag(GrossProfit) OVER w AS g1, lag(Assets) OVER w AS a1,
               lag(StockholdersEquity) OVER w AS e1
             FROM fin_feat WINDOW w AS (PARTITION BY Company ORDER BY "Date"))
           SELECT Company, "Date", "year", "quarter", "month", lag_1, lag_2, lag_1 - lag_2 AS diff_1,
             lag_1 / nullif(lag_2, 0) - 1 AS growth_1, (lag_1 + lag_2) / 2 AS mean_2, o1 AS OperatingExpenses,
             g1 AS GrossProfit, a1 AS Assets, e1 AS StockholdersEquity, Revenues AS y_next, "Date" AS label_date
           FROM s WHERE Revenues IS NOT NULL""",
        "fin_feat",
    ),
    "feat_last_row": sql(_last_row("fin_series", _SERIES), "fin_series"),
    "feat_last_row_sparse": sql(_last_row("fin_sparse", 'Company, "Date", Revenues'), "fin_sparse"),
    "feat_leakage_contrast": sql(
        """SELECT Company, "Date", lag_1, Revenues AS target_same, y_next AS target_next,
             Revenues IS NOT NULL AS usable_same, y_next IS NOT NULL AS usable_next
           FROM fin_lags WHERE lag_1 IS NOT NULL""",
        "fin_lags",
    ),
    "feat_calendar": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "Date", CAST(month(o_orderdate) AS INTEGER) AS "month",
        CAST(year(o_orderdate) AS INTEGER) AS "year", CAST(quarter(o_orderdate) AS INTEGER) AS "quarter",
        strftime(o_orderdate, '%Y-%m-%d') AS date_text,
        CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end FROM orders""",
    "feature_coverage": sql(_COVERAGE, "fin_sup"),
    "feature_present": sql(
        """, l AS (SELECT Company, "Date", Revenues, lag(Revenues, 1) OVER w AS lag_1, lag(Revenues, 2) OVER w AS lag_2
             FROM fin_sparse WINDOW w AS (PARTITION BY Company ORDER BY "Date")),
           r AS (SELECT Company, "Date", lag_1, lag_2, Revenues - lag_1 AS diff_1, Revenues / nullif(lag_1, 0) - 1 AS growth_1,
             (Revenues + lag_1) / 2 AS mean_2, CAST(month("Date") AS INTEGER) AS "month", CAST(year("Date") AS INTEGER) AS "year" FROM l)
           SELECT * FROM r WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND diff_1 IS NOT NULL AND growth_1 IS NOT NULL AND mean_2 IS NOT NULL""",
        "fin_sparse",
    ),
    "last_n_per_entity": sql(
        """, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY Company ORDER BY "Date" DESC) AS INTEGER) AS rank_from_end
             FROM fin_sparse)
           SELECT Company, "Date", Revenues, rank_from_end FROM r WHERE rank_from_end <= 10""",
        "fin_sparse",
    ),
    "preview_head": sql('SELECT * FROM fin_series ORDER BY Company, "Date" LIMIT 5', "fin_series"),
    "split_chronological": sql(
        """SELECT Company, "Date", y_next, CASE WHEN row_number() OVER (ORDER BY "Date", Company)
             <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'val' END AS split FROM fin_sup""",
        "fin_sup",
    ),
    "split_chronological_sparse": sql(
        """SELECT *, CASE WHEN row_number() OVER (ORDER BY "Date", Company)
             <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'val' END AS split FROM fin_sparse""",
        "fin_sparse",
    ),
    "split_head": sql(
        """, r AS (SELECT *, row_number() OVER (PARTITION BY Company ORDER BY "Date" DESC) AS rn,
               count(*) OVER (PARTITION BY Company) AS n FROM fin_sparse),
           l AS (SELECT Company, "Date", Revenues FROM r WHERE rn = 1 AND n >= 3)
           SELECT *, CASE WHEN row_number() OVER (ORDER BY Company) <= greatest(1, floor(count(*) OVER () * 0.2))
             THEN 'val' ELSE 'train' END AS split FROM l""",
        "fin_sparse",
    ),
    "split_hash": sql(
        """SELECT Company, "Date", CASE WHEN substr(md5(concat(Company, '|', CAST("Date" AS VARCHAR))), 1, 8) < '33333333'
             THEN 'val' ELSE 'train' END AS split FROM fin_series""",
        "fin_series",
    ),
}
ORACLE["feat_timeseries_by_position"] = ORACLE["feat_timeseries_sliced"] = ORACLE["feat_timeseries_sparse"]
