"""Registered queries that train a model.

No SQL can give the forecasts themselves, so the queries return what SQL can tell: the rows that are
scored, what they are scored on, the baselines beside them, whether there is a forecast, and whether the
errors compare as they should: with the naive forecast's on held-out rows, with a constant's on the rows of the fit.
The backtest without leakage uses the regular setting of 600 trees, the others a shorter one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterwise.operators import features, model, splits
from quarterwise.operators.evaluate import pooled_metrics, prediction_interval
from quarterwise.plans import views as v
from quarterwise.plans.scoring import walk_sql
from quarterwise.plans.sql import sql
from quarterwise.session import materialise
from quarterwise.spec import MODEL_FEATURES

#: Fewer trees at a higher rate, for the queries that are about something else than the model's quality.
SHORT = model.TreeParams(20, 4, 0.3)
#: The regular trees, the first 100 of them, for the learning curve.
CURVE = model.TreeParams(100, 4, 0.05)
#: The first test date of the walk-forward, as a position among the panel's dates: lags need three rows before it.
FIRST_FOLD = 4


def _measured(metrics):
    """Rows, and whether the errors were measured."""
    return metrics.withColumn("measured", F.col("mae").isNotNull() & (F.col("rmse") >= F.col("mae"))).drop("mae", "rmse")


def _error(forecast, actual="actual"):
    return F.avg(F.abs(F.col(actual) - F.col(forecast)))


def _told(compared):
    """Whether there is a forecast, and whether forecasts are off by less than the naive ones over all rows."""
    kept = materialise(compared, "compared")
    better = kept.agg((_error("xgb_point") < _error("arima_naive")).alias("better"))
    return kept.withColumns({"has_forecast": F.col("xgb_point").isNotNull(), "beats_naive": better.scalar()}).drop("xgb_point")


def _split(spark, sf):
    split = materialise(splits.chronological_split(features.supervised(v.fin_series(spark, sf))), "split")
    return split.where("split = 'train'"), split.where("split = 'val'")


def ml_train_metrics(spark, sf):
    """The chronologically last fifth, scored by a model of the rows before."""
    train, val = _split(spark, sf)
    return _measured(model.train_and_validate(train, val, features.gated_features(train), params=SHORT)[1])


def ml_learning_curve(spark, sf):
    """Errors after every boosting round, on the rows of the fit and on held-out ones.

    Errors on the rows of the fit have to fall; whether the others do depends on the data, so they are not compared.
    """
    train, val = _split(spark, sf)
    fitted = model.train(train, "y_next", features.gated_features(train), CURVE)
    parts = []
    for name, rows in (("train", train), ("val", val)):
        curve = materialise(model.learning_curve(fitted, rows, "y_next"), "curve")
        fell = F.min_by("mae", "round") > F.max_by("mae", "round")
        ends = curve.agg((fell if name == "train" else F.lit(None).cast("boolean")).alias("fell"))
        parts.append(_measured(curve.withColumn("fell", ends.scalar())).withColumn("rows", F.lit(name)))
    return parts[0].unionByName(parts[1])


def ml_predict_masked(spark, sf):
    """Forecasts with intervals; rows with a missing feature keep NULL."""
    feats = materialise(features.timeseries_features(v.fin_series(spark, sf)), "features")
    fitted = model.train(feats, "Revenues", features.gated_features(feats), SHORT, holdout=["Company", "Date"])
    # an interval reads the forecasts twice
    scored = materialise(model.predict(feats, fitted), "scored")
    out = prediction_interval(scored, "Revenues", ["Company", "Date"])
    width = F.col("pi_upper") - F.col("xgb_point")
    known = scored.where(F.col("xgb_point").isNotNull() & F.col("Revenues").isNotNull())
    mean = known.agg(F.avg("Revenues").alias("m")).scalar()
    better = known.withColumn("m", mean).agg((_error("xgb_point", "Revenues") < _error("m", "Revenues")).alias("better"))
    return out.withColumn("better", better.scalar()).select(
        "Company",
        "Date",
        "Revenues",
        F.col("xgb_point").isNotNull().alias("has_forecast"),
        ((width > 0) & (F.col("pi_lower") < F.col("xgb_point"))).alias("has_interval"),
        F.col("better").alias("beats_constant"),
    )


def _supervised(spark, sf, strict):
    panel = v.panel(spark, sf)
    sup = materialise(features.supervised_strict(panel) if strict else features.supervised(panel, label_date=True), "supervised")
    return panel, sup, features.gated_features(sup.where(F.col("Date") <= v.TRAIN_END))


def ml_backtest(spark, sf):
    panel, sup, chosen = _supervised(spark, sf, strict=False)
    compared = model.run_backtest(panel, sup, v.TRAIN_END, v.TEST_DATE, chosen, as_written=True, params=SHORT)
    return _told(compared).drop("beats_naive")


def ml_backtest_strict(spark, sf):
    """Earlier rows only, with the regular setting."""
    panel, sup, chosen = _supervised(spark, sf, strict=True)
    return _told(model.run_backtest(panel, sup, v.TRAIN_END, v.TEST_DATE, chosen, strict=True))


def ml_walk_forward(spark, sf):
    """Every date of the panel from the fifth on, scored by a model of the rows up to the date before."""
    panel, sup, chosen = _supervised(spark, sf, strict=False)
    dates = v.panel_dates(panel)
    folds = list(zip(dates[FIRST_FOLD - 1 :], dates[FIRST_FOLD:]))
    out = model.run_walk_forward(panel, sup, folds, chosen, as_written=True, params=SHORT, min_rows=1)
    return _measured(pooled_metrics(out, by=["Date"]))


QUERIES = {f.__name__: f for f in (ml_train_metrics, ml_learning_curve, ml_predict_masked, ml_backtest, ml_backtest_strict, ml_walk_forward)}

# the features that pass their gates: all but the sparse ones and the calendar, which is never NULL
_SPARSE = ("StockholdersEquity",)
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in MODEL_FEATURES if c not in (*_SPARSE, "month", "year"))
ORACLE = {
    "ml_train_metrics": sql(
        f""", s AS (SELECT *, row_number() OVER (ORDER BY "Date", Company) AS rn, count(*) OVER () AS n FROM fin_sup)
            SELECT count(*) FILTER (WHERE rn > floor(n * 0.8) AND {_COMPLETE}) AS n_rows, TRUE AS measured FROM s""",
        "fin_sup",
    ),
    "ml_learning_curve": sql(
        f""", s AS (SELECT *, row_number() OVER (ORDER BY "Date", Company) AS rn, count(*) OVER () AS n FROM fin_sup),
            k AS (SELECT CASE WHEN rn > floor(n * 0.8) THEN 'val' ELSE 'train' END AS rows, count(*) AS n_rows FROM s WHERE {_COMPLETE} GROUP BY 1)
            SELECT CAST(r AS INTEGER) AS "round", n_rows, CASE WHEN rows = 'train' THEN TRUE END AS fell, TRUE AS measured, rows
            FROM k, generate_series(1, {CURVE.trees}) g(r)""",
        "fin_sup",
    ),
    "ml_predict_masked": sql(
        f"""SELECT Company, "Date", Revenues, {_COMPLETE} AS has_forecast, CASE WHEN {_COMPLETE} THEN TRUE END AS has_interval,
              TRUE AS beats_constant FROM fin_feat""",
        "fin_feat",
    ),
    "ml_backtest": sql("SELECT *, TRUE AS has_forecast FROM fin_compare", "fin_compare"),
    "ml_backtest_strict": sql(
        """SELECT t.Company, t."Date", s.Revenues AS actual, t.lag_1 AS arima_naive, t.lag_1 + t.diff_1 AS arima_drift,
             TRUE AS has_forecast, TRUE AS beats_naive
           FROM fin_test t JOIN fin_series s ON t.Company = s.Company AND t."Date" = s."Date" WHERE s.Revenues IS NOT NULL""",
        "fin_test",
    ),
    "ml_walk_forward": sql(
        walk_sql("fin_series", "y", 'SELECT test_date AS "Date", count(*) AS n_rows, TRUE AS measured FROM c GROUP BY 1', first=FIRST_FOLD),
        "fin_series",
    ),
}
