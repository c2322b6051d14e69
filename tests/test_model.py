import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarterwise.operators import features, model
from quarterwise.spec import PanelSpec

FEW = model.TreeParams(3, 3, 0.5)


def test_settings():
    assert (model.REGULAR.trees, model.REGULAR.depth, model.REGULAR.rate, model.REGULAR.seed) == (600, 4, 0.05, 42)
    assert model.SMALL_LAST_ROW.trees == 100


def _panel(spark, n=12, companies=6):
    rows = []
    for c in range(companies):
        for i in range(n):
            d = dt.date(2000 + i // 4, 3 * (i % 4) + 1, 1)
            rows.append((f"c{c}", d, 100.0 * (c + 1) + 10 * i, float(i) if i else None))
    return spark.createDataFrame(rows, "Company string, Date date, Revenues double, Assets double")


@pytest.fixture(scope="module")
def fitted(spark):
    feats = features.timeseries_features(_panel(spark))
    return feats, model.train(feats, "Revenues", ["lag_1", "lag_2", "Assets", "absent"], FEW)


def test_rows_without_a_feature_keep_null(fitted):
    feats, trained = fitted
    assert trained.features == ("lag_1", "lag_2", "Assets") and trained.n_rows == 60
    out = model.predict(feats, trained)
    assert out.columns == [*feats.columns, "xgb_point"]
    assert out.where("xgb_point is null").count() == out.where("lag_2 is null or Assets is null").count() == 12


def test_incomplete_rows_are_forecast_on_request(fitted):
    feats, trained = fitted
    assert model.predict(feats, trained, complete_only=False).where("xgb_point is null").count() == 0


def test_held_out_rows_are_not_trained_on(fitted):
    feats, trained = fitted
    assert trained.n_rows == 60
    for fraction in (0.2, 0.5):
        held = model.train(feats, "Revenues", ["lag_1", "lag_2", "Assets"], FEW, ["Company", "Date"], fraction)
        out = model.held_out(feats, ["Company", "Date"], fraction).na.drop(subset=["lag_1", "lag_2", "Assets", "Revenues"])
        assert held.n_rows + out.count() == 60 and held.params == FEW


def test_too_few_rows_are_an_error_that_names_another_setting(fitted):
    feats, _ = fitted
    four = feats.limit(4).fillna(1.0)
    with pytest.raises(ValueError, match="SMALL"):
        model.train(four, "Revenues", ["lag_1"], FEW)
    assert model.train(four, "Revenues", ["lag_1"], FEW, min_rows=1).n_rows == 4
    with pytest.raises(ValueError, match="0 complete rows"):
        model.train(four.limit(0), "Revenues", ["lag_1"], model.by_rows())


def test_settings_by_rows(fitted):
    small = model.TreeParams(2, 2, 0.1)
    choose = model.by_rows(small, regular=FEW)
    assert [choose(n, 11) for n in (1, 4, 5, 100)] == [small, small, FEW, FEW]
    assert [model.by_rows(small, features_too=True, regular=FEW)(n, 11) for n in (5, 11, 12)] == [small, small, FEW]
    assert (model.by_rows()(4, 3), model.by_rows(model.SMALL)(4, 3), model.by_rows()(5, 3)) == (model.SMALL_LAST_ROW, model.SMALL, model.REGULAR)
    feats, _ = fitted
    trained = model.train(feats.limit(4).fillna(1.0), "Revenues", ["lag_1"], choose)
    assert trained.params == small and len(trained.boosted.trees) == 2 and model.train(feats, "Revenues", ["lag_1"], choose).params == FEW


def test_a_formula_is_learned(spark):
    rows = [(f"c{i % 7}", float(i % 50), float((i * 7) % 13), 3.0 * (i % 50) + 10.0 * ((i * 7) % 13 > 6)) for i in range(700)]
    df = spark.createDataFrame(rows, "Company string, lag_1 double, lag_2 double, Revenues double")
    trained = model.train(df, "Revenues", ["lag_1", "lag_2"], model.TreeParams(40, 4, 0.3))
    errs = model.predict(df, trained).selectExpr("avg(abs(Revenues - xgb_point)) e", "avg(abs(Revenues - 77.2)) spread").first()
    assert errs.e < 3 < errs.spread / 10


def test_running_sums(frame):
    for n in (1, 2, 7, 16, 23):
        values = [float(i * i % 7) - 2 for i in range(n)]
        got = frame("a array<double>", (values,)).select(model.running_sums(F.col("a"), n)).first()[0]
        assert got == pytest.approx([sum(values[: i + 1]) for i in range(n)])


def test_learning_curve_has_the_errors_of_every_round(spark):
    rows = [(f"c{i % 7}", float(i % 50), None if i % 40 == 3 else float((i * 7) % 13), 3.0 * (i % 50) + 10.0 * ((i * 7) % 13 > 6)) for i in range(300)]
    df = spark.createDataFrame(rows, "Company string, lag_1 double, lag_2 double, Revenues double")
    trained = model.train(df, "Revenues", ["lag_1", "lag_2"], model.TreeParams(13, 3, 0.3))
    curve = {r["round"]: r for r in model.learning_curve(trained, df, "Revenues").collect()}
    assert sorted(curve) == list(range(1, 14)) and {r.n_rows for r in curve.values()} == {292}
    complete = model.assembler(["lag_1", "lag_2"]).transform(df.na.drop().withColumn("label", F.col("Revenues")))
    squared = trained.boosted.evaluateEachIteration(complete, "squared")
    absolute = trained.boosted.evaluateEachIteration(complete, "absolute")
    assert [curve[i].rmse ** 2 for i in sorted(curve)] == pytest.approx(squared)
    assert [curve[i].mae for i in sorted(curve)] == pytest.approx(absolute)
    assert curve[13].mae < curve[1].mae / 3
    last = model.predict(df.na.drop(), trained).selectExpr("avg(abs(Revenues - xgb_point)) e").first().e
    assert curve[13].mae == pytest.approx(last)


def test_bins_give_the_same_model_where_they_tell_all_values_apart(spark):
    rows = [(f"c{i % 7}", float(i % 50), float((i * 7) % 13), 3.0 * (i % 50) + 10.0 * ((i * 7) % 13 > 6)) for i in range(300)]
    df = spark.createDataFrame(rows, "Company string, lag_1 double, lag_2 double, Revenues double")
    used, params = ["lag_1", "lag_2"], model.TreeParams(5, 3, 0.3, 1.0, 1.0)
    stored = model.complete_rows(df, "Revenues", used)
    bins = model.fit_bins(stored, used)
    numbers = [F.col("__bin_" + c).alias("__bin_" + c, metadata={}) for c in used]
    binned = model.fit(bins.transform(stored).select("label", *numbers), used, params, bins=bins)
    plain = model.fit(stored, used, params)
    keys = [F.col(c) for c in df.columns]
    scored = [sorted(map(tuple, model.predict(df, m).select(*keys, F.round("xgb_point", 6)).collect())) for m in (binned, plain)]
    assert scored[0] == scored[1]
    # values beyond the outer edges, and gaps, are forecast as well
    far = spark.createDataFrame([("x", -1e9, 1e9, 0.0), ("y", 1e9, None, 0.0)], df.schema)
    assert model.predict(far, binned, complete_only=False).where("xgb_point is null").count() == 0


def test_walk_forward_shares_bins_and_stops_on_leakage(spark):
    panel = _panel(spark)
    sup = features.supervised(panel, label_date=True)
    folds = [("2001-10-01", "2002-01-01"), ("2002-04-01", "2002-07-01")]
    out = model.run_walk_forward(panel, sup, folds, ["lag_1", "lag_2"], as_written=True, params=FEW, concurrent=2)
    assert out.count() == 12 and out.where("xgb_point is null").count() == 0
    with pytest.raises(AssertionError, match="label_date: 6 rows for 2002-01-01"):
        model.run_walk_forward(panel, sup, folds, ["lag_1"], params=FEW)
    with pytest.raises(AssertionError, match="not evaluated"):
        model.run_walk_forward(panel, sup.drop("label_date"), folds, ["lag_1"], params=FEW)
    with pytest.raises(AssertionError, match="not after"):
        model.run_walk_forward(panel, sup, [("2002-01-01", "2002-01-01")], ["lag_1"], as_written=True, params=FEW)
    with pytest.raises(ValueError, match="no folds"):
        model.run_walk_forward(panel, sup, [], ["lag_1"], params=FEW)
    # an error of one fold reaches the caller
    with pytest.raises(ValueError, match="0 complete rows"):
        model.run_walk_forward(panel, sup, [*folds, ("1999-01-01", "1999-04-01")], ["lag_1"], as_written=True, params=FEW)


def test_walk_forward_equals_single_folds(spark):
    panel = _panel(spark)
    sup = features.supervised_strict(panel)
    folds = [("2001-10-01", "2002-01-01"), ("2002-04-01", "2002-07-01")]
    many = model.run_walk_forward(panel, sup, folds, ["lag_1", "lag_2"], strict=True, params=FEW)
    assert many.groupBy("Date").count().count() == 2
    for end, test in folds:
        one = model.run_backtest(panel, sup, end, test, ["lag_1", "lag_2"], strict=True, params=FEW)
        columns = ["Company", "actual", "arima_naive", F.round("xgb_point", 6)]
        assert sorted(map(tuple, one.select(*columns).collect())) == sorted(
            map(tuple, many.where(f"Date = date'{test}'").select(*columns).collect())
        )


def test_backtest_runs_and_checks_first(spark):
    panel = _panel(spark)
    sup = features.supervised_strict(panel)
    out = model.run_backtest(panel, sup, "2002-04-01", "2002-07-01", ["lag_1", "lag_2"], PanelSpec(), strict=True, params=FEW)
    rows = out.collect()
    assert len(rows) == 6 and all(r.actual == r.arima_drift for r in rows)
    with pytest.raises(ValueError, match="0 complete rows"):
        model.run_backtest(panel, sup, "1999-01-01", "2002-07-01", ["lag_1"], as_written=True, params=FEW)
