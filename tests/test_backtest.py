import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarterwise.operators import backtest, features
from quarterwise.spec import PanelSpec

SCHEMA = "Company string, Date date, Revenues double, Assets double"
D = [dt.date(2000, 3, 31), dt.date(2000, 6, 30), dt.date(2000, 9, 30), dt.date(2000, 12, 31)]


def _panel(frame):
    return frame(
        SCHEMA,
        *[("full", d, 10.0 * (i + 1), float(i)) for i, d in enumerate(D)],
        ("one_row", D[0], 1.0, 1.0),
        ("null_last", D[0], 1.0, 1.0),
        ("null_last", D[1], 2.0, 1.0),
        ("null_last", D[2], None, 1.0),
        ("zero", D[0], 0.0, 1.0),
        ("zero", D[1], 4.0, 7.0),
        ("zero", None, 99.0, 1.0),
        (None, D[0], 1.0, 1.0),
        (None, D[1], 1.0, 1.0),
    )


def test_test_rows_skip_short_and_null_histories(frame):
    got = {r.Company: r for r in backtest.test_rows(_panel(frame), "2000-12-31").collect()}
    assert set(got) == {"full", "zero"}
    assert (got["full"].lag_1, got["full"].lag_2, got["full"].diff_1, got["full"].Assets) == (30.0, 20.0, 10.0, 2.0)
    assert (got["full"].Date, got["full"].quarter, got["full"].month) == (D[3], 4, 12)
    assert got["zero"].growth_1 is None and got["zero"].Assets == 7.0


def test_asof_is_strictly_before(frame):
    got = {r.Company: r.asof_date for r in backtest.asof_rows(_panel(frame), "2000-09-30", ["Assets"]).collect()}
    assert got["full"] == D[1] and got["one_row"] == D[0]


def test_leakage_report_and_guard(frame):
    panel = _panel(frame)
    sup = features.supervised(panel, label_date=True)
    tests = backtest.test_rows(panel, "2000-12-31")
    clean = {r["check"]: r for r in backtest.leakage_report(backtest.training_rows(sup, "2000-09-30"), tests, "2000-09-30", "2000-12-31").collect()}
    assert clean["train_date"].violations == 0 and clean["test_date"].violations == 0
    # the label of the last training row is the value at the test date
    assert clean["label_date"].violations == 1 and clean["label_date"].last_date == D[3]
    strict = backtest.training_rows(sup, "2000-09-30", strict=True)
    report = backtest.leakage_report(strict, tests, "2000-09-30", "2000-12-31")
    assert report.where("check = 'label_date'").first().violations == 0
    backtest.require_no_leakage(report)
    loose = backtest.leakage_report(backtest.training_rows(sup, "2000-09-30"), tests, "2000-09-30", "2000-12-31")
    with pytest.raises(AssertionError, match="label_date: 1 rows"):
        backtest.require_no_leakage(loose)
    backtest.require_no_leakage(loose, backtest.AS_WRITTEN_CHECKS)
    with pytest.raises(AssertionError, match="train_date"):
        backtest.require_no_leakage(backtest.leakage_report(sup, tests, "2000-01-31", "2000-12-31"))


def test_leakage_report_tells_labels_in_the_test_rows(frame):
    panel = _panel(frame)
    sup = features.supervised(panel)
    got = {r["check"]: r.violations for r in backtest.leakage_report(sup, sup, "2000-12-31", "2000-06-30").collect()}
    assert got["y_next_in_test"] == sup.count() and got["test_date"] > 0
    assert got["label_date"] is None  # without the labels' dates the check is not made


def test_a_check_that_was_not_made_stops_the_backtest(frame):
    panel = _panel(frame)
    tests = backtest.test_rows(panel, "2000-12-31")
    rows = backtest.training_rows(features.supervised(panel), "2000-09-30")
    report = backtest.leakage_report(rows, tests, "2000-09-30", "2000-12-31")
    assert {r["check"]: r.evaluated for r in report.collect()}["label_date"] is False
    with pytest.raises(AssertionError, match="label_date: not evaluated"):
        backtest.require_no_leakage(report)


def test_compare_needs_both_sides(frame):
    panel = _panel(frame)
    rows = backtest.naive_drift(backtest.test_rows(panel, "2000-09-30"))
    truth = backtest.actuals(features.supervised(panel), panel, ["2000-09-30"])
    got = backtest.compare(rows, truth, ["arima_naive", "arima_drift"]).collect()
    assert [tuple(r) for r in got] == [("full", D[2], 40.0, 20.0, 30.0)]
    strict = backtest.compare(rows, backtest.actuals(None, panel, ["2000-09-30"], actual="at_test_date"), ["arima_naive"])
    assert [tuple(r) for r in strict.collect()] == [("full", D[2], 30.0, 20.0)]


def test_unknown_actual(frame):
    with pytest.raises(ValueError):
        backtest.actuals(None, _panel(frame), ["2000-09-30"], actual="other")


def test_history_report(frame):
    panel = _panel(frame)
    sup = features.supervised(panel)
    got = {r.Company: r for r in backtest.history_report(panel, sup, "2000-09-30", "2000-12-31").collect()}
    assert set(got) == {"full", "null_last", "zero"}
    assert (got["null_last"].n_before, got["null_last"].n_filled, got["null_last"].enough) == (3, 2, True)
    assert (got["full"].last_date, got["full"].second_last_date) == (D[2], D[1])


def test_walk_forward_equals_one_fold_at_a_time(spark):
    rnd = random.Random(11)
    rows = {}
    for i in range(30):
        for _ in range(rnd.randint(0, 9)):
            d = dt.date(rnd.randint(1998, 2001), rnd.randint(1, 12), 28)
            rows[(f"c{i}", d)] = (f"c{i}", d, None if rnd.random() < 0.2 else rnd.choice([0.0, rnd.random()]), rnd.random())
    panel = spark.createDataFrame(list(rows.values()), SCHEMA)
    dates = ["1998-05-01", "1999-01-28", "1999-02-01", "2000-12-31", "2001-06-30", "2002-01-01"]
    many = backtest.walk_forward_rows(panel, dates)
    single = None
    for d in dates:
        one = backtest.test_rows(panel, d)
        single = one if single is None else single.unionByName(one)
    single = single.select(*many.columns)
    assert many.count() == single.count() > 0
    assert many.exceptAll(single).count() == 0


def test_walk_forward_needs_dates(frame):
    with pytest.raises(ValueError):
        backtest.walk_forward_rows(_panel(frame), [])


def test_strict_rows_use_earlier_rows_only(frame):
    panel = _panel(frame).where("Company = 'full'")
    rows = {r.Date: r for r in features.supervised_strict(panel).collect()}
    assert (rows[D[3]].lag_1, rows[D[3]].diff_1, rows[D[3]].y_next, rows[D[3]].Assets) == (30.0, 10.0, 40.0, 2.0)
    changed = panel.withColumn("Assets", F.when(F.col("Date") == F.lit(D[3]), 1e6).otherwise(F.col("Assets")))
    assert features.supervised_strict(changed).exceptAll(features.supervised_strict(panel)).count() == 0


def test_coverage_gates(frame):
    df = frame(
        "lag_1 double, month int, year int, lag_2 double, diff_1 double, growth_1 double, mean_2 double, Assets double",
        (None, 1, 1, 1.0, None, 1.0, 1.0, 1.0),
        (None, 1, 1, 1.0, 1.0, None, 1.0, None),
    )
    assert features.gated_features(df) == ["lag_1", "month", "year", "lag_2", "mean_2"]


def test_present_features(frame):
    assert features.present_features(frame("a int, b int"), ["b", "z"]) == ["b"]
    with pytest.raises(ValueError):
        features.present_features(frame("a int"), ["z"])


def test_spec_names_are_parameters(frame):
    panel = frame("shop string, day date, sales double", *[("s", d, float(i)) for i, d in enumerate(D)])
    spec = PanelSpec(entity="shop", time="day", kpi="sales", exog=())
    assert [r.y_next for r in features.supervised(panel, spec).orderBy("day").collect()] == [1.0, 2.0, 3.0]
    assert backtest.test_rows(panel, "2000-12-31", spec).first().lag_1 == 2.0
