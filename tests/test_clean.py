import datetime as dt

import pytest

from quarterwise.functions import calendar
from quarterwise.operators import clean, normalise
from quarterwise.operators.normalise import (
    answer_key,
    finalise,
    normalise_predictions,
    rename_aliases,
    require_columns,
    resolve_year_quarter,
)
from quarterwise.spec import PanelSpec
from pyspark.sql import functions as F


def test_clean_panel_types(frame):
    raw = frame("Company string, Date string, Revenues string", ("a", "2000-03-31", "1.5"), ("a", "oops", "N/A"), ("a", None, "1.5d"), ("a", "2000-06-30", "NaN"))
    out = clean.clean_panel(raw)
    assert dict(out.dtypes)["Date"] == "date" and dict(out.dtypes)["Assets"] == "double"
    got = {(r.Date, r.Revenues) for r in out.collect()}
    assert got == {(dt.date(2000, 3, 31), 1.5), (None, None), (dt.date(2000, 6, 30), None)}


def test_strict_dates_stop_the_job(frame):
    raw = frame("Company string, Date string, Revenues string", ("a", "oops", "1"))
    with pytest.raises(Exception, match="not a date: oops"):
        clean.clean_panel(raw, lenient_dates=False).collect()


def test_drop_null_rows_and_columns(frame):
    df = frame("a int, b int, c int", (1, None, None), (None, None, None), (None, None, 3))
    assert clean.drop_null_rows(df).count() == 2
    assert clean.drop_null_columns(df).columns == ["a", "c"]


def test_union_by_name(frame):
    one = clean.tag_entity(frame("x int", (1,)), "p")
    two = clean.tag_entity(frame("y int", (2,)), "q")
    out = clean.union_entities([one, two])
    assert out.columns == ["Company", "x", "y"]
    assert {tuple(r) for r in out.collect()} == {("p", 1, None), ("q", None, 2)}


def test_profile(frame):
    got = {r.column_name: (r.n_rows, r.n_filled, r.share_filled) for r in clean.nonnull_profile(frame("a int, b int", (1, None), (2, 3))).collect()}
    assert got == {"a": (2, 2, 1.0), "b": (2, 1, 0.5)}


def test_profile_of_an_empty_table(frame):
    got = clean.nonnull_profile(frame("a int")).collect()
    assert [(r.n_rows, r.n_filled, r.share_filled) for r in got] == [(0, 0, None)]


def test_aliases_first_match_wins(frame):
    out = rename_aliases(frame("ticker string, firm string, y double, xgb double, xgb_point double", ("t", "f", 1.0, 2.0, 3.0)))
    assert out.columns == ["Company", "firm", "actual", "xgb", "xgb_point"]


def test_required_columns(frame):
    with pytest.raises(ValueError, match="KPI"):
        require_columns(frame("Company string, year int, quarter int", ("a", 2000, 1)))


def test_kpi_column_serves_as_actual(frame):
    out = normalise_predictions(frame("Company string, year int, quarter int, Revenues double", ("a", 2000, 1, 5.0)), "Revenues")
    row = out.first()
    assert (row.actual, row.KPI, row.arima_naive) == (5.0, "Revenues", None)


@pytest.mark.parametrize(
    "text,want", [("2023Q1", (2023, 1)), ("2023-Q1", (2023, 1)), ("fy 2023 q4", (2023, 4)), ("n/a", (None, None)), (None, (None, None)), ("1999Q1", (None, None))]
)
def test_period_labels(frame, text, want):
    out = resolve_year_quarter(frame("Period string", (text,), ("2020 Q2",))).collect()
    assert (out[0].year, out[0].quarter) == want


def test_unreadable_labels_fall_back_to_the_first_readable_date(frame):
    df = frame("Period string, target_date string, date string", ("n/a", "bad", "2001-05-02"), ("n/a", None, None))
    assert [(r.year, r.quarter) for r in resolve_year_quarter(df).collect()] == [(2001, 2), (None, None)]


def test_no_source_for_the_year(frame):
    with pytest.raises(ValueError):
        resolve_year_quarter(frame("a int", (1,)))
    with pytest.raises(Exception, match="cannot be told"):
        resolve_year_quarter(frame("Period string", ("n/a",))).collect()


def test_finalise_defaults_and_order(frame):
    out = finalise(frame("z int, month int, Revenues double", (1, 5, 2.0)), "Revenues")
    assert out.columns == ["Company", "KPI", "quarter", "month", "Revenues", "arima_naive", "arima_drift", "z"]
    assert out.first().quarter == 2 and out.first().Company == "Unknown"


def test_answer_key(frame):
    key = frame("c string", ("Big Co",)).select(answer_key(F.col("c"), F.lit("Net Income"), F.lit(2023), F.lit(4))).first()[0]
    assert key == "Big_Co_Net_Income_2023Q4.json"


def test_spec_rejects_unknown_unit(frame):
    df = frame("Company string, Date date, Revenues double", ("a", dt.date(2000, 1, 1), 1.0))
    with pytest.raises(ValueError):
        PanelSpec(slice_unit="week").slice_expr(df)


@pytest.mark.parametrize(
    "text, want",
    [
        ("2020-03-31", dt.date(2020, 3, 31)),
        ("2020-03-31 10:11:12", dt.date(2020, 3, 31)),
        ("03/31/2020", dt.date(2020, 3, 31)),
        ("3/31/20", dt.date(2020, 3, 31)),
        ("March 31, 2020", dt.date(2020, 3, 31)),
        ("Mar 31, 2020", dt.date(2020, 3, 31)),
        (" 31 Mar 2020 ", dt.date(2020, 3, 31)),
        ("20200331", dt.date(2020, 3, 31)),
        ("1585612800000", dt.date(2020, 3, 31)),
        ("03/31/2020 10:11", dt.date(2020, 3, 31)),
        ("not-a-date", None),
        ("13/45/2020", None),
        ("", None),
        (None, None),
    ],
)
def test_common_forms_of_dates(frame, text, want):
    assert frame("d string", (text,)).select(calendar.lenient_date(F.col("d")).alias("d")).first().d == want


def test_unreadable_dates_are_counted(frame):
    df = frame("d string", ("2020-01-01",), ("x",), (None,), ("1/2/2020",), ("y",))
    assert df.agg(calendar.unreadable_dates(F.col("d")).alias("n")).first().n == 2


def test_undated_rows_have_no_year_once_there_are_dates(frame):
    df = frame("Date string, year int, quarter int, Revenues double", ("2020-05-01", 1999, 1, 1.0), (None, 1999, 1, 1.0), ("x", 1999, 1, 1.0))
    got = [(r.year, r.quarter) for r in normalise.finalise(df, "Revenues").collect()]
    assert got == [(2020, 2), (None, None), (None, None)]
    bare = frame("year int, month int, Revenues double", (1999, 5, 1.0))
    assert (normalise.finalise(bare, "Revenues").first().year, normalise.finalise(bare, "Revenues").first().quarter) == (1999, 2)
