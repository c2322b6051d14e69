"""Sliced neighbours equal the plain window, whatever the shape of the histories."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarterwise.operators.chat import with_history
from quarterwise.operators.evaluate import ewma_state
from quarterwise.operators.features import last_row_features, leakage_contrast, supervised, timeseries_features
from quarterwise.operators.neighbours import in_slices, latest_rows, with_neighbours
from quarterwise.spec import PanelSpec

SCHEMA = "Company string, Date date, Revenues double, Assets double"


def _panel(spark, seed=1):
    rnd = random.Random(seed)
    rows = []
    # one entity holds most rows; others are short, gappy, undated or without values
    for day in range(900):
        if rnd.random() < 0.8:
            rows.append(("hot", dt.date(1999, 6, 1) + dt.timedelta(days=day), None if rnd.random() < 0.1 else float(day), 1.0))
    for i in range(40):
        for _ in range(rnd.randint(0, 6)):
            d = dt.date(rnd.randint(1990, 2020), rnd.randint(1, 12), rnd.randint(1, 28))
            rows.append((f"c{i}", d, None if rnd.random() < 0.2 else rnd.random(), None))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += [("hot", None, float(k), 2.0) for k in range(30)] + [("c1", None, 5.0, None), (None, dt.date(2000, 1, 1), 1.0, 1.0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    "spec", [PanelSpec(), *[PanelSpec(slice_unit=u) for u in ("year", "quarter", "month", "day")], PanelSpec(tie_slices=8)]
)
@pytest.mark.parametrize("offsets", [(-1, -2), (1,), (-1, -2, -5, 1, 3)])
def test_equals_plain_window(spark, spec, offsets):
    panel = _panel(spark)
    wanted = {f"v{o}": ("Revenues", o) for o in offsets}
    got = with_neighbours(panel, spec.keys, [spec.time, spec.tie(panel)], spec.slice_expr(panel), wanted)
    w = Window.partitionBy("Company").orderBy(F.col("Date").asc_nulls_last(), F.xxhash64("Revenues", "Assets"))
    want = panel.where("Company is not null").withColumns(
        {f"v{o}": (F.lag("Revenues", -o) if o < 0 else F.lead("Revenues", o)).over(w) for o in offsets}
    )
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_many_rows_on_one_date(spark):
    rows = [("hot", dt.date(2000, 3, 31), float(i), 0.0) for i in range(3000)] + [("x", dt.date(2000, 3, 31), 1.0, 0.0)]
    panel = spark.createDataFrame(rows, SCHEMA)
    spec = PanelSpec(exog=("Assets",), tie_slices=64)
    slices = panel.where("Company = 'hot'").groupBy(spec.slice_expr(panel)).count()
    assert slices.count() == 64 and slices.agg(F.max("count")).first()[0] < 200
    out = timeseries_features(panel, spec).where("Company = 'hot'")
    assert out.count() == 3000
    assert out.where("lag_1 is null").count() == 1 and out.where("lag_2 is null").count() == 2
    assert out.select("lag_1").distinct().count() == 3000  # each value is the lag of one row


@pytest.mark.parametrize("day", [dt.date(2000, 3, 31), None])
def test_equal_rows_are_cut_by_position(spark, day):
    rows = [("hot", day, 7.0, 0.0)] * 10_000 + [("hot", dt.date(1999, 3, 31), 1.0, 0.0), ("x", day, 2.0, None), (None, day, 1.0, 1.0)]
    panel = spark.createDataFrame(rows, SCHEMA)
    spec = PanelSpec(exog=("Assets",), slice_unit="position")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        stored, order, slices = in_slices(panel, spec)
        sizes = [r["count"] for r in stored.where("Company = 'hot'").groupBy(slices).count().collect()]
        out = timeseries_features(panel, spec)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) > 30 and max(sizes) < 1000 and sum(sizes) == 10_001
    want = timeseries_features(panel, PanelSpec(exog=("Assets",)))
    assert out.columns == want.columns
    assert out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0


def test_other_operators_take_slices_by_position(spark):
    panel, spec = _panel(spark), PanelSpec(slice_unit="position")
    for make in (supervised, leakage_contrast):
        got, want = make(panel, spec=spec), make(panel)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    states = [{r.Company: r.weighted for r in ewma_state(panel, F.col("Revenues"), s).collect()} for s in (spec, PanelSpec())]
    assert states[0] == pytest.approx(states[1])


def test_undated_rows_are_spread(spark):
    rows = [("a", None, float(i), 0.0) for i in range(1000)]
    panel = spark.createDataFrame(rows, SCHEMA)
    assert panel.groupBy(PanelSpec(slice_unit="year").slice_expr(panel)).count().count() > 32


def test_features_do_not_see_later_rows(spark):
    panel = _panel(spark).where("Date is not null")
    cut = dt.date(2000, 6, 30)
    whole = timeseries_features(panel).where(F.col("Date") <= F.lit(cut))
    early = timeseries_features(panel.where(F.col("Date") <= F.lit(cut)))
    assert whole.exceptAll(early).count() == 0 and early.exceptAll(whole).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_has_a_slice_in_its_partitioning(spark):
    plan = _plan(supervised(_panel(spark), PanelSpec(slice_unit="year")))
    assert "hashpartitioning(Company" in plan and "__slice" in plan


def test_whole_histories_take_one_exchange_and_one_scan(spark, tmp_path):
    _panel(spark).write.parquet(str(tmp_path / "panel"))
    panel = spark.read.parquet(str(tmp_path / "panel"))
    predictions = panel.selectExpr("Company", "'Revenues' AS KPI", "year(Date) AS year", "quarter(Date) AS quarter", "Revenues AS actual")
    for made in (timeseries_features(panel), supervised(panel, label_date=True), with_history(predictions)):
        plan = _plan(made)
        assert plan.count("Exchange") == 1 == plan.count("Scan parquet") and "Join" not in plan


def test_latest_rows_limit_runs_before_the_exchange(spark):
    plan = latest_rows(_panel(spark), ["Company"], ["Date"], 2, "rn")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_zero_and_null_values(frame):
    d = [dt.date(2000, 3, 31), dt.date(2000, 6, 30), dt.date(2000, 9, 30), dt.date(2000, 12, 31)]
    panel = frame(SCHEMA, ("a", d[0], 0.0, None), ("a", d[1], 0.0, None), ("a", d[2], 4.0, None), ("a", d[3], None, None))
    rows = {r.Date: r for r in timeseries_features(panel).collect()}
    assert rows[d[1]].growth_1 is None and rows[d[1]].diff_1 == 0.0  # 0 / 0
    assert rows[d[2]].growth_1 is None and rows[d[2]].mean_2 == 2.0  # 4 / 0
    assert rows[d[3]].mean_2 is None and rows[d[3]].lag_1 == 4.0 and rows[d[3]].arima_drift == 8.0


@pytest.mark.parametrize("min_points,kept", [(1, "abc"), (2, "bc"), (3, "c"), (4, "")])
def test_min_rows_gate(frame, min_points, kept):
    d = [dt.date(2000, m, 1) for m in (1, 2, 3, 4)]
    rows = [("a", d[0], 1.0, None), ("a", d[1], None, None)]
    rows += [("b", d[0], 1.0, None), ("b", d[1], 2.0, None), ("b", d[2], None, None)]
    rows += [("c", d[0], 1.0, None), ("c", d[1], 2.0, None), ("c", d[2], None, None), ("c", d[3], 8.0, None)]
    out = last_row_features(frame(SCHEMA, *rows), PanelSpec(min_points=min_points))
    got = {r.Company: r for r in out.collect()}
    assert "".join(sorted(got)) == kept
    if "c" in got:
        assert (got["c"].lag_1, got["c"].lag_2, got["c"].Date) == (2.0, 1.0, d[3])


def test_supervised_drops_rows_without_label_and_honours_horizon(frame):
    d = [dt.date(2000, m, 1) for m in (1, 2, 3, 4)]
    panel = frame(SCHEMA, *[("a", x, float(i), 9.0) for i, x in enumerate(d)], (None, d[0], 1.0, 1.0))
    one = supervised(panel, label_date=True).orderBy("Date").collect()
    assert [(r.y_next, r.label_date) for r in one] == [(1.0, d[1]), (2.0, d[2]), (3.0, d[3])]
    two = supervised(panel, PanelSpec(horizon=2)).orderBy("Date").collect()
    assert [r.y_next for r in two] == [2.0, 3.0]
