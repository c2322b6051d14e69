"""Held-out forecasts: test rows, leakage checks, comparison with actuals, many cutoffs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterwise.functions.numbers import growth
from quarterwise.operators.evaluate import pooled_metrics
from quarterwise.operators.features import add_calendar
from quarterwise.operators.neighbours import latest_rows
from quarterwise.spec import PanelSpec


def _date(value: str | dt.date) -> Column:
    return F.lit(value).cast("date")


def training_rows(sup: DataFrame, train_end: str, spec: PanelSpec = PanelSpec(), strict: bool = False) -> DataFrame:
    """Supervised rows up to train_end. Strict also asks that the label is no later."""
    rows = sup.where(F.col(spec.time) <= _date(train_end))
    return rows.where(F.col("label_date") <= _date(train_end)) if strict else rows


def test_rows(panel: DataFrame, test_date: str, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """One feature row per entity at test_date, from its last two rows before that date.

    Entities with fewer than two earlier rows, or without a KPI in either, are left out.
    """
    past = panel.where(F.col(spec.time) < _date(test_date))
    two = latest_rows(past, spec.keys, [spec.time, spec.tie(panel)], 2, "__rn")
    newest_first = Window.partitionBy(*spec.keys).orderBy("__rn")
    last = two.withColumn("lag_2", F.lead(spec.kpi, 1).over(newest_first)).where(F.col("__rn") == 1)
    last = last.withColumn("lag_1", F.col(spec.kpi)).where(F.col("lag_1").isNotNull() & F.col("lag_2").isNotNull())
    return _feature_row(last.withColumn(spec.time, _date(test_date)), spec)


test_rows.__test__ = False  # not a pytest case


def _feature_row(df, spec):
    lag_1, lag_2 = F.col("lag_1"), F.col("lag_2")
    out = df.withColumns({"diff_1": lag_1 - lag_2, "growth_1": growth(lag_1, lag_2), "mean_2": (lag_1 + lag_2) / F.lit(2)})
    return add_calendar(out, spec).select(
        spec.entity,
        spec.time,
        "lag_1",
        "lag_2",
        "diff_1",
        "growth_1",
        "mean_2",
        "year",
        "quarter",
        "month",
        *[c for c in spec.exog if c in df.columns],
    )


def asof_rows(panel: DataFrame, test_date: str, columns: Sequence[str], spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Each entity's last row strictly before test_date."""
    past = panel.where(F.col(spec.time) < _date(test_date))
    last = latest_rows(past, spec.keys, [spec.time, spec.tie(panel)], 1, "__rn")
    return last.select(spec.entity, F.col(spec.time).alias("asof_date"), *columns)


def naive_drift(rows: DataFrame) -> DataFrame:
    """Naive and drift forecasts read off test rows."""
    return rows.withColumns({"arima_naive": F.col("lag_1"), "arima_drift": F.col("lag_1") + F.col("diff_1")})


def actuals(
    sup: DataFrame, panel: DataFrame, dates: Sequence[str], spec: PanelSpec = PanelSpec(), actual: str = "next"
) -> DataFrame:
    """What forecasts at `dates` are scored on.

    "next" takes the label of the supervised row at the date, that is the KPI one row
    later; "at_test_date" takes the KPI at the date itself.
    """
    at = F.col(spec.time).isin([F.lit(d).cast("date") for d in dates])
    if actual == "next":
        return sup.where(at).select(spec.entity, spec.time, F.col("y_next").alias("actual"))
    if actual == "at_test_date":
        return panel.where(at & F.col(spec.kpi).isNotNull()).select(spec.entity, spec.time, F.col(spec.kpi).alias("actual"))
    raise ValueError(f"unknown choice of actual: {actual}")


def compare(forecasts: DataFrame, truth: DataFrame, columns: Sequence[str], spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Forecasts beside actuals, for (entity, time) pairs known on both sides."""
    keys = [spec.entity, spec.time]
    return forecasts.select(*keys, *columns).join(truth, keys, "inner").select(*keys, "actual", *columns)


def leakage_report(train: DataFrame, test: DataFrame, train_end: str, test_date: str, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """One row per check: rows looked at, rows that break it, latest date seen, and whether it was made.

    train_date: training rows dated after train_end. label_date: training labels taken
    at or after test_date; without a label_date column this cannot be told, and its violations
    are NULL. test_date: test rows dated before test_date. y_next_in_test: test rows that
    carry a label.
    """
    t = F.col(spec.time)
    dated = "label_date" in train.columns
    label = F.col("label_date") if dated else F.lit(None).cast("date")
    target = F.col("y_next") if "y_next" in test.columns else F.lit(None).cast("double")
    on_train = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(t > _date(train_end)).alias("a"),
        F.max(t).alias("last"),
        (F.count_if(label >= _date(test_date)) if dated else F.lit(None).cast("bigint")).alias("b"),
        F.max(label).alias("last_label"),
    )
    on_test = test.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(t < _date(test_date)).alias("a"),
        F.max(t).alias("last"),
        F.count(target).alias("b"),
    )
    none = F.lit(None).cast("date")
    train_checks = F.array(_check("train_date", "n", "a", F.col("last")), _check("label_date", "n", "b", F.col("last_label")))
    test_checks = F.array(_check("test_date", "n", "a", F.col("last")), _check("y_next_in_test", "n", "b", none))
    left, right = on_train.select(F.inline(train_checks)), on_test.select(F.inline(test_checks))
    return left.unionByName(right)


def _check(name, n, bad, last):
    return F.struct(
        F.lit(name).alias("check"),
        F.col(n).alias("n_rows"),
        F.col(bad).alias("violations"),
        last.alias("last_date"),
        F.col(bad).isNotNull().alias("evaluated"),
    )


# the checks that stop a backtest, and those that do where the label may be the value at the test date
BLOCKING_CHECKS = ("train_date", "label_date", "test_date")
AS_WRITTEN_CHECKS = ("train_date", "test_date")


def require_no_leakage(report: DataFrame, checks: Sequence[str] = BLOCKING_CHECKS) -> None:
    """Raise if one of the named checks has violations or was not made; reads at most four rows."""
    bad = report.where(F.col("check").isin(*checks) & (~F.col("evaluated") | (F.col("violations") > 0))).collect()
    if bad:
        told = [f"{r.violations} rows, latest {r.last_date}" if r.evaluated else "not evaluated" for r in bad]
        raise AssertionError("; ".join(f"{r['check']}: {x}" for r, x in zip(bad, told)))


def require_no_leakage_in_folds(
    train: DataFrame,
    tests: DataFrame,
    folds: Sequence[tuple[str, str]],
    checks: Sequence[str] = BLOCKING_CHECKS,
    spec: PanelSpec = PanelSpec(),
    strict: bool = False,
) -> None:
    """`require_no_leakage` for many (train_end, test_date) folds, from one pass over each table.

    A fold trains on the rows up to its end, so rows after it cannot be among them; what is left to check is the
    latest label of those rows and that there is no test row at another date than the folds'.
    """
    t, dated = F.col(spec.time), "label_date" in train.columns
    if "label_date" in checks and not dated:
        raise AssertionError("label_date: not evaluated")
    late = []
    for i, (end, test) in enumerate(folds):
        inside = t <= _date(end)
        if strict:
            inside = inside & (F.col("label_date") <= _date(end))
        label = F.count_if(inside & (F.col("label_date") >= _date(test))) if dated else F.lit(0)
        late += [label.alias(f"label_{i}"), F.max(F.when(inside, t)).alias(f"last_{i}")]
    found = train.agg(*late).first()
    other = tests.where(~t.isin([F.lit(test).cast("date") for _, test in folds])).limit(1).count()
    bad = ["test_date: rows at other dates than the folds'"] if other and "test_date" in checks else []
    for i, (end, test) in enumerate(folds):
        if "label_date" in checks and found[f"label_{i}"]:
            bad.append(f"label_date: {found[f'label_{i}']} rows for {test}")
        if "test_date" in checks and not str(end) < str(test):
            bad.append(f"test_date: {test} is not after the training end {end}")
    if bad:
        raise AssertionError("; ".join(bad))


def history_report(
    panel: DataFrame, sup: DataFrame, train_end: str, test_date: str, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Per entity of the supervised table: is there enough history for test rows?"""
    before = F.col(spec.time) < _date(test_date)
    filled = before & F.col(spec.kpi).isNotNull()
    raw = panel.groupBy(spec.entity).agg(F.count_if(before).alias("n_before"), F.count_if(filled).alias("n_filled"))
    two = latest_rows(panel.where(filled).select(spec.entity, spec.time), spec.keys, [spec.time], 2, "rn")
    dates = two.groupBy(spec.entity).agg(
        F.max(F.when(F.col("rn") == 1, F.col(spec.time))).alias("last_date"),
        F.max(F.when(F.col("rn") == 2, F.col(spec.time))).alias("second_last_date"),
    )
    trained = sup.groupBy(spec.entity).agg(F.count_if(F.col(spec.time) <= _date(train_end)).alias("n_supervised"))
    joined = trained.join(raw, spec.entity, "left").join(dates, spec.entity, "left")
    return joined.select(
        spec.entity,
        F.coalesce("n_before", F.lit(0)).alias("n_before"),
        F.coalesce("n_filled", F.lit(0)).alias("n_filled"),
        "n_supervised",
        "last_date",
        "second_last_date",
        (F.coalesce("n_filled", F.lit(0)) >= 2).alias("enough"),
    )


def walk_forward_rows(panel: DataFrame, test_dates: Sequence[str], spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Test rows for many test dates in one job.

    Each row belongs to the first test date after it. Two rows per (entity, test date)
    are enough to serve that date and, carried forward, every later one; so rows are
    cut to those two before the exchange and are never paired with all dates.
    """
    dates = sorted({dt.date.fromisoformat(str(d)) for d in test_dates})
    if not dates:
        raise ValueError("no test dates given")
    at = F.array(*[F.lit(d) for d in dates])
    t = F.col(spec.time)
    # number of test dates not after the row = index of the first one after it
    fold = F.size(F.filter(at, lambda d: d <= t))
    placed = panel.where(t < F.lit(dates[-1])).withColumn("fold", fold)
    two = latest_rows(placed, [spec.entity, "fold"], [spec.time, spec.tie(panel)], 2, "__rn")

    present = [c for c in spec.exog if c in panel.columns]
    by_fold = Window.partitionBy(spec.entity, "fold").orderBy("__rn")
    top = two.withColumn("__older", F.lead(F.struct(F.col(spec.kpi).alias("x"))).over(by_fold)).where(F.col("__rn") == 1)
    along = Window.partitionBy(spec.entity).orderBy("fold")
    newest = F.struct(F.col(spec.kpi).alias("x"))
    spread = top.withColumns(
        {
            # the row before the newest: in this fold, else the newest of the fold before
            "__older": F.coalesce("__older", F.lag(newest).over(along)),
            "__until": F.coalesce(F.lead("fold").over(along) - 1, F.lit(len(dates) - 1)),
        }
    )
    served = spread.where(F.col(spec.kpi).isNotNull() & F.col("__older.x").isNotNull()).select(
        spec.entity,
        F.explode(F.sequence("fold", "__until")).alias("fold"),
        F.col(spec.kpi).alias("lag_1"),
        F.col("__older.x").alias("lag_2"),
        *present,
    )
    return _feature_row(served.withColumn(spec.time, F.get(at, F.col("fold"))), spec)


def walk_forward_scores(
    panel: DataFrame, sup: DataFrame, test_dates: Sequence[str], spec: PanelSpec = PanelSpec(), actual: str = "next"
) -> DataFrame:
    """Naive and drift errors per test date over many cutoffs, in one job."""
    rows = naive_drift(walk_forward_rows(panel, test_dates, spec))
    both = compare(rows, actuals(sup, panel, test_dates, spec, actual), ["arima_naive", "arima_drift"], spec)
    naive, drift = F.col("actual") - F.col("arima_naive"), F.col("actual") - F.col("arima_drift")
    return both.groupBy(F.col(spec.time).alias("test_date")).agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.avg(F.abs(naive)).alias("naive_mae"),
        F.sqrt(F.avg(naive * naive)).alias("naive_rmse"),
        F.avg(F.abs(drift)).alias("drift_mae"),
        F.sqrt(F.avg(drift * drift)).alias("drift_rmse"),
    )


__all__ = [
    "actuals",
    "asof_rows",
    "compare",
    "history_report",
    "leakage_report",
    "naive_drift",
    "pooled_metrics",
    "require_no_leakage",
    "require_no_leakage_in_folds",
    "test_rows",
    "training_rows",
    "walk_forward_rows",
    "walk_forward_scores",
]
