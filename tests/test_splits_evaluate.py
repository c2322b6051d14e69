import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quarterwise.operators import evaluate, splits
from quarterwise.spec import PanelSpec

SCHEMA = "Company string, Date date, Revenues double"


def _rows(n=500, seed=3):
    rnd = random.Random(seed)
    days = [dt.date(2000, 3, 31), dt.date(2000, 6, 30), dt.date(2000, 9, 30)]
    return [(f"c{i:04d}", days[0] if rnd.random() < 0.6 else rnd.choice(days), rnd.random() * 100) for i in range(n)]


@pytest.mark.parametrize("frac", [0.0, 0.1, 0.37, 0.8, 0.999, 1.0])
def test_chronological_split_is_exact(spark, frac):
    rows = _rows() + [("undated", None, 1.0)]
    out = splits.chronological_split(spark.createDataFrame(rows, SCHEMA), frac)
    assert out.columns == ["Company", "Date", "Revenues", "split"]
    ordered = sorted(rows, key=lambda r: (r[1] is None, r[1] or dt.date.min, r[0]))
    k = int(len(rows) * frac)
    got = {(r.Company, r.split) for r in out.collect()}
    assert got == {(r[0], "train" if i < k else "val") for i, r in enumerate(ordered)}


def test_split_of_an_empty_table(spark):
    assert splits.chronological_split(spark.createDataFrame([], SCHEMA)).count() == 0
    assert splits.head_split(spark.createDataFrame([], SCHEMA), ["Company"]).count() == 0


@pytest.mark.parametrize("n,fraction,val", [(500, 0.2, 100), (3, 0.2, 1), (1, 0.2, 1), (10, 1.0, 10)])
def test_head_split_is_exact(spark, n, fraction, val):
    rows = _rows(n)
    out = splits.head_split(spark.createDataFrame(rows, SCHEMA).repartition(7), ["Company"], fraction)
    firsts = {r[0] for r in sorted(rows)[:val]}
    assert {r.Company for r in out.where("split = 'val'").collect()} == firsts
    assert out.count() == n


def test_key_at_position_does_not_depend_on_ranges(spark):
    df = spark.createDataFrame(_rows(997), SCHEMA).repartition(5)
    ordered = sorted(r[0] for r in _rows(997))
    for parts in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for k in (1, 500, 997):
            assert splits.key_at_position(df, ["Company"], k).Company == ordered[k - 1]
        assert splits.key_at_position(df, ["Company"], 998) is None
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_key_at_position_with_copies_and_nulls(spark):
    rows = [(None, None, 1.0)] * 3 + [("a", None, 1.0)] * 200 + [("b", dt.date(2000, 1, 1), 1.0)] * 50
    df = spark.createDataFrame(rows, SCHEMA)
    got = [splits.key_at_position(df, ["Company", "Date"], k) for k in (1, 3, 4, 203, 204, 253)]
    assert [r.Company for r in got] == [None, None, "a", "a", "b", "b"]


def test_equal_rows_are_cut_at_exactly_the_share(spark):
    df = spark.createDataFrame([("a", dt.date(2000, 1, 1), 1.0)] * 101, SCHEMA)
    assert splits.chronological_split(df, 0.37).where("split = 'train'").count() == 37
    assert splits.head_split(df, ["Company"], 0.5).where("split = 'val'").count() == 50


def test_one_heavy_key_is_ranked_by_many_tasks(spark):
    df = spark.range(40_000).selectExpr("if(id = 7, 'A', 'B') AS Company", "date'2000-01-01' AS Date", "1.0D AS Revenues")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = splits.numbered(df)
        order = ["Company", splits._ROW]
        spread = rows.repartitionByRange(*order).groupBy(F.spark_partition_id()).count().collect()
        assert len(spread) == 4 and max(r["count"] for r in spread) < 20_000
        assert splits.key_at_position(rows, order, 30_000).Company == "B"
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = _executed(spark)
    assert splits.chronological_split(df, 0.8).where("split = 'train'").count() == 32_000
    # a window without partitions ranks rows per date or per range only, never the rows themselves
    for plan in _executed(spark)[len(before):]:
        assert "row_number" not in plan


def _executed(spark):
    """Texts of the physical plans of all queries so far."""
    listed = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [listed.apply(i).physicalPlanDescription() for i in range(listed.size())]


def test_inside_a_day_time_decides(frame):
    at = dt.datetime
    df = frame("Company string, Date timestamp, Revenues double", ("a", at(2000, 1, 1, 9), 1.0), ("b", at(2000, 1, 1, 8), 1.0), ("c", at(2000, 1, 2), 1.0))
    got = {r.Company: r.split for r in splits.chronological_split(df, 0.34).collect()}
    assert got == {"a": "val", "b": "train", "c": "val"}


def test_hash_split_tells_missing_parts_apart_and_honours_the_share(spark):
    pairs = spark.range(4000).selectExpr("cast(id AS string) AS a", "cast(null AS string) AS b")
    swapped = pairs.selectExpr("b AS a", "a AS b", "a AS key")
    one = splits.hash_split(pairs.withColumn("key", F.col("a")), ["a", "b"], 0.5)
    other = splits.hash_split(swapped, ["a", "b"], 0.5)
    both = one.select("key", F.col("split").alias("s")).join(other.select("key", F.col("split").alias("t")), "key")
    assert 0.4 < both.where("s = t").count() / 4000 < 0.6
    assert 0.45 < one.where("split = 'val'").count() / 4000 < 0.55


def test_hash_split_ignores_partitioning(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    one = splits.hash_split(df, ["Company"])
    other = splits.hash_split(df.repartition(9), ["Company"])
    assert one.exceptAll(other).count() == 0
    assert 0.1 < one.where("split = 'val'").count() / 500 < 0.3


def _recurrence(residuals, decay=0.94):
    var = 0.0
    for r in residuals:
        var = decay * var + (1 - decay) * r * r
    return math.sqrt(var + 1e-12)


@pytest.mark.parametrize("n", [1, 7, 3000])
@pytest.mark.parametrize("parts", ["1", "5"])
def test_ewma_equals_the_recurrence(spark, n, parts):
    rnd = random.Random(n)
    rows = [(f"c{i:05d}", dt.date(2000, 1, 1), rnd.gauss(0, 5)) for i in range(n)]
    rows[0] = (*rows[0][:2], 1e9)  # an old outlier must fade, not vanish
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = evaluate.ewma_volatility(df, F.col("Revenues"), ["Company", "Date"]).first().sigma
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == pytest.approx(_recurrence([r[2] for r in rows]), rel=1e-9)


def test_ewma_without_residuals_is_zero(spark):
    df = spark.createDataFrame([("a", dt.date(2000, 1, 1), None)], SCHEMA)
    assert evaluate.ewma_volatility(df, F.col("Revenues"), ["Company"]).first().sigma == 0.0


def test_ewma_by_entity_over_many_slices(spark):
    rnd = random.Random(5)
    rows = [("a", dt.date(1990, 1, 1) + dt.timedelta(days=40 * i), rnd.gauss(0, 3)) for i in range(300)]
    rows += [("b", dt.date(2000, 1, 1), 2.0), ("b", dt.date(2001, 1, 1), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for unit in ("none", "year", "quarter", "month", "day"):
        spec = PanelSpec(exog=(), slice_unit=unit)
        got = {r.Company: r for r in evaluate.ewma_volatility_by_entity(df, F.col("Revenues"), spec).collect()}
        assert got["a"].sigma == pytest.approx(_recurrence([r[2] for r in rows[:300]]), rel=1e-9)
        assert got["b"].n_residuals == 1 and got["b"].sigma == pytest.approx(_recurrence([2.0]))


def test_metrics_keep_a_model_without_values(frame):
    df = frame("y double, arima_naive double, arima_drift double, xgb_point double", (1.0, 2.0, None, 1.0), (3.0, None, None, 7.0), (None, 1.0, None, 1.0))
    got = {r.model: (r.MAE, r.RMSE) for r in evaluate.metrics_by_model(df, "y").collect()}
    assert got["naive"] == (1.0, 1.0) and got["drift"] == (None, None)
    assert got["xgb"][0] == 2.0 and got["xgb"][1] == pytest.approx(math.sqrt(8))


def test_metrics_of_an_empty_table(frame):
    assert evaluate.metrics_by_model(frame("y double, xgb_point double"), "y").count() == 0


def test_interval_keeps_null_forecasts(frame):
    df = frame("Company string, Date date, y double, xgb_point double", ("a", dt.date(2000, 1, 1), 5.0, 3.0), ("b", dt.date(2000, 1, 1), 5.0, None))
    got = {r.Company: r for r in evaluate.prediction_interval(df, "y", ["Company", "Date"]).collect()}
    assert got["b"].pi_lower is None
    assert got["a"].pi_upper - got["a"].pi_lower == pytest.approx(2 * 1.96 * _recurrence([2.0]))


def test_chart_table_takes_the_first_row(frame):
    df = frame("Company string, Date date, actual double, xgb_point double", ("a", dt.date(2001, 1, 1), 9e9, 1e9), ("a", dt.date(2000, 1, 1), 2e9, 3e9))
    assert [tuple(r) for r in evaluate.chart_table(df).collect()] == [("a", 2.0, 3.0)]


def test_volatility_from_states_of_batches_equals_that_of_all_rows(spark, frame):
    rows = [(c, dt.date(2000 + i // 4, 3 * (i % 4) + 1, 1), float((i * 37 + k) % 11 - 5)) for k, c in enumerate("abc") for i in range(20 + k)]
    whole = frame(SCHEMA, *rows, (None, dt.date(2000, 1, 1), 9.0), ("d", dt.date(2000, 1, 1), None))
    want = {r.Company: (r.n_residuals, round(r.sigma, 9)) for r in evaluate.ewma_volatility_by_entity(whole, F.col("Revenues")).collect()}
    cuts = [dt.date(2001, 5, 1), dt.date(2003, 1, 1)]
    spec = PanelSpec(slice_unit="year")
    batches = [
        whole.where(F.col("Date") < cuts[0]),
        whole.where((F.col("Date") >= cuts[0]) & (F.col("Date") < cuts[1])),
        whole.where((F.col("Date") >= cuts[1]) & (F.col("Company") != "b")),
    ]
    states = [evaluate.ewma_state(b, F.col("Revenues"), spec) for b in batches]
    left = evaluate.merge_ewma_states(evaluate.merge_ewma_states(states[0], states[1]), states[2])
    right = evaluate.merge_ewma_states(states[0], evaluate.merge_ewma_states(states[1], states[2]))
    for state in (left, right):
        got = {r.Company: (r.n_residuals, round(r.sigma, 9)) for r in evaluate.volatility_of_state(state).collect()}
        assert {k: got[k] for k in "ac"} == {k: want[k] for k in "ac"} and got["b"][0] == 12
    with pytest.raises(Exception, match="not later than the state of a"):
        evaluate.merge_ewma_states(states[1], states[0]).collect()
