import datetime as dt
import json

from quarterwise import workflows
from quarterwise.operators import model
from quarterwise.sinks import upsert

FEW = model.TreeParams(3, 3, 0.5)


def _quarter(i):
    return dt.date(2000 + i // 4, 3 * (i % 4) + 3, 30)


def _raw(frame):
    rows = []
    for c in range(8):
        for i in range(16):
            missing = (c + i) % 11 == 0
            rows.append((f"c{c}", _quarter(i).isoformat(), "N/A" if missing else str(100.0 * (c + 1) + 7 * i), "1.5", "2.5", str(i), "N/A"))
    return frame("Company string, Date string, Revenues string, OperatingExpenses string, GrossProfit string, Assets string, StockholdersEquity string", *rows)


def test_baselines_to_chat_files(spark, frame, tmp_path):
    out = str(tmp_path / "a")
    raw = _raw(frame).replace("N/A", "3.0", subset=["StockholdersEquity"])
    by_model, unseen = workflows.baselines(spark, raw, out, params=FEW, validation_fraction=0.3)
    metrics = {r.model: r for r in by_model.collect()}
    assert 0 < unseen.first().n_rows < 60 and unseen.first().mae is not None
    assert set(metrics) == {"naive", "drift", "xgb"} and all(r.MAE is not None for r in metrics.values())
    pred = spark.read.parquet(f"{out}/predictions")
    assert pred.columns[:5] == ["Company", "KPI", "Date", "year", "quarter"] and pred.count() == 128
    assert pred.where("xgb_point is null").count() > 0 and pred.where("pi_lower < pi_upper").count() > 0
    chats = spark.read.text(workflows.chat_files(spark, f"{out}/predictions", str(tmp_path / "chat"), "Revenues", 2003))
    assert {r.split: r["count"] for r in chats.groupBy("split").count().collect()} == {"train": 88, "val": 32}
    assert all(len(json.loads(r.value)["messages"]) in (2, 3) for r in chats.collect())


def test_last_rows_to_chat_files(spark, frame, tmp_path):
    out = str(tmp_path / "a")
    raw = _raw(frame).replace("N/A", "3.0", subset=["StockholdersEquity"])
    workflows.baselines(spark, raw, out, last_rows=True, params=FEW, min_rows=1)
    assert spark.read.parquet(f"{out}/predictions").count() == 8
    made = spark.read.text(workflows.last_row_chat_files(spark, f"{out}/predictions", str(tmp_path / "chat"), "Revenues"))
    assert made.where("split = 'val'").count() == 1 and made.count() == 8


def test_backtest_merges_into_the_prediction_table(spark, frame, tmp_path):
    out = str(tmp_path / "p")
    for strict in (False, True):
        compared, metrics = workflows.backtest_report(_raw(frame), "2002-12-31", "2003-03-30", out, strict=strict, as_written=not strict, params=FEW)
        assert metrics.first().n_rows == compared.count() > 0
    saved = upsert.read_predictions(spark, out)
    assert saved.count() == saved.select("Company", "Date").distinct().count() and "actual" in saved.columns


def test_ingest(spark, tmp_path):
    (tmp_path / "facts").mkdir()
    (tmp_path / "filings").mkdir()
    for c in ("A", "B"):
        row = [{"form": "10-Q", "end": f"2020-0{m}-28", "val": m, "accn": f"1-{m}"} for m in (3, 6, 9)]
        doc = {"Company": c, "facts": {"us-gaap": {"Revenues": {"units": {"USD": row}}, "Assets": {"units": {"EUR": row}}}}}
        (tmp_path / "facts" / f"{c}.json").write_text(json.dumps(doc))
    recent = {"form": ["10-Q"] * 3, "filingDate": ["2020-04-01", "2020-07-01", "1990-01-01"], "reportDate": ["", "", ""], "accessionNumber": ["1-3", "1-6", "1-9"]}
    (tmp_path / "filings" / "f.json").write_text(json.dumps({"Company": "A", "filings": {"recent": recent}}))
    panel = workflows.ingest(spark, str(tmp_path / "facts"), str(tmp_path / "filings"), str(tmp_path / "out"), "2020-12-31")
    assert panel.columns == ["Company", "Date", "Revenues"]
    assert {tuple(r) for r in panel.collect()} == {(c, f"2020-0{m}-28", float(m)) for c in "AB" for m in (3, 6)}
    assert spark.read.parquet(str(tmp_path / "out" / "panel")).count() == 4
