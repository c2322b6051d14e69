import datetime as dt
import json

import pytest

from quarterwise.operators import facts
from quarterwise.session import new_folder, path_exists, shared_folder
from quarterwise.sinks import files, upsert
from quarterwise.sources import filings, records


def _doc(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(json.dumps(value, indent=1))
    return str(path)


def test_company_facts_from_a_whole_document(spark, tmp_path):
    row = {"form": "10-Q", "end": "2020-03-31", "val": 1, "accn": "0-1", "fy": 2020}
    doc = {
        "Company": "A",
        "facts": {
            "us-gaap": {
                "Revenues": {"label": "x", "units": {"USD": [row, {**row, "val": 2.5}], "EUR": [row]}},
                "EarningsPerShareDiluted": {"units": {"USD/shares": [row], "usd": [row]}},
                "Assets": {"units": {"USD": [{**row, "end": None}, {**row, "val": None}, {**row, "accn": None}, {**row, "form": "8-K"}]}},
                "NotWanted": {"units": {"USD": [row]}},
            },
            "dei": {"Other": {}},
        },
    }
    long = filings.read_company_facts(spark, _doc(tmp_path, "facts.json", doc), multi_line=True)
    assert long.count() == 9 and long.where("tag = 'NotWanted'").count() == 0
    kept = facts.filter_facts(long)
    assert {(r.tag, r.uom, r.value) for r in kept.collect()} == {
        ("Revenues", "USD", 1.0),
        ("Revenues", "USD", 2.5),
        ("EarningsPerShareDiluted", "USD/shares", 1.0),
    }
    wide = facts.pivot_last(kept, facts.TAGS, ["Company"])
    assert wide.columns == ["Company", "Date", *sorted(facts.TAGS)]
    assert (wide.first().Date, wide.first().Revenues) == ("2020-03-31", 2.5)


def test_last_skips_missing_values(frame):
    df = frame("Company string, end string, tag string, value double, ord bigint", ("a", "2020-03-31", "x", 1.0, 1), ("a", "2020-03-31", "x", 2.0, 2))
    assert facts.pivot_last(df, ["x", "y"], ["Company"]).first().asDict() == {"Company": "a", "Date": "2020-03-31", "x": 2.0, "y": None}


def test_filings_pair_up_to_the_shortest_array(spark, tmp_path):
    recent = {"form": ["10-Q", "8-K", "10-K"], "filingDate": ["2020-01-02", "2020-01-03", "bad"], "reportDate": ["", "x", "y"], "accessionNumber": ["1-1", "1-2", "1-3", "1-4"]}
    docs = filings.read_filings(spark, _doc(tmp_path, "f.json", {"Company": "A", "filings": {"recent": recent}}), True)
    assert [(r.form, r.reportDate) for r in docs.collect()] == [("10-Q", None), ("8-K", "x"), ("10-K", "y")]
    allowed = facts.allowed_filings(docs, "2020-02-01", 31).collect()
    assert [r.accn_stripped for r in allowed] == ["11"]
    empty = filings.read_filings(spark, _doc(tmp_path, "e.json", {"Company": "A", "filings": {"recent": {"form": []}}}), True)
    assert empty.count() == 0


def test_latest_periods(frame):
    df = frame("end string, v int", ("2020-01-01", 1), ("2020-02-01", 2), ("2020-02-01", 3), ("2020-03-01", 4), (None, 5))
    assert {r.v for r in facts.facts_in_latest_periods(df, 2).collect()} == {2, 3, 4}
    assert facts.facts_in_latest_periods(df, 9).count() == 4


def test_semi_join_ignores_hyphens_and_copies(frame):
    left = frame("accn string", ("1-2-3",), ("9",))
    right = frame("accn_stripped string", ("123",), ("123",))
    assert [r.accn for r in facts.facts_of_filings(left, right).collect()] == ["1-2-3"]


def test_json_array_with_mixed_types(spark, tmp_path):
    path = _doc(tmp_path, "p.json", [{"Company": "A", "Date": "2020-03-31", "Revenues": 1.5}, {"Company": "A", "Date": "2020-06-30", "Revenues": "N/A"}])
    got = records.read_json_panel(spark, path, lines=False)
    assert [r.Revenues for r in got.collect()] == ["1.5", "N/A"] and got.first().Assets is None


def test_first_existing_artifact(spark, frame, tmp_path):
    files.write_artifact(frame("a int", (1,)), str(tmp_path / "b"))
    assert records.read_artifact(spark, str(tmp_path / "a"), str(tmp_path / "b")).count() == 1
    with pytest.raises(FileNotFoundError):
        records.read_artifact(spark, str(tmp_path / "a"))


def test_csv_text_for_missing(frame, tmp_path):
    files.write_csv(frame("a int, b string", (1, None)).coalesce(1), str(tmp_path / "c"))
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert text == "a,b\n1,N/A\n"


def test_json_text_for_missing(frame, tmp_path):
    files.write_json_records(frame("a int, b string", (1, None)), str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert json.loads(text) == {"a": "1", "b": "N/A"}


def test_two_targets_hold_the_same(spark, frame, tmp_path):
    files.write_twice(frame("a int", (1,), (2,)), str(tmp_path / "x"), str(tmp_path / "y"))
    assert spark.read.parquet(str(tmp_path / "x")).exceptAll(spark.read.parquet(str(tmp_path / "y"))).count() == 0


def test_entity_folders(spark, frame, tmp_path):
    rows = [("hot", i, f"{i * 7919 % 104729:x}" * 8) for i in range(20000)] + [("b", 1, "x")]
    df = frame("Company string, k int, v string", *rows).repartition(8)
    sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k"), ("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    for key, value in sizes:
        spark.conf.set(key, value)
    files.write_by_entity(df, str(tmp_path / "e"))
    for key, _ in sizes:
        spark.conf.unset(key)
    assert len(list((tmp_path / "e" / "Company=hot").glob("*.parquet"))) > 1  # a large entity is split
    assert spark.read.parquet(str(tmp_path / "e")).count() == 20001


def test_raw_sheet_is_sorted_across_files(spark, frame, tmp_path):
    rows = [(f"t{i % 3}", "10-Q", f"2020-0{i % 9 + 1}-01", float(i), "USD", f"{i}", "extra") for i in range(90)]
    df = frame("tag string, form string, end string, value double, uom string, accn string, helper string", *rows)
    files.write_raw_facts(df.repartition(5), str(tmp_path / "s"))
    parts = sorted((tmp_path / "s").glob("part-*.parquet"))
    keys = [(r.tag, r.end) for p in parts for r in spark.read.parquet(str(p)).collect()]
    assert keys == sorted(keys) and len(keys) == 90


def test_answers(spark, frame, tmp_path):
    files.write_answers(frame("k string, a string", ("x.json", "{}")), str(tmp_path / "a"), "k", "a")
    assert spark.read.json(str(tmp_path / "a")).first().asDict() == {"key": "x.json", "answer": "{}"}


PRED = "Company string, Date date, xgb_point double, Revenues double, actual double, seq int"
D1, D2 = dt.date(2000, 3, 31), dt.date(2001, 3, 31)


def _saved(spark, path):
    return {(r.Company, r.Date): r.xgb_point for r in upsert.read_predictions(spark, path).collect()}


def test_upsert_keeps_the_last_and_is_repeatable(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    upsert.upsert_predictions(frame(PRED, ("a", D1, 1.0, 5.0, 0.0, 1), ("b", D2, 2.0, 5.0, 0.0, 1), ("n", None, 3.0, 5.0, 0.0, 1)), path)
    new = frame(PRED, ("a", D1, 7.0, 5.0, 0.0, 2), ("a", D1, 6.0, 5.0, 0.0, 1), ("c", D1, 8.0, 5.0, 0.0, 1), ("n", None, 4.0, 5.0, 0.0, 1))
    for _ in range(2):
        upsert.upsert_predictions(new, path, order=["seq"])
        assert _saved(spark, path) == {("a", D1): 7.0, ("b", D2): 2.0, ("c", D1): 8.0, ("n", None): 4.0}


def test_upsert_rewrites_only_files_with_touched_keys(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    for i in range(6):  # six files of one year, and one of another
        upsert.upsert_predictions(frame(PRED, *[(f"c{i}-{k}", D1, 1.0, 5.0, 0.0, 1) for k in range(5)]).coalesce(1), path)
    upsert.upsert_predictions(frame(PRED, ("b", D2, 2.0, 5.0, 0.0, 1)), path)
    before = upsert.current_version(spark, path)
    assert len(before.files["2000"]) == 6
    upsert.upsert_predictions(frame(PRED, ("c2-3", D1, 3.0, 5.0, 0.0, 1), ("c4-0", D1, 4.0, 5.0, 0.0, 1), ("new", D1, 9.0, 5.0, 0.0, 1)), path)
    after = upsert.current_version(spark, path)
    assert after.number == before.number + 1 and after.files["2001"] == before.files["2001"]
    assert len(set(before.files["2000"]) - set(after.files["2000"])) == 2
    saved = _saved(spark, path)
    assert len(saved) == 32 and (saved["c2-3", D1], saved["c4-0", D1], saved["c4-1", D1], saved["new", D1]) == (3.0, 4.0, 1.0, 9.0)


def test_upsert_gathers_many_small_files(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    monkeypatch.setattr(upsert, "MOST_FILES", 3)
    for i in range(4):
        upsert.upsert_predictions(frame(PRED, (f"c{i}", D1, float(i), 5.0, 0.0, 1)), path)
    assert len(upsert.current_version(spark, path).files["2000"]) == 1 and len(_saved(spark, path)) == 4


def test_a_reader_in_the_middle_of_an_upsert_sees_the_old_version(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    upsert.upsert_predictions(frame(PRED, ("a", D1, 1.0, 5.0, 0.0, 1), ("b", D2, 2.0, 5.0, 0.0, 1)), path)
    opened = upsert.read_predictions(spark, path)
    publish, seen = upsert._publish, []

    def reads_first(session, table, version):
        seen.append(_saved(spark, path))
        publish(session, table, version)

    monkeypatch.setattr(upsert, "_publish", reads_first)
    upsert.upsert_predictions(frame(PRED, ("a", D1, 7.0, 5.0, 0.0, 1)), path)
    assert seen == [{("a", D1): 1.0, ("b", D2): 2.0}] and _saved(spark, path) == {("a", D1): 7.0, ("b", D2): 2.0}
    # a reader that opened the table before goes on with its version
    assert {r.Company: r.xgb_point for r in opened.collect()} == {"a": 1.0, "b": 2.0}


def test_two_writers_at_once_lose_nothing(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    upsert.upsert_predictions(frame(PRED, ("a", D1, 1.0, 5.0, 0.0, 1)), path)
    publish, others = upsert._publish, [frame(PRED, ("b", D1, 2.0, 5.0, 0.0, 1), ("a", D1, 5.0, 5.0, 0.0, 1))]

    def overtaken(session, table, version):
        if others:
            upsert.upsert_predictions(others.pop(), path)
        publish(session, table, version)

    monkeypatch.setattr(upsert, "_publish", overtaken)
    upsert.upsert_predictions(frame(PRED, ("c", D1, 3.0, 5.0, 0.0, 1)), path)
    assert _saved(spark, path) == {("a", D1): 5.0, ("b", D1): 2.0, ("c", D1): 3.0}
    others.append(frame(PRED, ("d", D1, 4.0, 5.0, 0.0, 1)))
    with pytest.raises(upsert.ConcurrentWrite):
        upsert.upsert_predictions(frame(PRED, ("e", D1, 6.0, 5.0, 0.0, 1)), path, attempts=1)
    assert ("e", D1) not in _saved(spark, path) and upsert.current_version(spark, path).number == 4


def test_vacuum_keeps_what_versions_name(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        upsert.upsert_predictions(frame(PRED, ("a", D1, float(i), 5.0, 0.0, 1)), path)
    assert upsert.vacuum(spark, path, versions=1) == 3
    assert _saved(spark, path) == {("a", D1): 3.0} and len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_saved_columns(frame):
    df = frame(PRED, ("a", D1, 1.0, 5.0, 0.0, 1))
    assert upsert.select_saved(df).columns == ["Company", "Date", "xgb_point", "Revenues"]
    assert "actual" in upsert.select_saved(df, keep=["actual"]).columns
    with pytest.raises(ValueError, match="Date"):
        upsert.select_saved(frame("Company string, xgb_point double", ("a", 1.0)))


def test_new_columns_are_null_for_old_rows(frame):
    old = frame("Company string, Date date, xgb_point double", ("a", D1, 1.0))
    new = frame("Company string, Date date, xgb_point double, pi_lower double", ("b", D1, 2.0, 0.5))
    got = {r.Company: r.pi_lower for r in upsert.merge_keep_last(old, new).collect()}
    assert got == {"a": None, "b": 0.5}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    path = new_folder(spark, "x")
    assert path.startswith(shared_folder(spark)) and not path_exists(spark, path)


def test_upsert_keeps_columns_of_every_batch(spark, frame, tmp_path):
    path = str(tmp_path / "table")
    base = "Company string, Date date, xgb_point double"
    day = dt.date
    upsert.upsert_predictions(frame(base, ("A", day(2000, 3, 31), 1.0)), path)
    upsert.upsert_predictions(frame(base + ", arima_naive double", ("A", day(2001, 3, 31), 2.0, 9.0)), path)
    upsert.upsert_predictions(frame(base, ("B", day(2001, 6, 30), 3.0)), path)
    rows = {(r.Company, r.Date.year): r.arima_naive for r in upsert.read_predictions(spark, path).collect()}
    assert rows == {("A", 2000): None, ("A", 2001): 9.0, ("B", 2001): None}


def test_a_broken_upsert_loses_nothing(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    base = "Company string, Date date, xgb_point int"  # stored as double
    rows = [("A", dt.date(y, 3, 31), y) for y in (2000, 2001, 2002)]
    upsert.upsert_predictions(frame(base, *rows), path)

    def breaks(session, table, version):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(upsert, "_publish", breaks)
        with pytest.raises(OSError):
            upsert.upsert_predictions(frame(base, *[(c, d, x + 1) for c, d, x in rows]), path)
    assert sorted((r.Date.year, r.xgb_point) for r in upsert.read_predictions(spark, path).collect()) == [(y, float(y)) for y in (2000, 2001, 2002)]
    upsert.upsert_predictions(frame(base, *[(c, d, x + 2) for c, d, x in rows]), path)
    assert sorted(r.xgb_point for r in upsert.read_predictions(spark, path).collect()) == [2002.0, 2003.0, 2004.0]


def test_answers_by_group(spark, frame, tmp_path):
    rows = frame("Company string, k string, a string", ("A", "A_1", "x"), ("A", "A_2", "y"), ("B", "B_1", "z"))
    path = files.write_answers(rows, str(tmp_path / "answers"), "k", "a", by=["Company"])
    assert {p.name for p in (tmp_path / "answers").glob("Company=*")} == {"Company=A", "Company=B"}
    assert {(r.Company, r.key, r.answer) for r in spark.read.json(path).collect()} == {("A", "A_1", "x"), ("A", "A_2", "y"), ("B", "B_1", "z")}
