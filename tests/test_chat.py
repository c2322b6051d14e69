import json

import pytest
from pyspark.sql import functions as F

from quarterwise.operators import chat

PRED = "Company string, Revenues double, lag_1 double, lag_2 double, arima_naive double, xgb_point double, Assets double"


def test_last_row_record_is_valid_json(frame):
    df = frame(PRED, ("A \"b\"", 5.0, 2.0, None, 2.0, None, 1e12), (None, None, None, None, None, None, None))
    one, two = [json.loads(r.record)["messages"] for r in chat.last_row_records(df, "Revenues").collect()]
    assert [m["role"] for m in one] == ["system", "user", "assistant"]
    assert one[0]["content"] == chat.SYSTEM_LAST_ROW
    assert one[1]["content"]["company"] == 'A "b"' and one[1]["content"]["history"] == [{"t": -1, "value": 2.0}]
    assert one[1]["content"]["baselines"] == {"arima_naive": 2.0, "arima_drift": None, "xgb_point": None}
    assert one[1]["content"]["exog"]["Assets"] == 1e12
    assert two[1]["content"]["company"] == "UNKNOWN" and two[1]["content"]["history"] == []
    assert two[2]["content"]["final_forecast"] is None


SERIES = "Company string, KPI string, year int, quarter int, actual double, arima_naive double, Assets double"


def test_series_records(frame):
    df = frame(SERIES, *[("a", "K", 2022 + i // 4, i % 4 + 1, None if i == 1 else float(i), 1.0 if i != 3 else None, None) for i in range(6)], ("b", "K", 2023, 1, 1.0, 1.0, 1.0))
    got = {}
    for r in chat.series_records(df).collect():
        got[(r.Company, r.year, r.quarter)] = json.loads(r.record)["messages"]
    assert len(got) == 5 and ("b", 2023, 1) not in got and ("a", 2022, 1) not in got
    second = got[("a", 2022, 2)]
    assert second[1]["content"]["history"] == [{"t": -1, "value": 0.0}] and len(second) == 2
    third = got[("a", 2022, 3)]
    assert third[1]["content"]["history"] == [{"t": -2, "value": 0.0}, {"t": -1, "value": None}]
    assert third[2]["content"] == {"final_forecast": 2.0, "explanation": chat.EXPLANATION_SERIES}
    assert got[("a", 2022, 4)][1]["content"]["baselines"] == {} and third[1]["content"]["exog"] == {}
    assert third[1]["content"]["target"] == {"year": 2022, "quarter": 3}


@pytest.mark.parametrize("length", [1, 3, 5])
def test_history_length(frame, length):
    df = frame(SERIES, *[("a", "K", 2000 + i // 4, i % 4 + 1, float(i), None, None) for i in range(12)])
    for r in chat.with_history(df, length).collect():
        i = (r.year - 2000) * 4 + r.quarter - 1
        want = [(j - min(i, length), float(i - min(i, length) + j)) for j in range(min(i, length))]
        assert [(h.t, h.value) for h in r.history] == want


def test_split_by_year(frame):
    df = frame("year int, quarter int", (2022, 1), (2023, 4), (2024, 1), (None, 1))
    assert [(r.year, r.split) for r in chat.split_by_year(df).collect()] == [(2022, "train"), (2023, "val")]


def test_pack_in_turn_order_over_blocks(spark, frame):
    rows = [(1, i, "user" if i % 2 else "assistant", f"text {i}") for i in range(200)] + [(2, 0, "system", "x")]
    got = {r.conv_id: r for r in chat.pack_conversations(frame("conv_id bigint, turn bigint, role string, text string", *rows).repartition(7), 16).collect()}
    assert got[1].n_messages == 200 and got[2].text == "<system>\nx\n</system>"
    assert got[1].text == "\n".join(f"<{r}>\n{t}\n</{r}>" for _, _, r, t in rows[:200])


def test_pack_leaves_out_null_messages(spark):
    df = spark.sql("select array(named_struct('role','user','content','hi'), null) as m")
    assert df.select(chat.pack_messages(F.col("m"))).first()[0] == "<user>\nhi\n</user>"


def test_first_user(spark):
    df = spark.sql("select array(named_struct('role','system','content','s'), named_struct('role','user','content','u')) m union all select array()")
    assert [r[0] for r in df.select(chat.first_user_message(F.col("m"))).collect()] == ["u", None]


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"final_forecast": 1.5, "explanation": "ok"}', ("whole", 1.5, "ok")),
        ('Sure! {"final_forecast": 2, "explanation": "ok",} bye', ("repaired", 2.0, "ok")),
        ('x {"a": [1, 2, ], "final_forecast": null} y', ("repaired", None, None)),
        ("  no json here ", ("text", None, "no json here")),
        ("y" * 300, ("text", None, "y" * 300)),
        ("{ broken }", ("error", None, None)),
        ('{"final_forecast": 1} trailing', ("repaired", 1.0, None)),
        ('line\n{"final_forecast":\n 3}\nend', ("repaired", 3.0, None)),
        ("42", ("whole", None, None)),
        ("42 apples", ("text", None, "42 apples")),
        ("1, 2", ("text", None, "1, 2")),
        ("1] , [2", ("text", None, "1] , [2")),
        ("null", ("whole", None, None)),
        ('1} {"final_forecast": 2', ("text", None, '1} {"final_forecast": 2')),
        ("", ("text", None, "")),
        (None, (None, None, None)),
    ],
)
def test_parse_answers(frame, text, want):
    r = chat.parse_answers(frame("answer string", (text,))).first()
    assert (r.how, r.final_forecast, r.explanation) == want


LINES = [
    ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": {"x": 1}}]}', (True, True, 2, 0)),
    ('{"messages": [{"content": "a"}, {"role": "user"}]}', (True, True, 2, 2)),
    ('{"messages": [{"role": null, "content": null}]}', (True, True, 1, 0)),
    ('{"messages": []}', (True, True, 0, 0)),
    ('{"messages": "text"}', (True, False, 0, 0)),
    ('{"other": 1}', (True, False, 0, 0)),
    ('{"messages": []} and more', (False, False, 0, 0)),
    ("not json", (False, False, 0, 0)),
    ("", (False, False, 0, 0)),
]


@pytest.mark.parametrize("line,want", LINES)
def test_check_records(frame, line, want):
    r = chat.check_records(frame("value string", (line,))).first()
    assert (r.is_json, r.has_messages, r.n_messages, r.n_bad_messages) == want


def test_validation_report(frame):
    r = chat.validation_report(frame("value string", *[(line,) for line, _ in LINES])).first()
    assert (r.n_lines, r.n_not_json, r.n_without_messages, r.n_messages, r.n_bad_messages, r.n_valid) == (9, 3, 2, 5, 2, 3)


@pytest.mark.parametrize("n,verdict", [(0, "very few"), (4, "very few"), (5, "limited"), (19, "limited"), (20, "good")])
def test_size_report(frame, n, verdict):
    r = chat.size_report(frame("split string", *[("train" if i else "val",) for i in range(n)])).first()
    assert (r.n_total, r.verdict) == (n, verdict) and r.n_train + r.n_val == n


def test_prompt(frame):
    text = frame("p string", ('{"a":1}',)).select(chat.inference_prompt(F.col("p"))).first()[0]
    assert text.startswith("<system>\nYou are") and text.endswith('<user>\n{"a":1}\n</user>\n<assistant>\n')


def test_length_of_a_bare_answer_is_a_parameter(frame):
    assert chat.parse_answers(frame("answer string", ("y" * 300,)), most_chars=7).first().explanation == "y" * 7


def test_turns_without_text_stay_in_the_packed_text(frame):
    turns = frame("conv_id long, turn int, role string, text string", (1, 0, "user", None), (1, 1, None, "hi"), (1, 2, "user", "x"))
    packed = chat.pack_conversations(turns).first()
    assert packed.n_messages == 3
    assert packed.text == "<user>\nnull\n</user>\n<null>\nhi\n</null>\n<user>\nx\n</user>"


def test_split_query_leaves_later_years_to_the_operator(spark, monkeypatch):
    from quarterwise.plans import chats

    given, split = [], chat.split_by_year
    monkeypatch.setattr(chats.chat, "split_by_year", lambda df, year: given.append(df) or split(df, year))
    chats.chat_split_year(spark, "/root/testdata/sf0.001")
    assert given[0].where(F.col("year") > chats.YEAR_VAL).limit(1).count() == 1
