"""Registered queries: chat records from predictions and from the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterwise.operators import chat, normalise, splits
from quarterwise.plans import views as v
from quarterwise.plans.sql import sql
from quarterwise.session import new_folder
from quarterwise.sinks import files
from quarterwise.sources import records as readers

YEAR_VAL = 2000
#: The last year of the predictions, for the files that hold every record.
LAST_YEAR = 2001
_USER = """struct<company: string, kpi: string, target: struct<year: int, quarter: int>,
    history: array<struct<t: int, value: double>>, baselines: map<string, double>, exog: map<string, double>>"""
_ANSWER = "struct<final_forecast: double, explanation: string>"
_EXOG = ["OperatingExpenses", "GrossProfit", "Assets", "StockholdersEquity"]
_BASE = ["arima_naive", "arima_drift", "xgb_point"]


def _opened(df, record="record"):
    """Parse record text back into columns."""
    m = F.from_json(F.col(record), chat.MESSAGE_SCHEMA)["messages"]
    out = df.withColumn("m", m)
    return out.withColumns(
        {
            "u": F.from_json(F.get("m", 1)["content"], _USER),
            "a": F.from_json(F.get("m", 2)["content"], _ANSWER),
        }
    )


def _fields(target):
    cols = {
        "n_messages": F.size("m"),
        "roles": F.array_join(F.transform("m", lambda x: x["role"]), ","),
        "system_text": F.get("m", 0)["content"],
        "company": F.col("u.company"),
        "kpi": F.col("u.kpi"),
        "history_t": F.array_join(F.transform("u.history", lambda h: h["t"].cast("string")), ","),
        "history_first": F.get("u.history", 0)["value"],
        "history_last": F.try_element_at("u.history", F.lit(-1))["value"],
        "n_baselines": F.size("u.baselines"),
        "n_exog": F.size("u.exog"),
        **{c: F.try_element_at("u.baselines", F.lit(c)) for c in _BASE},
        **{c: F.try_element_at("u.exog", F.lit(c)) for c in _EXOG},
        "final_forecast": F.col("a.final_forecast"),
        "explanation": F.col("a.explanation"),
    }
    if target:
        cols = {"target_year": F.col("u.target.year"), "target_quarter": F.col("u.target.quarter"), **cols}
    return [c.alias(n) for n, c in cols.items()]


def chat_rows_last(spark, sf):
    made = chat.last_row_records(v.fin_pred(spark, sf), "Revenues").select("Date", "record")
    return _opened(made).select("Date", *_fields(target=False))


def _normal(spark, sf):
    return normalise.normalise_predictions(v.predictions(spark, sf), "Revenues")


def chat_history(spark, sf):
    rows = chat.with_history(_normal(spark, sf))
    return rows.select("Company", "KPI", "year", "quarter", F.explode("history").alias("h")).select(
        "Company", "KPI", "year", "quarter", F.col("h.t").alias("t"), F.col("h.value").alias("value")
    )


def chat_examples(spark, sf):
    made = chat.series_records(_normal(spark, sf)).select("record")
    return _opened(made).select(*_fields(target=True))


def chat_split_year(spark, sf):
    made = chat.split_by_year(chat.series_records(_normal(spark, sf)), YEAR_VAL)
    return made.select("Company", "year", "quarter", "split")


def chat_prompt(spark, sf):
    """The prompt's fixed parts, and the fields of the payload between them."""
    rows = chat.series_records(_normal(spark, sf))
    parts = rows.select("year", "quarter", F.split(chat.inference_prompt(F.col("payload")), r"<user>\n|\n</user>").alias("parts"))
    read = parts.withColumns({"m": F.col("parts"), "u": F.from_json(F.get("parts", 1), _USER)})
    fields = {c: F.col(f"u.{c}") for c in ("company", "kpi")} | {
        "target_year": F.col("u.target.year"),
        "target_quarter": F.col("u.target.quarter"),
        "history_t": F.array_join(F.transform("u.history", lambda h: h["t"].cast("string")), ","),
        "history_first": F.get("u.history", 0)["value"],
        "history_last": F.try_element_at("u.history", F.lit(-1))["value"],
        **{c: F.try_element_at("u.baselines", F.lit(c)) for c in _BASE},
        **{c: F.try_element_at("u.exog", F.lit(c)) for c in _EXOG},
    }
    return read.select(
        F.get("parts", 0).alias("before"), F.get("parts", 2).alias("after"), F.size("parts").alias("n_parts"),
        *[c.alias(n) for n, c in fields.items()],
    )


def sink_chat_jsonl(spark, sf):
    path = new_folder(spark, "chat")
    files.write_chat(chat.split_by_year(chat.series_records(_normal(spark, sf)), LAST_YEAR), path)
    back = spark.read.schema("value string, split string").text(path)
    return _opened(back, "value").select("split", *_fields(target=True))


def chat_pack_text(spark, sf):
    return chat.pack_conversations(v.table(spark, sf, "conversations"))


def chat_role_counts(spark, sf):
    return chat.role_counts(v.table(spark, sf, "conversations"))


def chat_first_user(spark, sf):
    return chat.first_user_turns(v.table(spark, sf, "conversations"))


def _written_lines(spark, sf):
    path = new_folder(spark, "lines")
    chat.conversation_records(v.table(spark, sf, "conversations")).select("record").write.text(path)
    return path


def src_chat_jsonl(spark, sf):
    lines = readers.read_chat_lines(spark, _written_lines(spark, sf))
    return chat.explode_messages(lines).select("position", "role", "content")


def chat_pack_series(spark, sf):
    """Packing of series records, whose user and assistant contents are objects."""
    made = chat.series_records(_normal(spark, sf)).select("record")
    path = new_folder(spark, "series-lines")
    made.write.text(path)
    m = F.col("parsed")["messages"]
    lines = readers.read_chat_lines(spark, path).select(m.alias("m"), chat.pack_messages(m).alias("text"))
    packed = lines.withColumns({"u": F.from_json(F.get("m", 1)["content"], _USER), "pieces": F.split("text", r"</?(?:system|user|assistant)>")})
    return packed.select(
        F.col("u.company").alias("company"),
        F.col("u.target.year").alias("target_year"),
        F.col("u.target.quarter").alias("target_quarter"),
        F.size("pieces").alias("n_pieces"),
        F.get("pieces", 1).alias("system_text"),
        F.from_json(F.trim(F.get("pieces", 3)), _USER)["target"]["year"].alias("packed_year"),
        F.from_json(F.trim(F.get("pieces", 5)), _ANSWER)["final_forecast"].alias("packed_forecast"),
    )


def chat_pack_records(spark, sf):
    """Packing of records that were read from a file, message arrays included."""
    lines = readers.read_chat_lines(spark, _written_lines(spark, sf))
    m = F.col("parsed")["messages"]
    return lines.select(chat.pack_messages(m).alias("text"), chat.first_user_message(m).alias("first_user"))


def _damaged(spark, sf):
    """Records with faults by a fixed rule: cut short, no messages, messages without a role."""
    made = chat.conversation_records(v.table(spark, sf, "conversations"))
    r, i = F.col("record"), F.col("conv_id") % 10
    text = (
        F.when(i == 3, r.substr(F.lit(1), F.length(r) - 1))
        .when(i == 5, F.replace(r, F.lit('{"messages":'), F.lit('{"items":')))
        .when(i == 7, F.replace(r, F.lit('{"role":'), F.lit('{"speaker":')))
        .otherwise(r)
    )
    return made.select("conv_id", text.alias("value"))


def chat_check_records(spark, sf):
    return chat.check_records(_damaged(spark, sf)).drop("value")


def chat_validate(spark, sf):
    return chat.validation_report(_damaged(spark, sf))


def chat_size_report(spark, sf):
    made = chat.conversation_records(v.table(spark, sf, "conversations")).select("conv_id")
    return chat.size_report(splits.hash_split(made, ["conv_id"]))


def _answers(spark, sf):
    """Model answers made from the conversation texts: clean, wrapped, bare, broken."""
    n = F.col("turn").cast("string")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    text = (
        F.when(kind == 0, F.concat(F.lit(' {"final_forecast": '), n, F.lit('.5, "explanation": "short"}\n')))
        .when(kind == 1, F.concat("text", F.lit(' {"final_forecast": '), n, F.lit(', "explanation": "a",\n} done')))
        .when(kind == 2, F.col("text"))
        .when(kind == 3, F.concat(F.lit("{"), "text"))
        .when(kind == 4, F.concat(F.lit("{broken "), "text", F.lit("}")))
        .otherwise(n)
    )
    return v.table(spark, sf, "conversations").select("conv_id", "turn", text.alias("answer"))


def chat_parse_answer(spark, sf):
    return chat.parse_answers(_answers(spark, sf)).drop("answer")


QUERIES = {
    f.__name__: f
    for f in (
        chat_rows_last,
        chat_history,
        chat_examples,
        chat_split_year,
        chat_prompt,
        sink_chat_jsonl,
        chat_pack_text,
        chat_pack_records,
        chat_pack_series,
        chat_role_counts,
        chat_first_user,
        src_chat_jsonl,
        chat_check_records,
        chat_validate,
        chat_size_report,
        chat_parse_answer,
    )
}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EX = """, h AS (SELECT *, lag(Revenues, 1) OVER w AS h1, lag(Revenues, 2) OVER w AS h2,
      CAST(row_number() OVER w AS INTEGER) - 1 AS n_prior FROM fin_pred
      WINDOW w AS (PARTITION BY Company ORDER BY "year", "quarter")),
    e AS (SELECT * FROM h WHERE n_prior > 0)"""


def _count(names):
    return " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in names)


_EXAMPLE = f"""CAST("year" AS INTEGER) AS target_year, CAST("quarter" AS INTEGER) AS target_quarter,
    CAST(CASE WHEN Revenues IS NULL THEN 2 ELSE 3 END AS INTEGER) AS n_messages,
    CASE WHEN Revenues IS NULL THEN 'system,user' ELSE 'system,user,assistant' END AS roles,
    {_quote(chat.SYSTEM_SERIES)} AS system_text, Company AS company, 'Revenues' AS kpi,
    CASE WHEN n_prior = 1 THEN '-1' ELSE '-2,-1' END AS history_t,
    CASE WHEN n_prior = 1 THEN h1 ELSE h2 END AS history_first, h1 AS history_last,
    CAST({_count(_BASE)} AS INTEGER) AS n_baselines, CAST({_count(_EXOG)} AS INTEGER) AS n_exog,
    {', '.join(_BASE)}, {', '.join(_EXOG)}, Revenues AS final_forecast,
    CASE WHEN Revenues IS NOT NULL THEN {_quote(chat.EXPLANATION_SERIES)} END AS explanation"""
_SPLIT = f"""CASE WHEN "year" < {YEAR_VAL} THEN 'train' ELSE 'val' END AS split"""
_PROMPT = chat.SYSTEM_INFERENCE.replace("'", "''")
_CONV = """SELECT conv_id, count(*) AS n_messages, conv_id % 10 AS i FROM conversations GROUP BY conv_id"""

ORACLE = {
    "chat_rows_last": sql(
        f"""SELECT "Date", CAST(3 AS INTEGER) AS n_messages, 'system,user,assistant' AS roles,
              {_quote(chat.SYSTEM_LAST_ROW)} AS system_text, Company AS company, 'Revenues' AS kpi,
              concat_ws(',', CASE WHEN lag_2 IS NOT NULL THEN '-2' END, CASE WHEN lag_1 IS NOT NULL THEN '-1' END) AS history_t,
              coalesce(lag_2, lag_1) AS history_first, coalesce(lag_1, lag_2) AS history_last,
              CAST(3 AS INTEGER) AS n_baselines, CAST(4 AS INTEGER) AS n_exog, {', '.join(_BASE)}, {', '.join(_EXOG)},
              Revenues AS final_forecast, {_quote(chat.EXPLANATION_LAST_ROW)} AS explanation FROM fin_pred""",
        "fin_pred",
    ),
    "chat_history": sql(
        _EX
        + """ SELECT Company, 'Revenues' AS "KPI", "year", "quarter", CAST(-2 AS INTEGER) AS t, h2 AS "value" FROM e WHERE n_prior > 1
              UNION ALL SELECT Company, 'Revenues', "year", "quarter", -1, h1 FROM e""",
        "fin_pred",
    ),
    "chat_examples": sql(_EX + f" SELECT {_EXAMPLE} FROM e", "fin_pred"),
    "chat_split_year": sql(
        _EX + f""" SELECT Company, "year", "quarter", {_SPLIT} FROM e WHERE "year" <= {YEAR_VAL}""", "fin_pred"
    ),
    "chat_prompt": sql(
        _EX
        + f""" SELECT concat('<system>', chr(10), '{_PROMPT}', chr(10), '</system>', chr(10)) AS "before",
               concat(chr(10), '<assistant>', chr(10)) AS "after", CAST(3 AS INTEGER) AS n_parts, Company AS company, 'Revenues' AS kpi,
               CAST("year" AS INTEGER) AS target_year, CAST("quarter" AS INTEGER) AS target_quarter,
               CASE WHEN n_prior = 1 THEN '-1' ELSE '-2,-1' END AS history_t,
               CASE WHEN n_prior = 1 THEN h1 ELSE h2 END AS history_first, h1 AS history_last,
               {', '.join(_BASE)}, {', '.join(_EXOG)} FROM e""",
        "fin_pred",
    ),
    "sink_chat_jsonl": sql(
        _EX + f""" SELECT CASE WHEN "year" < {LAST_YEAR} THEN 'train' ELSE 'val' END AS split, {_EXAMPLE} FROM e""", "fin_pred"
    ),
    "chat_pack_text": """SELECT conv_id, count(*) AS n_messages,
        string_agg('<' || role || '>' || chr(10) || text || chr(10) || '</' || role || '>', chr(10) ORDER BY turn) AS text
        FROM conversations GROUP BY conv_id""",
    "chat_pack_records": """SELECT string_agg('<' || role || '>' || chr(10) || text || chr(10) || '</' || role || '>', chr(10) ORDER BY turn)
          AS text, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_user
        FROM conversations GROUP BY conv_id""",
    "chat_pack_series": sql(
        _EX
        + f""" SELECT Company AS company, CAST("year" AS INTEGER) AS target_year, CAST("quarter" AS INTEGER) AS target_quarter,
               CAST(CASE WHEN Revenues IS NULL THEN 5 ELSE 7 END AS INTEGER) AS n_pieces,
               concat(chr(10), {_quote(chat.SYSTEM_SERIES)}, chr(10)) AS system_text, CAST("year" AS INTEGER) AS packed_year,
               Revenues AS packed_forecast FROM e""",
        "fin_pred",
    ),
    "chat_role_counts": "SELECT role, count(*) AS n_messages FROM conversations GROUP BY role",
    "chat_first_user": """SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS content FROM conversations
        WHERE role = 'user' GROUP BY conv_id""",
    "src_chat_jsonl": """SELECT CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS "position", role, text AS content
        FROM conversations""",
    "chat_check_records": f"""SELECT conv_id, i <> 3 AS is_json, i NOT IN (3, 5) AS has_messages,
          CAST(CASE WHEN i IN (3, 5) THEN 0 ELSE n_messages END AS INTEGER) AS n_messages,
          CAST(CASE WHEN i = 7 THEN n_messages ELSE 0 END AS INTEGER) AS n_bad_messages FROM ({_CONV})""",
    "chat_validate": f"""SELECT count(*) AS n_lines, count(*) FILTER (WHERE i = 3) AS n_not_json,
          count(*) FILTER (WHERE i = 5) AS n_without_messages,
          CAST(coalesce(sum(n_messages) FILTER (WHERE i NOT IN (3, 5)), 0) AS BIGINT) AS n_messages,
          CAST(coalesce(sum(n_messages) FILTER (WHERE i = 7), 0) AS BIGINT) AS n_bad_messages,
          count(*) FILTER (WHERE i NOT IN (3, 5, 7)) AS n_valid FROM ({_CONV})""",
    "chat_size_report": """SELECT count(*) AS n_total, count(*) FILTER (WHERE NOT val) AS n_train, count(*) FILTER (WHERE val) AS n_val,
          CASE WHEN count(*) < 5 THEN 'very few' WHEN count(*) < 20 THEN 'limited' ELSE 'good' END AS verdict
        FROM (SELECT DISTINCT conv_id, substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) < '33333333' AS val FROM conversations)""",
    "chat_parse_answer": r"""WITH a AS (SELECT conv_id, turn, trim(CASE (conv_id + turn) % 6
            WHEN 0 THEN concat(' {"final_forecast": ', turn, '.5, "explanation": "short"}', chr(10))
            WHEN 1 THEN concat(text, ' {"final_forecast": ', turn, ', "explanation": "a",', chr(10), '} done')
            WHEN 2 THEN text WHEN 3 THEN concat('{', text) WHEN 4 THEN concat('{broken ', text, '}')
            ELSE CAST(turn AS VARCHAR) END, concat(' ', chr(10), chr(9), chr(13))) AS t FROM conversations),
        f AS (SELECT *, regexp_extract(t, '\{.*\}', 0, 's') AS found FROM a),
        p AS (SELECT *, regexp_replace(found, ',\s*([}\]])', '\1', 'g') AS part FROM f),
        j AS (SELECT *, CASE WHEN json_valid(t) THEN 'whole' WHEN found <> '' AND json_valid(part) THEN 'repaired'
            WHEN found = '' THEN 'text' ELSE 'error' END AS how FROM p),
        c AS (SELECT *, CASE how WHEN 'whole' THEN t WHEN 'repaired' THEN part END AS js FROM j)
        SELECT conv_id, turn, how, CAST(json_extract_string(js, '$.final_forecast') AS DOUBLE) AS final_forecast,
          CASE WHEN how = 'text' THEN t ELSE json_extract_string(js, '$.explanation') END AS explanation FROM c""",
}
