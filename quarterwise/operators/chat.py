"""Chat records: building, splitting, packing, parsing and checking them as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterwise.functions.json import strict_json
from quarterwise.operators.neighbours import with_neighbours
from quarterwise.spec import EXOG

# The texts and key names of a record.
SYSTEM_LAST_ROW = (
    "You are a financial forecasting assistant. Combine baseline predictions and tiny history "
    "to forecast the next period and explain briefly."
)
SYSTEM_SERIES = (
    "You are a financial forecasting assistant. Combine baseline predictions and tiny history "
    "to forecast the next period and explain briefly. Always return a JSON object with keys "
    "'final_forecast' (number) and 'explanation' (string)."
)
SYSTEM_INFERENCE = (
    "You are a financial forecasting assistant. "
    "Output ONLY a JSON object with keys 'final_forecast' (number) and 'explanation' (short string). "
    "No extra text."
)
EXPLANATION_LAST_ROW = "Choosing a conservative blend of drift and XGB given rising OPEX and mixed gross profit."
EXPLANATION_SERIES = "Ground truth for supervised SFT."
BASELINES = ("arima_naive", "arima_drift", "xgb_point")
FEW_RECORDS, LIMITED_RECORDS = 5, 20
NO_TEXT = "null"

MESSAGE_SCHEMA = "struct<messages: array<struct<role: string, content: string>>>"
_KEEP_NULLS = {"ignoreNullFields": "false"}


def _message(role: str, content: Column) -> Column:
    return F.to_json(F.struct(F.lit(role).alias("role"), content.alias("content")), _KEEP_NULLS)


def _record(*messages: Column) -> Column:
    """One record as JSON text. Contents differ in type, so messages are joined as text; NULL ones are left out."""
    return F.concat(F.lit('{"messages":['), F.concat_ws(",", *messages), F.lit("]}"))


def last_row_records(df: DataFrame, kpi: str, entity: str = "Company") -> DataFrame:
    """One record per row, history from lag_2 and lag_1; missing baselines are explicit nulls."""
    history = F.filter(
        F.array(
            F.struct(F.lit(-2).alias("t"), F.col("lag_2").alias("value")),
            F.struct(F.lit(-1).alias("t"), F.col("lag_1").alias("value")),
        ),
        lambda h: h["value"].isNotNull(),
    )

    def numbers(names):
        return F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c) for c in names])

    user = F.struct(
        F.coalesce(F.col(entity), F.lit("UNKNOWN")).alias("company"),
        F.lit(kpi).alias("kpi"),
        history.alias("history"),
        numbers(BASELINES).alias("baselines"),
        numbers(EXOG).alias("exog"),
    )
    answer = F.struct(F.col(kpi).cast("double").alias("final_forecast"), F.lit(EXPLANATION_LAST_ROW).alias("explanation"))
    record = _record(_message("system", F.lit(SYSTEM_LAST_ROW)), _message("user", user), _message("assistant", answer))
    return df.withColumn("record", record)


def with_history(df: DataFrame, length: int = 2, slice_by: Column | None = None) -> DataFrame:
    """Per (Company, KPI): up to `length` earlier actuals as [{t, value}], t = -length..-1.

    Rows with nothing before them are dropped; an earlier row without an actual stays in
    the history with a null value. Quarterly histories are bounded by the calendar and stay
    whole; `slice_by`, such as the year, cuts long ones (see neighbours).
    """
    wanted = {f"__h{k}": (F.struct(F.col("actual").cast("double").alias("value")), -k) for k in range(length, 0, -1)}
    order = ["year", "quarter", F.xxhash64(*[c for c in ("actual", *BASELINES, *EXOG) if c in df.columns])]
    out = with_neighbours(df, ["Company", "KPI"], order, slice_by, wanted)
    entries = [
        F.when(F.col(h).isNotNull(), F.struct(F.lit(offset).alias("t"), F.col(h)["value"].alias("value")))
        for h, (_, offset) in wanted.items()
    ]
    history = F.filter(F.array(*entries), lambda h: h.isNotNull())
    return out.withColumn("history", history).drop(*wanted).where(F.size("history") > 0)


def _present(df: DataFrame, names) -> Column:
    """Map of the named columns that hold a value."""
    found = [c for c in names if c in df.columns]
    if not found:
        return F.create_map().cast("map<string,double>")
    pairs = [x for c in found for x in (F.lit(c), F.col(c).cast("double"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def series_records(df: DataFrame, history_len: int = 2) -> DataFrame:
    """One record per row that has history; the answer is there only if the actual is known."""
    rows = with_history(df, history_len)
    target = F.struct(F.col("year").cast("int").alias("year"), F.col("quarter").cast("int").alias("quarter"))
    payload = F.struct(
        F.col("Company").alias("company"),
        F.col("KPI").alias("kpi"),
        target.alias("target"),
        F.col("history"),
        _present(df, BASELINES).alias("baselines"),
        _present(df, EXOG).alias("exog"),
    )
    answer = F.struct(F.col("actual").cast("double").alias("final_forecast"), F.lit(EXPLANATION_SERIES).alias("explanation"))
    return rows.withColumns(
        {
            "payload": F.to_json(payload, _KEEP_NULLS),
            "record": _record(
                _message("system", F.lit(SYSTEM_SERIES)),
                _message("user", payload),
                F.when(F.col("actual").isNotNull(), _message("assistant", answer)),
            ),
        }
    )


def split_by_year(df: DataFrame, year_val: int = 2023, year: str = "year") -> DataFrame:
    """Earlier years "train", the given year "val"; later ones are dropped."""
    y = F.col(year)
    label = F.when(y < year_val, "train").when((y == year_val) & F.col("quarter").isin(1, 2, 3, 4), "val")
    return df.withColumn("split", label).where(F.col("split").isNotNull())


def chunk(role: Column, content: Column) -> Column:
    """One message as tagged text. A message without role or content stays, with NO_TEXT in its place."""
    role, content = F.coalesce(role, F.lit(NO_TEXT)), F.coalesce(content, F.lit(NO_TEXT))
    return F.concat(F.lit("<"), role, F.lit(">\n"), content, F.lit("\n</"), role, F.lit(">"))


def pack_messages(messages: Column) -> Column:
    """An array of {role, content} as one text; NULL messages are left out."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m.isNotNull()), lambda m: chunk(m["role"], m["content"])), "\n")


def _join_turns(df: DataFrame, piece: Column, separator: str, block: int) -> DataFrame:
    """One text per conversation from one piece per turn, in turn order.

    Pieces are first joined in blocks of turns, so a long conversation is put together
    by many tasks; the second step only joins finished blocks. The result is one row, so the
    text of one conversation has to fit into a task.
    """
    def joined(parts):
        return F.array_join(F.transform(parts, lambda m: m["piece"]), separator)

    pieces = df.select("conv_id", "turn", F.floor(F.col("turn") / block).alias("block"), piece.alias("piece"))
    blocks = pieces.groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).alias("n"), joined(F.sort_array(F.collect_list(F.struct("turn", "piece")))).alias("piece")
    )
    return blocks.groupBy("conv_id").agg(
        F.sum("n").alias("n_messages"), joined(F.sort_array(F.collect_list(F.struct("block", "piece")))).alias("text")
    )


def pack_conversations(df: DataFrame, block: int = 64) -> DataFrame:
    """Flat (conv_id, turn, role, text) rows to one packed text per conversation."""
    return _join_turns(df, chunk(F.col("role"), F.col("text")), "\n", block)


def conversation_records(df: DataFrame, block: int = 64) -> DataFrame:
    """The same rows to one record, as JSON text, per conversation."""
    message = F.to_json(F.struct("role", F.col("text").alias("content")), _KEEP_NULLS)
    joined = _join_turns(df, message, ",", block)
    return joined.select("conv_id", "n_messages", F.concat(F.lit('{"messages":['), "text", F.lit("]}")).alias("record"))


def role_counts(df: DataFrame) -> DataFrame:
    """Messages per role, from flat message rows."""
    return df.groupBy("role").agg(F.count(F.lit(1)).alias("n_messages"))


def explode_messages(records: DataFrame, parsed: str = "parsed") -> DataFrame:
    """One row per message of parsed records."""
    return records.select("*", F.posexplode(F.col(parsed)["messages"]).alias("position", "message")).select(
        *[c for c in records.columns if c != parsed], "position", "message.role", "message.content"
    )


def size_report(df: DataFrame) -> DataFrame:
    """Record count per split with a verdict on the whole."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "val").alias("n_val"),
    )
    verdict = F.when(F.col("n_total") < FEW_RECORDS, "very few").when(F.col("n_total") < LIMITED_RECORDS, "limited").otherwise("good")
    return counts.withColumn("verdict", verdict)


def inference_prompt(payload: Column) -> Column:
    """Prompt that asks for a bare JSON answer to one payload."""
    return F.concat(
        F.lit("<system>\n" + SYSTEM_INFERENCE + "\n</system>\n<user>\n"), payload, F.lit("\n</user>\n<assistant>\n")
    )


def first_user_message(records: Column) -> Column:
    """Content of the first user message of a messages array, NULL if there is none."""
    return F.get(F.filter(records, lambda m: m["role"] == "user"), 0)["content"]


def first_user_turns(df: DataFrame) -> DataFrame:
    """The same on flat message rows."""
    users = df.where(F.col("role") == "user").groupBy("conv_id")
    return users.agg(F.min("turn").alias("turn"), F.min_by("text", "turn").alias("content"))


def parse_answers(df: DataFrame, text: str = "answer", most_chars: int | None = None) -> DataFrame:
    """Read model answers leniently; adds `how`, `final_forecast`, `explanation`.

    whole: the text is JSON. repaired: the outermost {...}, trailing commas removed, is
    JSON. text: no braces, the explanation is the text, or its first `most_chars` characters.
    error: braces, but no JSON between them.
    """
    stripped = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    found = F.nullif(F.regexp_extract(stripped, r"(?s)\{.*\}", 0), F.lit(""))
    repaired = F.regexp_replace(found, r",\s*([}\]])", "$1")
    plain = F.col("__text") if most_chars is None else F.substring("__text", 1, most_chars)
    out = df.withColumns({"__whole": strict_json(stripped), "__part": strict_json(repaired), "__text": stripped, "__found": found})
    is_whole, is_part = F.col("__whole").isNotNull(), F.col("__part").isNotNull()
    how = F.when(is_whole, "whole").when(is_part, "repaired").when(F.col("__found").isNull(), "text").otherwise("error")
    json = F.when(is_whole, F.col("__whole")).when(is_part, F.col("__part"))
    return (
        out.withColumns(
            {
                "how": F.when(F.col(text).isNotNull(), how),
                "final_forecast": F.try_variant_get(json, "$.final_forecast", "double"),
                "explanation": F.coalesce(
                    F.try_variant_get(json, "$.explanation", "string"),
                    F.when(~is_whole & ~is_part & F.col("__found").isNull(), plain),
                ),
            }
        )
        .drop("__whole", "__part", "__text", "__found")
    )


def check_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Per line: is it JSON, has it a list of messages, has every message role and content?

    Keys are looked up in the parsed value, so a key that holds null counts as there.
    """
    v = strict_json(F.col(column))
    messages = F.try_variant_get("__v", "$.messages", "array<variant>")
    lacking = F.size(
        F.filter(
            "__m",
            lambda m: F.try_variant_get(m, "$.role", "variant").isNull() | F.try_variant_get(m, "$.content", "variant").isNull(),
        )
    )
    checked = lines.withColumn("__v", v).withColumn("__m", messages)
    return checked.withColumns(
        {
            "is_json": F.col("__v").isNotNull(),
            "has_messages": F.col("__m").isNotNull(),
            "n_messages": F.when(F.col("__m").isNotNull(), F.size("__m")).otherwise(0),
            "n_bad_messages": F.when(F.col("__m").isNotNull(), lacking).otherwise(0),
        }
    ).drop("__v", "__m")


def validation_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """Violation counts over all lines."""
    c = check_records(lines, column)
    return c.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(~F.col("is_json")).alias("n_not_json"),
        F.count_if(F.col("is_json") & ~F.col("has_messages")).alias("n_without_messages"),
        F.coalesce(F.sum("n_messages"), F.lit(0)).alias("n_messages"),
        F.coalesce(F.sum("n_bad_messages"), F.lit(0)).alias("n_bad_messages"),
        F.count_if(F.col("is_json") & F.col("has_messages") & (F.col("n_bad_messages") == 0)).alias("n_valid"),
    )
