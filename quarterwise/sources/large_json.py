"""Objects inside JSON files of any size, one array or one document spread over many tasks.

Spark's JSON reader gives a multi-line file to one task. Here the file is read as text that is
cut at `}`, which Spark splits by byte ranges, and three running totals tell where each piece
stands: quotes seen (inside a string or not), braces open, objects ended. Totals are made
inside a range first, then over the ranges of a file, one row each, so that no task sees more
than its range:

  pieces (stored) -> per range: quotes, braces opened, for both ways a range may begin
                  -> over ranges: how each begins
  placed (stored) -> per range: objects ended, last keys -> over ranges: carried on
                  -> pieces of one object meet by its number

A backslash never stands before `}` as the first half of an escape in valid JSON, so a piece
holds whole escapes. The text is looked at once to count and once to place it, and stored after
each; it is shuffled for its order, twice, and to meet. Totals are made without it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterwise.operators.facts import TAGS
from quarterwise.session import materialise
from quarterwise.sources.filings import FACT_SCHEMA

_RANGE = ["file", "block"]
_SPLIT = "spark.sql.files.maxPartitionBytes"
_TASKS = "spark.sql.files.maxPartitionNum"
#: Tasks at least, before ranges of a size of their own share one.
_PACKED = 256


def _along(keys: list[str], order: str, to: int):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, to)


def _before(total: str) -> Column:
    """Sum over the earlier pieces of the range."""
    return F.coalesce(F.sum(total).over(_along(_RANGE, "pos", -1)), F.lit(0))


def _ranges_before(total: str) -> Column:
    """Sum over the earlier ranges of the file."""
    return F.coalesce(F.sum(total).over(_along(["file"], "block", -1)), F.lit(0))


def read_json_objects(
    spark: SparkSession, path: str, depth: int = 0, split_bytes: int | None = None, member: str | None = None
) -> DataFrame:
    """Objects that stand `depth` braces deep: file, doc, ord, keys, value, and `member` if asked for.

    `value` is the object's text. `doc` and `ord` count the documents and the objects of a
    file from 0, in their order. `keys` names the object that each of the `depth` + 1 nested
    objects, the outermost first, belongs to; objects in an array have the array's key, those
    without any have NULL. `member` is a text or number of the document's outermost object.

    At `depth` 0 a file may be one array, one object, or objects one after another. Values
    that are no object are passed over; an empty file has none. A file that ends too early or
    closes more than it opens is an error, as is a `}` within a key or within `member`.
    `split_bytes` sets the size of the ranges (the session's setting otherwise). Files are
    UTF-8 and, to be split, not compressed.
    """
    pieces = _pieces(spark, path, split_bytes)
    placed = _placed(pieces, depth, member is not None)
    levels = range(1, depth + 2) if depth else []
    placed = _with_keys(placed, levels)
    if member:
        placed = placed.withColumn("member", _member(member))
    # three totals read this, two of them without the text; what only closes a brace between objects counts nowhere
    counts = (F.col("ends") > 0) | (F.col("docs") > 0) | (F.col("b") > depth) | (F.col("o") > 0)
    if member:
        counts = counts | (F.col("b") <= 1)
    placed = materialise(placed.where(counts).drop("piece", "masked", "h", "b", "o"), "json-placed")
    last = {f"k{n}": F.max_by(f"k{n}", F.when(F.col(f"k{n}").isNotNull(), F.col("pos"))).alias(f"k{n}") for n in levels}
    totals = placed.groupBy(*_RANGE).agg(F.sum("ends").alias("ends"), F.sum("docs").alias("docs"), *last.values())
    carried = totals.select(
        *_RANGE,
        _ranges_before("ends").alias("ends0"),
        _ranges_before("docs").alias("docs0"),
        *[F.last(k, True).over(_along(["file"], "block", -1)).alias(f"{k}_0") for k in last],
    )
    here = _along(_RANGE, "pos", 0)
    numbered = placed.join(carried, _RANGE).withColumns(
        {
            "ord": F.col("ends0") + _before("ends"),
            "doc": F.col("docs0") + _before("docs"),
            "keys": F.array(*[F.coalesce(F.last(k, True).over(here), F.col(f"{k}_0")) for k in last]) if last else F.array(F.lit(None).cast("string")),
        }
    )
    at = F.struct("block", "pos")
    found = numbered.groupBy("file", "ord").agg(
        F.max_by("doc", at).alias("doc"),
        F.max_by("keys", at).alias("keys"),
        F.max("ends").alias("ended"),
        F.sort_array(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("block", "pos", "body")))).alias("bodies"),
    )
    value = F.concat(F.array_join(F.transform("bodies", lambda x: x["body"]), "}"), F.lit("}"))
    out = found.where("ended = 1").select("file", "doc", "ord", "keys", value.alias("value"))
    if member is None:
        return out
    named = numbered.where(F.col("member").isNotNull()).groupBy("file", "doc").agg(F.max_by("member", at).alias(member))
    return out.join(named, ["file", "doc"], "left")


def _pieces(spark: SparkSession, path: str, split_bytes: int | None) -> DataFrame:
    """Stored pieces in file order, with their bytes, quotes and the braces opened in their even and odd parts."""
    text = spark.read.option("lineSep", "}").text(path)
    raw = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("piece"),
    )
    counted = raw.withColumn("bare", _bare())
    counted = counted.withColumns({"quotes": _count("bare", '"'), "open": _count("bare", "{")})
    outside = F.regexp_replace("bare", '"[^"]*("|$)', "")
    counted = counted.withColumn("open0", F.when((F.col("open") == 0) | (F.col("quotes") == 0), F.col("open")).otherwise(_count(outside, "{")))
    counted = counted.select(
        *raw.columns, F.octet_length("piece").alias("bytes"), "quotes", "open0", (F.col("open") - F.col("open0")).alias("open1")
    )
    before, tasks = spark.conf.get(_SPLIT), spark.conf.get(_TASKS, None)
    if split_bytes:
        spark.conf.set(_SPLIT, str(split_bytes))
        # small ranges, many to a task; they stay ranges of their own
        spark.conf.set(_TASKS, str(max(_PACKED, 8 * spark.sparkContext.defaultParallelism)))
    try:
        return materialise(counted, "json-pieces")
    finally:
        spark.conf.set(_SPLIT, before)
        spark.conf.unset(_TASKS) if tasks is None else spark.conf.set(_TASKS, tasks)


def _bare() -> Column:
    """The piece with two plain characters for each escape."""
    return F.when(F.instr("piece", "\\") == 0, F.col("piece")).otherwise(F.regexp_replace("piece", r"(?s)\\.", "xx"))


def _parts() -> Column:
    """The text between quotes; escapes count as two plain characters."""
    return F.split(_bare(), '"')


def _count(text: Column | str, what: str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _step(inside: Column) -> Column:
    """By how much a piece changes the depth; the `}` behind it counts unless a string holds it."""
    return F.when(inside == 0, F.col("open0")).otherwise(F.col("open1")) - F.when((inside + F.col("quotes")) % 2 == 0, 1).otherwise(0)


def _placed(pieces: DataFrame, depth: int, member: bool) -> DataFrame:
    """Each piece with `h` (1: begins inside a string), `b` (depth before it), `o` (braces it opens), what it ends, and its `body`.

    `masked` is the piece with its strings masked as far as a brace that opens `depth` + 1 or less, or a member, is looked for.
    """
    flips = pieces.withColumn("flips", _before("quotes") % 2)
    ranges = flips.groupBy(*_RANGE).agg(
        (F.sum("quotes") % 2).alias("q"),
        *[F.sum(_step((F.col("flips") + h) % 2)).alias(f"step{h}") for h in (0, 1)],
        F.sum(F.col("bytes") + 1).alias("read"),
        F.max("size").alias("size"),
    )
    begun = ranges.withColumn("h0", _ranges_before("q") % 2)
    begun = begun.withColumn("step", F.when(F.col("h0") == 0, F.col("step0")).otherwise(F.col("step1")))
    # without a last `}` the piece at the end of the file closed nothing
    file = Window.partitionBy("file")
    left = F.sum("step").over(file) + F.when(F.sum("read").over(file) > F.max("size").over(file), 1).otherwise(0)
    whole = (left == 0) & (F.sum("q").over(file) % 2 == 0)
    depth0 = _ranges_before("step")
    checked = F.when(whole, depth0).otherwise(F.raise_error(F.concat(F.lit("not whole JSON: "), F.col("file"))).cast("bigint"))
    starts = begun.select(*_RANGE, "h0", checked.alias("depth0"))

    out = flips.join(starts, _RANGE).withColumn("h", (F.col("flips") + F.col("h0")) % 2)
    out = out.withColumn("step", _step(F.col("h")))
    out = out.withColumns(
        {
            "b": F.col("depth0") + _before("step"),
            "o": F.when(F.col("h") == 0, F.col("open0")).otherwise(F.col("open1")),
        }
    )
    # mostly a piece has no string, or opens its object before any: there is nothing to mask up to that brace
    plain = F.col("quotes") == 0
    if depth > 1 or not member:
        plain = plain | ((F.col("b") == depth) & (F.instr(_up_to(F.col("piece"), F.lit(1)), '"') == 0))
    masked = F.when((F.col("h") == 0) & plain, F.col("piece")).otherwise(_masked())
    out = out.withColumn("masked", F.when(F.col("b") <= depth, masked))
    after, closes = F.col("b") + F.col("step"), F.col("step") < F.col("o")
    opening = F.lit(depth + 1) - F.col("b")
    body = F.when(F.col("b") > depth, F.col("piece")).when(
        opening <= F.col("o"), F.substr("piece", F.length(_up_to(F.col("masked"), opening)) + 1)
    )
    return out.select(
        *_RANGE, "pos", "piece", "masked", "h", "b", "o",
        (closes & (after == depth)).cast("int").alias("ends"),
        (closes & (after == 0)).cast("int").alias("docs"),
        body.alias("body"),
    )


def _masked() -> Column:
    """The piece with every character inside a string replaced, its length unchanged."""
    return F.array_join(
        F.transform(_parts(), lambda s, i: F.when((i + F.col("h")) % 2 == 0, s).otherwise(F.repeat(F.lit("x"), F.length(s)))), '"'
    )


def _up_to(masked: Column, n: Column) -> Column:
    """What stands before the n-th brace."""
    return F.call_function("substring_index", masked, F.lit("{"), n.cast("int"))


def _plain(text: Column) -> Column:
    """The inside of a JSON string without its escapes."""
    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.from_json(F.concat(F.lit('["'), text, F.lit('"]')), T.ArrayType(T.StringType()))[0])


def _with_keys(placed: DataFrame, levels: Sequence[int]) -> DataFrame:
    """`k1`, `k2`...: the key before the brace that opens a level, NULL if the piece opens none or it has no key.

    In steps, as an expression that is used twice under a condition is also evaluated twice.
    """
    opened = {n: (F.col("b") < n) & (F.col("b") + F.col("o") >= n) for n in levels}
    out = placed.withColumns({f"_before{n}": F.when(opened[n], _up_to(F.col("masked"), F.lit(n) - F.col("b"))) for n in levels})
    tail = {n: F.regexp_extract(F.substring_index(F.col(f"_before{n}"), "{", -1), r'"[^"]*"\s*:[\s\[]*$', 0) for n in levels}
    out = out.withColumns({f"_tail{n}": F.when(F.col(f"_before{n}").isNotNull(), tail[n]) for n in levels})
    inside = lambda n: F.substr(
        "piece",
        F.length(f"_before{n}") - F.length(f"_tail{n}") + 2,
        F.length(F.substring_index(F.col(f"_tail{n}"), '"', 2)) - 1,
    )
    out = out.withColumns({f"_raw{n}": F.when(F.col(f"_tail{n}") != "", inside(n)) for n in levels})

    def key(n: int) -> Column:
        cut = F.col(f"_before{n}").isNotNull() & (F.col("h") == 1) & F.rlike(f"_before{n}", F.lit(r'^[^"]*"\s*:[\s\[]*$'))
        failed = F.raise_error(F.lit("a key holds a brace")).cast("string")
        return F.when(cut, failed).when(F.col(f"_raw{n}").isNotNull(), _plain(F.col(f"_raw{n}")))

    return out.withColumns({f"k{n}": key(n) for n in levels}).drop(*[f"_{c}{n}" for c in ("before", "tail", "raw") for n in levels])


def _member(name: str) -> Column:
    """Text or number of the outermost object's member, NULL in pieces without it."""
    shallow = F.when(F.col("b") == 1, _up_to(F.col("masked"), F.lit(1))).when(
        (F.col("b") == 0) & (F.col("o") > 0), _up_to(F.col("masked"), F.lit(2))
    )
    raw = F.substr("piece", F.lit(1), F.length(shallow))
    key = r'"\Q' + name + r'\E"\s*:\s*'
    text = F.regexp_extract(raw, key + r'"([^"\\]*(?:\\.[^"\\]*)*)"', 1)
    number = F.regexp_extract(raw, key + r"(-?[0-9][0-9.eE+-]*)", 1)
    cut = F.rlike(raw, F.lit(key + r'"[^"]*$')) & (F.length(raw) == F.length("piece"))
    return (
        F.when(cut, F.raise_error(F.lit(f"{name} holds a brace")).cast("string"))
        .when(F.rlike(raw, F.lit(key + '"')), _plain(text))
        .when(number != "", number)
    )


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, split_bytes: int | None = None) -> DataFrame:
    """Records of JSON arrays, each file read by as many tasks as it has ranges."""
    objects = read_json_objects(spark, path, 0, split_bytes)
    return objects.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_large_facts(
    spark: SparkSession, path: str, tags: Sequence[str] | None = TAGS, split_bytes: int | None = None
) -> DataFrame:
    """What `filings.read_company_facts` returns, a document read by as many tasks as it has ranges.

    `ord` numbers the facts of a file in document order.
    """
    objects = read_json_objects(spark, path, 5, split_bytes, member="Company")
    key = [F.col("keys")[i] for i in range(6)]
    wanted = (key[1] == "facts") & (key[2] == "us-gaap") & (key[4] == "units")
    if tags is not None:
        wanted = wanted & key[3].isin(*tags)
    found = objects.where(wanted).withColumn("r", F.from_json("value", FACT_SCHEMA))
    return found.select(
        "Company", key[3].alias("tag"), "r.form", "r.end", F.col("r.val").alias("value"), key[5].alias("uom"), "r.accn", "ord"
    )
