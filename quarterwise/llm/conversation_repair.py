"""Conversation structure repair by iterative-deepening A*.

The rows of a conversation, in order, are turned into a well-formed one by edits: Keep, Rerole (to the
role that is due), Delete, Insert (an empty turn of the role that is due). Role initials of the result
read `(s?(ua)+)?`; blank rows and repeats of an earlier (role, text) have to be deleted. The search is
depth-first in ASCII order of the edits (D, I, K, R) under a cost bound; when it fails, the bound rises to
the least cost that went beyond it. A transposition table remembers for every failed (row, state)
the cost that is known to be needed from there, so the first path that is accepted is the cheapest,
and the ASCII-least of the cheapest.

Conversations of up to `most_rows` rows and `most_bytes` bytes are solved where a shuffle by conversation and a
sort bring them together, one at a time. Longer ones are cut into stretches of `STRETCH` rows of a global order. The same
search finds the cost of every stretch from each state to each state; a streamed scan adds these from the end; then
every stretch is searched for each state it may begin in, with the cost that comes after it, and a
second scan tells which of these it is. No task holds more of a long conversation than a stretch.

Rows are ordered by (turn, role, text), NULL turns first. Defined results: a NULL role or text counts as one space. A role that is
empty or begins with another letter than s, u, a cannot be kept. Rows of a NULL conv_id are one conversation. Rows with
`present` false leave their conversation in the result and nothing else. Rows that are equal in all columns are
repeats of each other. An empty table gives an empty result; columns other than conv_id, turn, role, text and present are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterwise.llm.frames import rows_of, stored

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state that an inserted or reroled turn leads to.
DUE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state that a kept row leads to, by its initial.
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
LEGAL = ("su", "ua", "au")
#: Turns that have to be inserted at the end.
TAIL = (0, 2, 1, 0)
BLANKS = " \t\n\v\f\r"
ENDS = (".", "!", "?")
SOUND, BLANK, REPEAT, CUT = range(4)
NEVER = 1 << 40
#: Rows of a stretch of a long conversation, as a power of two.
STRETCH_BITS = 8
MOST_ROWS = 512
MOST_BYTES = 16_000_000


@dataclass(frozen=True)
class Costs:
    delete: int = 4
    insert: int = 3
    rerole: int = 3
    cut: int = 3

    def tail(self) -> list[int]:
        """The cost of ending in each state."""
        return [n * self.insert for n in TAIL]


@dataclass
class Search:
    """Cheapest edits of a stretch of (initial, fault) rows; `exits` is the cost of what follows, by the state it ends in."""

    rows: Sequence[tuple[str, int]]
    exits: Sequence[int]
    costs: Costs = field(default_factory=Costs)

    def __post_init__(self) -> None:
        c, n = self.costs, len(self.rows)
        least = [c.delete if f in (BLANK, REPEAT) else min(c.cut, c.delete) if f == CUT else 0 for _, f in self.rows]
        #: What is needed at least from (row, state): the heuristic, then what failed searches have shown.
        self.needed: list[list[int]] = [list(self.exits)]
        ahead, after = [x < NEVER for x in self.exits], min(self.exits)
        for i in range(n - 1, -1, -1):
            after += least[i]
            here = [any(ahead[t] for _, _, j, t in self._edits(i, s) if j > i) for s in STATES]
            for _ in range(2):
                here = [here[s] or here[DUE[s]] for s in STATES]
            self.needed.append([after if x else NEVER for x in here])
            ahead = here
        self.needed.reverse()

    def _edits(self, i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(edit, cost, next row, next state) in ASCII order."""
        if i == len(self.rows):
            return []
        c, (initial, fault) = self.costs, self.rows[i]
        out = [("D", c.delete, i + 1, state), ("I", c.insert, i, DUE[state])]
        if fault in (SOUND, CUT):
            more = c.cut if fault == CUT else 0
            kept = KEPT[initial][state] if initial in KEPT else None
            if kept is not None:
                out.append(("K", more, i + 1, kept))
            out.append(("R", c.rerole + more, i + 1, DUE[state]))
        return out

    def cost(self, entry: int) -> int:
        return self.path(entry)[0]

    def path(self, entry: int) -> tuple[int, str, int]:
        """(cost, edits, state at the end) of the cheapest path, the ASCII-least of several; NEVER if there is none."""
        while (bound := self.needed[0][entry]) < NEVER:
            found = self._within(entry, bound)
            if found is not None:
                return bound, *found
        return NEVER, "", entry

    def _within(self, entry: int, bound: int) -> tuple[str, int] | None:
        """The first accepted path that costs no more than `bound`; otherwise `needed` rises at the entry."""
        needed, end = self.needed, len(self.rows)
        # open nodes: edit that led there, row, state, budget left, edits not tried yet, least cost of those that failed
        line: list[list] = [["", 0, entry, bound, iter(self._edits(0, entry)), NEVER]]
        while line:
            node = line[-1]
            _, i, state, left, edits, _ = node
            if i == end:
                return "".join(x[0] for x in line), state  # only those whose exit is within the budget get here
            for edit, cost, j, then in edits:
                least = cost + needed[j][then]
                if least <= left:
                    line.append([edit, j, then, left - cost, iter(self._edits(j, then)), NEVER])
                    break
                node[5] = min(node[5], least)
            else:
                needed[i][state] = max(needed[i][state], node[5])
                line.pop()
                if line:
                    line[-1][5] = min(line[-1][5], line[-1][3] - left + needed[i][state])
        return None


def steps_of(edits: str, entry: int, initials: Sequence[str]) -> tuple[list[str], list[str]]:
    """Per row: its edits (inserts before it first), and the state after each edit that sets a role, else '-'."""
    steps, states, state = [""], [""], entry
    for edit in edits:
        if edit in "IR":
            state = DUE[state]
        elif edit == "K":
            state = KEPT[initials[len(steps) - 1]][state]
        steps[-1] += edit
        states[-1] += str(state) if edit in "IR" else "-"
        if edit != "I":
            steps.append("")
            states.append("")
    return steps[:-1], states[:-1]


def _faults(rows: Sequence[tuple]) -> list[int]:
    seen, out = set(), []
    for _, role, text in rows:
        ending = text.rstrip(BLANKS)
        fault = BLANK if not ending else REPEAT if (role, text) in seen else SOUND if ending.endswith(ENDS) else CUT
        seen.add((role, text))
        out.append(fault)
    return out


def repair_one(rows: Sequence[tuple], costs: Costs = Costs()) -> dict:
    """Counts, cost and turns of one conversation of ordered (turn, role, text) rows."""
    faults, initials = _faults(rows), [role[:1] for _, role, _ in rows]
    cost, edits, end = Search(list(zip(initials, faults)), costs.tail(), costs).path(START)
    turns = []
    for (_, role, text), step, states in zip(rows, *steps_of(edits, START, initials)):
        for edit, state in zip(step, states):
            turns.append({"edit": edit, "role": role if state == "-" else ROLE[int(state)], "text": "" if edit == "I" else text})
    for _ in range(TAIL[end]):
        end = DUE[end]
        turns.append({"edit": "I", "role": ROLE[end], "text": ""})
    known = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        "blank": faults.count(BLANK),
        "duplicate": faults.count(REPEAT),
        "truncated": faults.count(CUT),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "turns": turns,
    }


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = "array<struct<edit:string,role:string,text:string>>"
_ORDER = ("turn", "role", "text")


def _schema(conv: T.StructField, fields: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv.dataType), *T._parse_datatype_string(fields).fields])


def _arrow_turns() -> pa.DataType:
    return pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))


def _streamed(batches: Iterator[pa.RecordBatch], columns: list[str], text: str) -> Iterator[tuple]:
    for batch in rows_of(batches, columns, text=text):
        yield from zip(*[batch.column(c).to_pylist() for c in columns])


def _ordinary(rows: DataFrame, conv: T.StructField, costs: Costs) -> DataFrame:
    """(conv_id, part, counts, turns), each conversation solved as the sorted rows stream by."""
    columns = ["conv_id", "turn", "role", "text", "present"]
    schema = _schema(conv, "part long, " + ", ".join(f"{c} long" for c in _COUNTS) + f", turns {_TURNS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, solved, ids, size = pa.null(), [], [], 0

        def out() -> pa.RecordBatch:
            arrays = [pa.array(ids, kind), pa.array([0] * len(ids), pa.int64())]
            arrays += [pa.array([x[c] for x in solved], pa.int64()) for c in _COUNTS]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([x["turns"] for x in solved], _arrow_turns())], names=schema.names)

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in source:
                kind = batch.column("conv_id").type
                yield batch

        held: list[tuple] = []
        now: tuple | None = None
        for conv_id, turn, role, text, present in _streamed(typed(batches), columns, "text"):
            if now != (conv_id,):
                if now is not None:
                    ids.append(now[0])
                    solved.append(repair_one(held, costs))
                    size += sum(len(x[2]) for x in held) + 100
                    if size > 4_000_000:
                        yield out()
                        solved, ids, size = [], [], 0
                held, now = [], (conv_id,)
            if present:
                held.append((turn, role, text))
        if now is not None:
            ids.append(now[0])
            solved.append(repair_one(held, costs))
            yield out()

    together = rows.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return together.mapInArrow(run, schema)


def _visible_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def _stretches(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their text and place, stretches with their rows in order) of long conversations."""
    order = ["conv_id", F.asc_nulls_first("turn"), "role"]
    # a prefix of the text keeps the order and the samples of the range boundaries small
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    placed = stored(dealt.withColumn("pos", F.monotonically_increasing_id()), "turns-in-order")
    placed = placed.withColumn("stretch", F.shiftright("pos", STRETCH_BITS))
    end = _visible_end(F.col("text"))
    small = placed.select(
        "conv_id",
        "pos",
        "stretch",
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        (end == "").alias("is_blank"),
        F.substring(end, -1, 1).isin(*ENDS).alias("ended"),
        F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256).alias("digest"),
    )
    repeats = small.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("g")).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    faulty = small.join(repeats, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("g")), "left").withColumn(
        "fault", F.when(F.col("is_blank"), BLANK).when(F.col("pos") > F.col("first"), REPEAT).when(F.col("ended"), SOUND).otherwise(CUT)
    )
    gathered = faulty.groupBy("conv_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "initial", "fault"))).alias("rows"))
    return placed, stored(gathered, "stretches")


def _searched(stretches: DataFrame, conv: T.StructField, costs: Costs) -> DataFrame:
    """Per stretch: its cost from each state to each state, and what its counts need."""
    schema = _schema(
        conv, "stretch long, matrix array<long>, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first long, last long, head string, end string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema.names[2:]]
            for rows in batch.column("rows").to_pylist():
                pairs = [(r["initial"], r["fault"]) for r in rows]
                towards = [Search(pairs, [0 if s == end else NEVER for s in STATES], costs) for end in STATES]
                faults, turns = [f for _, f in pairs], [r["turn"] for r in rows if r["turn"] is not None]
                illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(pairs, pairs[1:]))
                found = [[t.cost(s) for s in STATES for t in towards], *[faults.count(f) for f in (BLANK, REPEAT, CUT)], illegal, len(set(turns))]
                # NULL turns come first, so `first` is the least known turn wherever the stretch before has a known one
                found += [min(turns), max(turns), turns[0], turns[-1]] if turns else [None] * 4
                for column, x in zip(out, [*found, pairs[0][0], pairs[-1][0]]):
                    column.append(x)
            kinds = [pa.list_(pa.int64()), *[pa.int64()] * 9, pa.string(), pa.string()]
            arrays = [pa.array(x, k) for x, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("stretch"), *arrays], names=schema.names)

    return stretches.select("conv_id", "stretch", "rows").mapInArrow(run, schema)


def _costs_ahead(summaries: DataFrame, conv: T.StructField, costs: Costs) -> DataFrame:
    """Streamed from the last stretch to the first: the cost of what follows each; and per conversation its counts (stretch NULL)."""
    names = ["conv_id", *summaries.columns[1:]]
    schema = _schema(conv, "stretch long, ahead array<long>, " + ", ".join(f"{c} long" for c in _COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ahead, told, after = None, [], {}, {}
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if now != (row["conv_id"],):
                    if now is not None:
                        out.append(total(now[0], ahead, told))
                    now, ahead, after = (row["conv_id"],), costs.tail(), {}
                    told = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"low": None, "high": None}
                out.append((row["conv_id"], row["stretch"], ahead, *[None] * 6))
                m = row["matrix"]
                ahead = [min(NEVER, *(m[4 * s + t] + ahead[t] for t in STATES)) for s in STATES]
                for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    told[c] += row[c]
                if after:
                    told["illegal"] += row["end"] + after["head"] not in LEGAL
                    told["turns"] -= row["last"] is not None and row["last"] == after["first"]
                if row["low"] is not None:
                    told["low"] = row["low"]
                    told["high"] = row["high"] if told["high"] is None else told["high"]
                after = row
            yield written(out, batch.column("conv_id").type)
        if now is not None:
            yield written([total(now[0], ahead, told)], batch.column("conv_id").type)

    def total(conv_id, ahead: list[int], told: dict) -> tuple:
        gaps = told["high"] - told["low"] + 1 - told["turns"] if told["low"] is not None else 0
        return (conv_id, None, None, gaps, told["blank"], told["duplicate"], told["truncated"], told["illegal"], ahead[START])

    def written(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 6]
        columns = list(zip(*out)) if out else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names=schema.names)

    return summaries.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("stretch")).mapInArrow(run, schema)


_PATHS = "ends array<int>, steps array<array<string>>, states array<array<string>>"


def _paths(stretches: DataFrame, ahead: DataFrame, conv: T.StructField, costs: Costs) -> DataFrame:
    """Per stretch and state it may begin in: the state it ends in, and the edits of each row."""
    schema = _schema(conv, f"stretch long, at long, {_PATHS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for rows, exits in zip(batch.column("rows").to_pylist(), batch.column("ahead").to_pylist()):
                search = Search([(r["initial"], r["fault"]) for r in rows], exits, costs)
                ends, steps, states = [], [], []
                for entry in STATES:
                    _, edits, end = search.path(entry)
                    one = steps_of(edits, entry, [r["initial"] for r in rows])
                    ends.append(end)
                    steps.append(one[0])
                    states.append(one[1])
                for column, x in zip(out, [rows[0]["pos"], ends, steps, states]):
                    column.append(x)
            text = pa.list_(pa.list_(pa.string()))
            arrays = [pa.array(x, k) for x, k in zip(out, [pa.int64(), pa.list_(pa.int32()), text, text])]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("stretch"), *arrays], names=schema.names)

    same = F.col("s.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("s.stretch") == F.col("a.stretch"))
    both = stretches.alias("s").join(ahead.alias("a"), same).select("s.conv_id", "s.stretch", "rows", "ahead")
    return both.mapInArrow(run, schema)


def _entries(paths: DataFrame, conv: T.StructField) -> DataFrame:
    """Streamed from the first stretch to the last: the state each begins in, and the turns to insert at the end of the last."""
    schema = _schema(conv, "stretch long, entry int, tail int, tail_state int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, before = pa.null(), None  # (conv_id, stretch, entry, end) whose successor has not come yet

        def written(out: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), *[pa.int32()] * 3]
            columns = list(zip(*out)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names=schema.names)

        for batch in batches:
            kind, out = batch.column("conv_id").type, []
            for conv_id, stretch, ends in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "stretch", "ends")]):
                goes_on = before is not None and before[0] == conv_id
                if before is not None:
                    out.append((*before[:3], 0 if goes_on else TAIL[before[3]], before[3]))
                entry = before[3] if goes_on else START
                before = (conv_id, stretch, entry, ends[entry])
            yield written(out)
        if before is not None:
            yield written([(*before[:3], TAIL[before[3]], before[3])])

    return paths.select("conv_id", "stretch", "ends").repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(run, schema)


def _role(state: Column, own: Column) -> Column:
    return F.when(state == "-", own).when(state == str(USER), F.lit(ROLE[USER])).otherwise(F.lit(ROLE[ASSISTANT]))


def _long(rows: DataFrame, conv: T.StructField, costs: Costs) -> DataFrame:
    """(conv_id, part, counts, turns) of long conversations, a row per stretch."""
    placed, stretches = _stretches(rows)
    ahead = stored(_costs_ahead(_searched(stretches, conv, costs), conv, costs), "costs-ahead")
    paths = stored(_paths(stretches, ahead.where(F.col("stretch").isNotNull()).select("conv_id", "stretch", "ahead"), conv, costs), "paths")
    entries = _entries(paths, conv)
    same = F.col("p.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("p.stretch") == F.col("e.stretch"))
    of_entry = lambda c: F.get(c, F.col("entry")).alias(c)
    chosen = paths.alias("p").join(entries.alias("e"), same).select("p.conv_id", "p.stretch", "at", of_entry("steps"), of_entry("states"), "tail", "tail_state")
    same = F.col("r.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("r.stretch") == F.col("k.stretch"))
    row = (F.col("pos") - F.col("at")).cast("int")
    stepped = placed.alias("r").join(chosen.alias("k"), same).select(
        "r.conv_id", "r.stretch", "pos", "role", "text", F.get("steps", row).alias("step"), F.get("states", row).alias("state"), "tail", "tail_state"
    )

    def item(k: Column) -> Column:
        edit = F.substring(F.col("step"), k, F.lit(1))
        role = _role(F.substring(F.col("state"), k, F.lit(1)), F.col("role"))
        return F.struct(edit.alias("edit"), role.alias("role"), F.when(edit == "I", F.lit("")).otherwise(F.col("text")).alias("text"))

    items = stepped.withColumn("items", F.transform(F.sequence(F.lit(1), F.length("step")), item))
    gathered = items.groupBy("conv_id", "stretch").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "items"))), lambda x: x["items"])).alias("turns"),
        F.max("tail").alias("tail"),
        F.max("tail_state").alias("tail_state"),
    )
    inserted = lambda role: F.struct(F.lit("I").alias("edit"), F.lit(role).alias("role"), F.lit("").alias("text"))
    tail = (
        F.when(F.col("tail") == 2, F.array(inserted(ROLE[USER]), inserted(ROLE[ASSISTANT])))
        .when(F.col("tail") == 1, F.array(inserted(ROLE[ASSISTANT])))
        .otherwise(F.array().cast(_TURNS))
    )
    counts = ahead.where(F.col("stretch").isNull()).select(F.col("conv_id").alias("c"), *_COUNTS)
    told = gathered.withColumn("turns", F.concat("turns", tail)).join(counts, F.col("conv_id").eqNullSafe(F.col("c")))
    return told.select("conv_id", F.col("stretch").alias("part"), *_COUNTS, F.col("turns").cast(_TURNS).alias("turns"))


def _parts(rows: DataFrame, costs: Costs, most_rows: int, most_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Results of the ordinary conversations, and of the long ones if there are any."""
    conv = rows.schema["conv_id"]
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in rows.columns else F.lit(True)
    whole = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], present.alias("present")
    )
    sizes = whole.groupBy(F.col("conv_id").alias("long_id")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long_ones = stored(sizes.where((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select(F.struct("long_id").alias("long")), "long-conversations")
    if long_ones.isEmpty():
        return _ordinary(whole, conv, costs), None
    same = F.col("conv_id").eqNullSafe(F.col("long.long_id"))
    ordinary = _ordinary(whole.join(long_ones, same, "left_anti"), conv, costs)
    # a conversation of which no row is present stays as one empty part
    return ordinary, whole.join(long_ones, same, "left_semi")


def repair(rows: DataFrame, costs: Costs = Costs(), most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(conv_id, part, gaps, blank, duplicate, truncated, illegal, cost, turns): every conversation repaired.

    `turns` holds (edit, role, text) in order, deleted rows included (edit D). Conversations have one
    part; long ones have several, whose turns follow each other by `part`, with the same counts in each.
    """
    ordinary, long_rows = _parts(rows, costs, most_rows, most_bytes)
    if long_rows is None:
        return ordinary
    return ordinary.unionByName(_long_or_empty(long_rows, rows.schema["conv_id"], costs))


def _long_or_empty(rows: DataFrame, conv: T.StructField, costs: Costs) -> DataFrame:
    there = _long(rows.where("present").drop("present"), conv, costs)
    gone = rows.groupBy("conv_id").agg(F.max("present").alias("any")).where(~F.col("any"))
    return there.unionByName(
        gone.select("conv_id", F.lit(0).cast("long").alias("part"), *[F.lit(0).cast("long").alias(c) for c in _COUNTS], F.array().cast(_TURNS).alias("turns"))
    )


def _line(turn: Column) -> Column:
    return F.concat(turn["role"], F.lit(":"), turn["text"])


def _digested(parts: DataFrame, conv: T.StructField) -> DataFrame:
    """Audit and digest of conversations in several parts, streamed part by part."""
    schema = _schema(conv, ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")
    edits = F.array_join(F.transform("turns", lambda t: t["edit"]), "").alias("edits")
    lines = F.transform(F.filter("turns", lambda t: t["edit"] != "D"), _line)
    plain = parts.select("conv_id", "part", *_COUNTS, edits, F.array_join(lines, "\n").alias("body"), (F.size(lines) > 0).alias("has_lines"))
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, counts, audit, digest, begun = pa.null(), None, [], [], hashlib.sha256(), False

        def out() -> pa.RecordBatch:
            row = [now[0], *counts, "".join(audit), digest.hexdigest()]
            kinds = [kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=schema.names)

        for batch in rows_of(batches, names, text="body"):
            kind = batch.column("conv_id").type
            for row in batch.to_pylist():
                if now != (row["conv_id"],):
                    if now is not None:
                        yield out()
                    now, counts, audit, digest, begun = (row["conv_id"],), [row[c] for c in _COUNTS], [], hashlib.sha256(), False
                audit.append(row["edits"])
                if row["has_lines"]:
                    digest.update(b"\n" * begun + row["body"].encode())
                    begun = True
        if now is not None:
            yield out()

    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)


def repair_digests(rows: DataFrame, costs: Costs = Costs(), most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per conversation: its counts, the edits as `audit`, and the SHA-256 of its repaired `role:text` lines.

    A digest has to be fed in order, so the stretches of a long conversation stream through one task at this last step.
    """
    conv = rows.schema["conv_id"]
    ordinary, long_rows = _parts(rows, costs, most_rows, most_bytes)
    kept = F.transform(F.filter("turns", lambda t: t["edit"] != "D"), _line)
    told = ordinary.select(
        "conv_id",
        *_COUNTS,
        F.array_join(F.transform("turns", lambda t: t["edit"]), "").alias("audit"),
        F.sha2(F.array_join(kept, "\n"), 256).alias("repaired_sha256"),
    )
    if long_rows is None:
        return told
    return told.unionByName(_digested(_long_or_empty(long_rows, conv, costs), conv))


def damaged(rows: DataFrame) -> DataFrame:
    """`conversations` with faults put in, by crc32 of `conv_id:turn` modulo 20: 0 row gone, 1 text emptied, 2 stops removed, 3 repeated, 4 role user."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
