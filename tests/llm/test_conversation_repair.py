import hashlib
import random
import re
from zlib import crc32

import pytest

from quarterwise.llm import conversation_repair as repair

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, edits, repaired lines) by plain recurrence: for every prefix of rows, the least for each last initial."""

    def offer(table, cost, edits, initials, lines):
        if re.fullmatch("s?(ua)*u?", initials):  # can still be completed
            new, old = (cost, edits, initials, lines), table.get(initials[-1:])
            if old is None or new[:2] < old[:2]:
                table[initials[-1:]] = new

    def inserted(table):
        for _ in range(4):
            for cost, edits, initials, lines in list(table.values()):
                for role in ("user", "assistant"):
                    offer(table, cost + 3, edits + "I", initials + role[0], (*lines, f"{role}:"))
        return table

    seen, table = set(), {"": (0, "", "", ())}
    for _, role, text in rows:
        ending, new = text.rstrip(" \t\n\v\f\r"), {}
        must_go = not ending or (role, text) in seen
        more = 3 * (not must_go and ending[-1] not in ".!?")
        seen.add((role, text))
        for cost, edits, initials, lines in inserted(table).values():
            offer(new, cost + 4, edits + "D", initials, lines)
            if not must_go:
                if role:
                    offer(new, cost + more, edits + "K", initials + role[0], (*lines, f"{role}:{text}"))
                for to in ("user", "assistant"):
                    offer(new, cost + 3 + more, edits + "R", initials + to[0], (*lines, f"{to}:{text}"))
        table = new
    ended = [x for x in inserted(table).values() if re.fullmatch("(s?(ua)+)?", x[2])]
    cost, edits, _, lines = min(ended, key=lambda x: x[:2])
    return cost, edits, lines


def expected(rows):
    """The contract in plain Python; rows are (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        kept = groups.setdefault(conv, [])
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        kept += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    for conv, kept in groups.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, counts = set(), [0, 0, 0]
        for _, role, text in kept:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            if not visible:
                counts[0] += 1
            elif (role, text) in seen:
                counts[1] += 1
            elif visible[-1] not in ".!?":
                counts[2] += 1
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = cheapest(kept)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(seed, conversations=40, longest=14):
    pick = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for _ in range(pick.randint(1, longest)):
            turn = pick.choice([None, *range(longest)])
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = pick.choice(["a.", "b!", "c", "", " \n", None, "d? ", "é.", f"{pick.random()}."])
            rows.append((pick.choice([conv, conv, None]) if conv < 2 else conv, turn, role, text))
    return rows


def test_search_agrees_with_plain_recurrence():
    pick = random.Random(5)
    for _ in range(400):
        rows = [(i, pick.choice(["user", "assistant", "system", "tool"]), pick.choice(["a.", "b.", "c", "", f"{i}."])) for i in range(pick.randint(0, 9))]
        found = repair.repair_one(rows)
        cost, audit, lines = cheapest(rows)
        assert (found["cost"], "".join(t["edit"] for t in found["turns"])) == (cost, audit)
        assert [f"{t['role']}:{t['text']}" for t in found["turns"] if t["edit"] != "D"] == list(lines)


@pytest.mark.parametrize("most_rows", [512, 3, 0])
def test_contract(spark, rows_of, most_rows, monkeypatch):
    monkeypatch.setattr(repair, "STRETCH_BITS", 2)
    rows = random_rows(most_rows)
    got = repair.repair_digests(repair.damaged(spark.createDataFrame(rows, SCHEMA)), most_rows=most_rows)
    assert rows_of(got, *COLUMNS) == expected(rows)


def test_one_conversation_holds_all_rows(spark, rows_of):
    pick = random.Random(9)
    rows = [(7, i // 3 if i % 50 else None, pick.choice(["user", "assistant"]), pick.choice(["same.", f"{i}.", f"{i}"])) for i in range(1500)]
    got = repair.repair_digests(repair.damaged(spark.createDataFrame(rows, SCHEMA)))
    assert rows_of(got, *COLUMNS) == expected(rows)


def test_turns_of_a_long_conversation_follow_by_part(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(1200)] + [(2, 0, "assistant", "x")]
    parts = repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "part").collect()
    texts = [t.text for p in parts if p.conv_id == 1 for t in p.turns]
    assert texts == [f"{i}." for i in range(1200)] and len(parts) > 4
    assert [(t.edit, t.role, t.text) for t in parts[-1].turns] == [("D", "assistant", "x")] and parts[-1].cost == 4


def test_edge_rows(spark, rows_of):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_digests(repair.damaged(empty)).count() == 0
    long_text = "word " * 400_000 + "end."
    rows = [(1, 0, "user", long_text), (1, 1, "assistant", long_text), (1, 1, "assistant", long_text), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", part long, turns string, digest string")
    assert rows_of(repair.repair_digests(repair.damaged(frame)), *COLUMNS) == expected(rows)
    # rows that are not present leave only their conversation
    gone = spark.createDataFrame([(3, 0, "user", "a.", False)], SCHEMA + ", present boolean")
    for most in (0, 512):
        row = repair.repair_digests(gone, most_rows=most).first()
        assert (row.conv_id, row.cost, row.audit, row.repaired_sha256) == (3, 0, "", hashlib.sha256(b"").hexdigest())
