import random

import pytest

from quarterwise.operators.asof import asof_join

LEFT, RIGHT = "who string, at int, n int", "who string, t int, x int"


def expected(left, right, strict=True):
    out = []
    for who, at, n in left:
        found = None
        if who is not None and at is not None:
            fits = [(t, x) for w, t, x in right if w == who and t is not None and (t < at if strict else t <= at)]
            found = max(fits, default=None)
        out.append((who, at, n, *(found or (None, None))))
    return sorted(out, key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("strict", [True, False])
def test_against_a_search(frame, strict):
    pick = random.Random(3)
    who = lambda: pick.choice(["a", "b", "c", None])
    left = [(who(), pick.choice([None, *range(30)]), i) for i in range(300)]
    right = [(who(), pick.choice([None, *range(0, 30, 3)]), i) for i in range(80)]
    got = asof_join(frame(LEFT, *left), frame(RIGHT, *right), ["who"], "at", "t", {"t": "t", "x": "x"}, strict, order=["x"])
    assert _rows(got) == expected(left, right, strict)
    inner = asof_join(frame(LEFT, *left), frame(RIGHT, *right), ["who"], "at", "t", {"t": "t", "x": "x"}, strict, keep_unmatched=False, order=["x"])
    assert _rows(inner) == [r for r in expected(left, right, strict) if r[3] is not None]


def test_one_key_with_nearly_all_rows_is_spread(spark, frame):
    left = [("hot", i, i) for i in range(0, 9000, 2)] + [("cold", 5, -1), ("none", 5, -2)]
    right = [("hot", i, i) for i in range(0, 9000, 450)] + [("cold", 4, 7)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof_join(frame(LEFT, *left).repartition(4), frame(RIGHT, *right), ["who"], "at", "t", {"t": "t", "x": "x"}, order=["x"])
        assert _rows(got) == expected(left, right)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # no task gathers the hot key: rows are dealt by range and key
    assert "hashpartitioning(__range" in plan and "CartesianProduct" not in plan


def test_names_and_empty_tables(frame):
    left, right = frame(LEFT, ("a", 1, 1)), frame(RIGHT)
    assert _rows(asof_join(left, right, ["who"], "at", "t", {"seen": "t"})) == [("a", 1, 1, None)]
    assert _rows(asof_join(frame(LEFT), frame(RIGHT, ("a", 1, 1)), ["who"], "at", "t", {"seen": "t"})) == []
    with pytest.raises(ValueError, match="at"):
        asof_join(left, right, ["who"], "at", "t", {"at": "t"})
