import math

import pytest
from pyspark.sql import functions as F

from quarterwise.llm import mixing


def filled(sizes, weights, share=1.5, most=2):
    """Targets by resharing the excess until none is above its limit."""
    target, open_ = {}, set(sizes)
    total = share * sum(sizes.values())
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > most * sizes[s]}
        if not above:
            return target | {s: level * weights[s] for s in open_}
        target |= {s: float(most * sizes[s]) for s in above}
        open_ -= above
    return target


def corpus(documents):
    rows, n = [], 0
    for source, count in (("b", 300), ("a", 40), (None, 60), ("c", 150), ("Z", 5)):
        for i in range(count):
            rows.append((n, " ".join(["w"] * (1 + (i * 7) % 23)), "en", source))
            n += 1
    return documents(*rows, (9000, None, "en", "a"), (9001, " \t\n", "en", None), (None, "x y", "en", "b"))


def test_targets_and_taken_words(documents):
    rows = mixing.plan_mix(corpus(documents), blocks=8).collect()
    sizes, weights = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = filled(sizes, weights)
    for s in order:
        own = [r for r in rows if r.source == s]
        taken = sum(r["size"] * r.passes for r in own)
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        assert abs(taken - want[s]) <= max(r["size"] for r in own)
        assert all(0 <= r.passes <= 2 for r in own)
    assert all(r.passes == 0 for r in rows if r["size"] == 0) and len(rows) == 558


def test_reruns_agree_whatever_the_partitions(documents, rows_of):
    docs = corpus(documents)
    columns = ("doc_id", "size", "passes")
    first = rows_of(mixing.plan_mix(docs, blocks=8), *columns)
    assert first == rows_of(mixing.plan_mix(docs.repartition(7), blocks=8), *columns)
    assert first != rows_of(mixing.plan_mix(docs, blocks=8, seed=3), *columns)


def test_shards_hold_exact_shares_of_blocks(spark):
    units = spark.range(700).select((F.col("id") % 3).cast("int").alias("sid"), F.col("id").cast("int").alias("block"), F.lit(1).alias("pass"))
    for shards in (1, 2, 5, 8):
        counts = [r["n"] for r in mixing.split_units(units, shards).groupBy("shard").agg(F.count("*").alias("n")).collect()]
        assert len(counts) == shards and sum(counts) == 700
        assert max(counts) - min(counts) <= math.ceil(math.log2(max(2, shards)))


def test_split_is_a_hypergeometric_draw(spark):
    """The share of a source on the left half varies as without replacement."""
    units = spark.range(100).select((F.col("id") < 30).cast("int").alias("sid"), F.col("id").cast("int").alias("block"), F.lit(1).alias("pass"))
    left = [mixing.split_units(units, 2, seed=s).where("shard = 0 AND sid = 1").count() for s in range(30)]
    mean, variance = sum(left) / 30, 50 * 0.3 * 0.7 * 50 / 99
    assert abs(mean - 15) < 4 * math.sqrt(variance / 30)
    assert 0.3 * variance < sum((x - mean) ** 2 for x in left) / 29 < 2.5 * variance


def test_mix_holds_each_document_as_often_as_taken(documents):
    docs = corpus(documents).withColumns({"shard": F.lit("s"), "mix_size": F.lit(1)})
    out = mixing.mix(docs, blocks=8, shards=4)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[-2:] == ["shard_", "copy"]
    plan = {r.doc_id: r.passes for r in mixing.plan_mix(docs, blocks=8).collect()}
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}


def test_taken_words_and_shards_are_those_of_the_mix(documents):
    docs = corpus(documents)
    rows = {r.doc_id: r for r in mixing.dealt_mix(docs, blocks=8, shards=4).collect()}
    want = {}
    for r in mixing.mix(docs, blocks=8, shards=4).collect():
        want.setdefault(r.doc_id, {})[r.copy] = r.shard
    plan = {r.doc_id: r for r in mixing.plan_mix(docs, blocks=8).collect()}
    assert rows.keys() == plan.keys()
    for i, r in rows.items():
        assert r.shards == [shard for _, shard in sorted(want.get(i, {}).items())]
        assert r.taken == r["size"] * len(r.shards) and r.passes == len(r.shards) == plan[i].passes
        assert (r["size"], r.source_size, r.target) == (plan[i]["size"], plan[i].source_size, plan[i].target)
    assert {s for r in rows.values() for s in r.shards} == set(range(4))


def test_degenerate_tables(documents):
    assert mixing.plan_mix(documents().limit(0)).count() == 0
    assert mixing.mix(documents().limit(0)).count() == 0
    rows = mixing.plan_mix(documents((1, None), (2, ""), (3, "  "))).collect()
    assert {(r.target, r.passes) for r in rows} == {(0.0, 0)}
    twins = mixing.plan_mix(documents((1, "a b", "en", "s"), (1, "a b", "en", "s"), (1, "c", "en", "s"))).collect()
    # nothing tells the equal rows apart in a mix, so both are taken as often: within half of their words of the target 7.5
    assert abs(sum(r["size"] * r.passes for r in twins) - 7.5) <= 2 and len({r.passes for r in twins if r["size"] == 2}) == 1


def test_rows_that_share_an_id(documents):
    """Equal and unequal texts under one id, and one under two sources: each row with its own words."""
    long_text = "w " * 1000
    rows = [(1, "a b c d e f g h i j", "en", "s"), (1, long_text, "en", "s"), (1, "x y", "en", "t"), (1, None, "en", "s")]
    rows += [(2, "q r", "en", "s")] * 30 + [(i, "m n o", "en", "s") for i in range(3, 200)]
    docs = documents(*rows)
    got = mixing.dealt_mix(docs, blocks=8, shards=4).collect()
    assert len(got) == len(rows)
    assert all(r.taken == r["size"] * r.passes == r["size"] * len(r.shards) <= 2 * r["size"] for r in got)
    assert len({(r.passes, tuple(r.shards)) for r in got if r.doc_id == 2}) == 1
    mixed = sum(len((r.text or "").split()) for r in mixing.mix(docs, blocks=8, shards=4).collect())
    assert sum(r.taken for r in got) == mixed
    for source in {r.target: r.source_size for r in got}:
        words = sum(r.taken for r in got if r.target == source)
        assert abs(words - source) <= 1000


def test_native(documents):
    plan = mixing.plan_mix(corpus(documents))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
