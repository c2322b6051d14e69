import re

from quarterwise.sinks import answers


def scanned(df):
    """Rows read and files opened by the scans of a frame's plan, after it ran."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if "FileScan" in node.nodeName() or node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numFiles").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return found


def test_a_lookup_reads_one_file(spark, frame, tmp_path):
    path = str(tmp_path / "store")
    rows = [(f"Company {i}", f'{{"x": {i}}}', 1) for i in range(2000)]
    answers.write_answer_store(frame("k string, a string, seq int", *rows), path, "k", "a", buckets=16)
    assert len([p for p in (tmp_path / "store").rglob("*.parquet")]) == 16
    for i in (0, 7, 1999):
        found = answers.answer_of(spark, path, f"Company {i}")
        assert scanned(found) == [1]
        assert [(r.key, r.answer) for r in found.collect()] == [(f"Company {i}", f'{{"x": {i}}}')]
    assert answers.answer_of(spark, path, "nobody").collect() == []
    plan = answers.answer_of(spark, path, "Company 7")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*EqualTo\(key,Company 7\)", plan)


def test_one_answer_per_key(spark, frame, tmp_path):
    path = str(tmp_path / "store")
    rows = [("a", "old", 1), ("a", "new", 2), ("a", "new", 2), ("b", None, 1), (None, "lost", 1), ("c", "x", 1), ("c", "y", 1)]
    answers.write_answer_store(frame("k string, a string, seq int", *rows), path, "k", "a", order="seq")
    asked = frame("k string, n int", ("a", 1), ("a", 2), ("b", 3), ("c", 4), ("z", 5), (None, 6))
    got = sorted((r.n, r.k, r.answer) for r in answers.answers_of(asked, path, "k").collect())
    assert got == [(1, "a", "new"), (2, "a", "new"), (3, "b", None), (4, "c", "y"), (5, "z", None), (6, None, None)]


def test_an_empty_store(spark, frame, tmp_path):
    path = answers.write_answer_store(frame("k string, a string"), str(tmp_path / "store"), "k", "a")
    assert answers.answer_of(spark, path, "a").collect() == []
    assert answers.answers_of(frame("k string", ("a",)), path, "k").collect() == [("a", None)]
