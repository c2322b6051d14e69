from pyspark.sql import functions as F

from quarterwise.llm.exact_dedup import drop_exact_copies, exact_groups


def test_largest_id_stays_and_null_counts_as_empty(documents, rows_of):
    docs = documents((1, "a"), (5, "a"), (3, "a"), (4, None), (2, ""), (7, "A"))
    got = rows_of(exact_groups(docs), "doc_id", "keep_id", "group_size", "kept")
    assert got == [(1, 5, 3, False), (2, 4, 2, False), (3, 5, 3, False), (4, 4, 2, True), (5, 5, 3, True), (7, 7, 1, True)]


def test_frequent_texts_give_the_same_as_rare_ones(documents, rows_of):
    docs = documents(*[(i, f"text {min(i % 7, 3)}") for i in range(200)], *[(300 + i, f"once {i}") for i in range(50)])
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    few = rows_of(exact_groups(docs, frequent=1, tracked=8), *columns)
    assert few == rows_of(exact_groups(docs), *columns) and len(few) == 250
    for settings in ({}, {"frequent": 1, "tracked": 8}):
        kept = rows_of(drop_exact_copies(docs, **settings), "doc_id")
        assert kept == sorted(((r[0],) for r in few if r[3]), key=repr)


def test_one_of_repeated_rows_stays(documents, rows_of):
    docs = documents((1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "x" * 300_000), (2, "x" * 300_000))
    groups = exact_groups(docs)
    assert groups.where("kept").count() == 3 == drop_exact_copies(docs).count()
    assert rows_of(groups.where("kept"), "doc_id") == [(1,), (2,), (None,)]


def test_normalised_texts(documents, rows_of):
    docs = documents((1, "A b"), (2, "a B"))
    assert rows_of(exact_groups(docs, normalise=F.lower), "doc_id", "keep_id") == [(1, 2), (2, 2)]


def test_empty_table_and_clashing_columns(documents, rows_of):
    assert exact_groups(documents().limit(0)).count() == 0
    docs = documents((1, "a"), (2, "a"), (3, None)).withColumns({c: F.lit(9) for c in ("text_digest", "copy_rank", "won", "row", "digest")})
    assert drop_exact_copies(docs).columns == docs.columns
    assert rows_of(drop_exact_copies(docs), "doc_id", "digest", "won") == [(2, 9, 9), (3, 9, 9)]
    assert drop_exact_copies(docs.limit(0)).count() == 0


def test_native(documents):
    plan = exact_groups(documents((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
