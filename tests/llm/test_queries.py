"""Registered corpus queries on the smallest supplied tables."""

import pytest

import corpus_pipeline
from check_results import connect, differences
from quarterwise.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_result_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_a_row_for_each_input_row(spark, name):
    tables = {"op6": ("pages", "page_id"), "op12": ("conversations", "conv_id"), "op13": ("embeddings", "vec_id")}
    table, key = tables.get(name.split("_")[0], ("documents", "doc_id"))
    got = sorted(r[0] for r in QUERIES[name](spark, SF).select(key).collect())
    want = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
    if table == "conversations":
        want = list(set(want))
    assert got == sorted(want * 4 if table == "embeddings" else want)


def test_mixing_returns_the_shards_of_each_copy(spark):
    rows = QUERIES["op4_mixing"](spark, SF).collect()
    assert all(len(r.shards) == r.passes and r.taken == r["size"] * r.passes for r in rows)
    assert len({s for r in rows for s in r.shards}) > 1


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count() > 0


def test_pipeline_equals_its_operators_one_by_one(spark, tmp_path):
    """Each stage against a plain computation on its own input."""
    from test_decontaminate import brute as hits
    from test_near_dedup import classes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r for r in docs.collect()]
        kept = sorted(r.doc_id for r in after)
        if name == "language_id":
            want = sorted(i for i, r in rows.items() if any(c.isalpha() for c in r.text or ""))
        elif name == "exact_dedup":
            largest = {}
            for i, r in rows.items():
                largest[r.text] = max(i, largest.get(r.text, i))
            want = sorted(largest.values())
        elif name == "near_dedup":
            ids = sorted(rows)
            want = sorted({ids[c] for c in classes([rows[i].text for i in ids])})
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            found = hits([(i, r.text) for i, r in rows.items()], bench)
            want = sorted(i for i in rows if not found[i][4])
        else:
            size = {i: len((r.text or "").encode().split()) for i, r in rows.items()}
            taken = sum(size[r.doc_id] for r in after)
            assert abs(taken / sum(size.values()) - 1.5) < 0.05 and set(kept) <= set(rows)
            assert docs.columns[: len(columns)] == columns
            continue
        assert kept == want, name
        assert docs.columns == columns
        rows = {r.doc_id: r for r in after}
