"""Objects of files cut into many small ranges equal those of Python's own reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarterwise.sources.filings import read_company_facts
from quarterwise.sources.large_json import read_json_array, read_json_objects, read_large_facts

NASTY = ['a}b', '{', '"quoted"', "back\\slash", "\\", 'end\\"}', "ü€😀}", "[{]}", "line\nbreak", "", "x" * 300]


def _record(rnd):
    value = lambda: rnd.choice([*NASTY, 1.5, None, True, [1, "}"], {"in}ner": {"deep": rnd.choice(NASTY)}}])
    return {"id": rnd.randint(0, 9), **{f"k{i}": value() for i in range(rnd.randint(0, 5))}}


@pytest.mark.parametrize("ascii_only", [True, False])
@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_in_many_ranges(spark, tmp_path, ascii_only, indent):
    rnd = random.Random(5)
    rows = [_record(rnd) for _ in range(400)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows, ensure_ascii=ascii_only, indent=indent), "utf-8")
    got = read_json_objects(spark, str(path), split_bytes=700).orderBy("ord").collect()
    assert [json.loads(r.value) for r in got] == rows
    assert [r.ord for r in got] == list(range(400))


def test_ranges_are_many_and_one_object_may_span_them(spark, tmp_path):
    path = tmp_path / "a.json"
    rows = [{"n": i, "list": [{"v": j} for j in range(300 if i == 2 else 1)]} for i in range(5)]
    path.write_text(json.dumps(rows))
    cut = spark.read.option("lineSep", "}").text(str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert cut.select("_metadata.file_block_start").distinct().count() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = read_json_array(spark, str(path), "n int, list array<struct<v: int>>", split_bytes=300)
    assert sorted((r.n, len(r.list), sum(x.v for x in r.list)) for r in got.collect()) == [
        (i, len(x["list"]), sum(y["v"] for y in x["list"])) for i, x in enumerate(rows)
    ]


def test_several_files_scalars_and_empty_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text('[1, "x{y", null, {"a": 1}, [2], {"a": 2}]\n')
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text('{"a": 3}\n{"a": 4}')
    got = read_json_array(spark, str(tmp_path), "a int").collect()
    assert sorted(r.a for r in got) == [1, 2, 3, 4]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"b": 2', '[{"a": {"b": 1}]', '[{"a": "x}]', '{"a": 1}}'])
def test_broken_files_are_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not whole JSON"):
        read_json_objects(spark, str(tmp_path)).collect()


def _facts(company, rnd, n):
    units = lambda: {u: [{"form": "10-Q", "end": "2020-03-31", "val": rnd.random(), "accn": f"a{rnd.randint(0, 99)}"} for _ in range(rnd.randint(1, n))] for u in ("USD", "shares")}
    tags = {t: {"label": rnd.choice(NASTY), "units": units()} for t in ("Revenues", "Assets", 'Odd"Tag')}
    other = {"Revenues": {"units": {"USD": [{"form": "8-K", "end": "2020-03-31", "val": 1.0, "accn": "no"}]}}}
    facts = {"dei": other, "us-gaap": tags}
    return {"Company": company, "facts": facts} if rnd.random() < 0.5 else {"meta": {"Company": "not this"}, "facts": facts, "Company": company}


def test_facts_equal_the_plain_reader(spark, tmp_path):
    rnd = random.Random(3)
    (tmp_path / "large.json").write_text(json.dumps(_facts("Large", rnd, 400)))
    lines = [json.dumps(_facts(f"c{i} \\ \"{i}\"", rnd, 3)) for i in range(6)]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    plain = read_company_facts(spark, str(tmp_path), None)
    large = read_large_facts(spark, str(tmp_path), None, split_bytes=900)
    columns = ["Company", "tag", "form", "end", "value", "uom", "accn"]
    assert large.count() == plain.count() > 500
    assert large.select(columns).exceptAll(plain.select(columns)).count() == 0
    order = lambda df: df.groupBy("Company", "tag").agg(F.sort_array(F.collect_list(F.struct("ord", "value"))).alias("l")).select("Company", "tag", "l.value")
    assert order(large).exceptAll(order(plain)).count() == 0
    assert read_large_facts(spark, str(tmp_path), ["Assets"], 900).select("tag").distinct().count() == 1


def test_brace_in_a_key_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"facts": {"a}b": {"c": 1}}}')
    assert read_json_objects(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="a key holds a brace"):
        read_json_objects(spark, str(tmp_path), depth=2).collect()


def test_pieces_are_placed_once_whatever_reads_them(spark, tmp_path):
    lines = [{"Company": f"c{i}", "facts": {"us-gaap": {"T": {"units": {"U": [{"val": i}, {"val": -i}]}}}}} for i in range(60)]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)))
    got = read_large_facts(spark, str(tmp_path), None, 500)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "split(" not in plan  # the text is not looked at for quotes and keys again
    rows = sorted((r.ord, r.Company, r.tag, r.uom, r.value) for r in got.collect())
    assert rows == [(2 * i + k, f"c{i}", "T", "U", (1 - 2 * k) * float(i)) for i in range(60) for k in (0, 1)]


def test_keys_with_escapes_quotes_and_wide_characters(spark, tmp_path):
    keys = [k for k in NASTY if "{" not in k and "}" not in k] + ["ü€😀", 'a":"b', "", " : [", "x\\", "é" * 40]
    docs = [{"s": "😀é", a: {b: [{"n": i, "in": {a: {"z": b}}}], "t": [{"n": -i}]}} for i, (a, b) in enumerate(zip(keys, keys[::-1]), 1)]
    for name, ascii_only, indent in (("a", True, None), ("b", False, None), ("c", False, 1)):
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps(d, ensure_ascii=ascii_only, indent=indent) for d in docs), "utf-8")
        got = read_json_objects(spark, str(tmp_path / f"{name}.json"), depth=2, split_bytes=100).orderBy("ord").collect()
        wanted = [(i, [None, a, k], x) for i, d in enumerate(docs) for a in list(d)[1:] for k, v in d[a].items() for x in v]
        assert [(r.doc, r["keys"], json.loads(r.value)) for r in got] == wanted
