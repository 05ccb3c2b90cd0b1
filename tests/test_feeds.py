"""Feeds cut into byte ranges, pages found in one pass, sketches that are merged."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lorefold.operators import documents, registry
from lorefold.sources import salvage
from lorefold.sources.feeds import catalog_files, feed_objects

ODD = [
    {"title": 'a "quoted" } brace', "n": {"deep": [1, {"x": "]}"}]}},
    {"title": "back\\slash\\", "t": "\\\" } {"},
    {},
    {"title": "é😀\n", "list": [{}, {"a": {}}]},
    {"title": "<a href=\"/x\">} , {</a>"},
    {"title": "[", "b": "]", "c": "\\"},
]


@pytest.mark.parametrize("size", [23, 10_000])
def test_feeds_equal_the_sequential_reader_on_any_cut(spark, tmp_path, size):
    rnd = random.Random(size)
    rows = rnd.sample(ODD, 6)
    mixed = [1, "no object {", None, *rows[:2], "x", *rows[2:], 2.5]
    texts = {
        "list": json.dumps(mixed), "pretty": json.dumps(rows, indent=2, ensure_ascii=False), "data": json.dumps({"data": rows}), "after": " ,\n".join(json.dumps(r) for r in rows), "open": "[" + ",".join(json.dumps(r) for r in rows) + "]",
        "empty": "[]", "blank": "", "one": json.dumps(ODD[0]),
    }
    for name, text in texts.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text(text, encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {}
        for r in feed_objects(spark, f"{tmp_path}/in").orderBy("path", "place").collect():
            got.setdefault(r.path.rsplit("/", 1)[-1][:-5], []).append(json.loads(r.value))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, text in texts.items():
        assert got.get(name, []) == [json.loads(x) for x in salvage(text)] if text else name not in got, name


def test_a_feed_that_is_cut_off_gives_what_is_whole(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"title": "a"}, {"title": "b"}, {"title": "c')
    (tmp_path / "g.json").write_text('{"title": "A"},{"title": "B"}]')
    rows = catalog_files(spark, f"{tmp_path}/*.json", "title string").orderBy("path", "place").collect()
    assert [r.title for r in rows] == ["a", "b", "A", "B"]


def test_pages_of_a_long_document(spark):
    n = 3_000
    pages = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page_number"), F.when(F.col("id") % 7 == 0, "").otherwise("some words").alias("text"))
    pages = pages.union(spark.createDataFrame([(2, 0, "abc"), (2, 1, None), (2, 2, "de")], "doc_id long, page_number int, text string"))
    offsets = documents.page_offsets(pages.fillna({"text": ""}))
    points = spark.range(n * 2).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 5).alias("at")).union(spark.createDataFrame([(2, k) for k in range(-1, 9)] + [(3, 0)], "doc_id long, at long"))
    got = {(r.doc_id, r.at): r.page_number for r in documents.page_of_offset(points, offsets).collect()}
    starts, at = [], 0
    for k in range(n):
        size = 0 if k % 7 == 0 else 10
        starts.append((at, at + size))
        at += size + 1
    k = 0
    for p in range(0, n * 10, 5):
        while k < n and starts[k][1] < p:
            k += 1
        assert got.get((1, p)) == (k if k < n else None)
    assert [got.get((2, k)) for k in range(-1, 9)] == [None, 0, 0, 0, 0, 1, 2, 2, 2, None] and (3, 0) not in got
    spans = spark.createDataFrame([(1, 0, 0, at), (1, 1, 3, 30), (2, 0, 0, 4), (2, 1, 4, 7), (2, 2, 90, 99), (4, 0, 0, 1)], "doc_id long, section_no int, char_start long, char_end long")
    got = sorted(map(tuple, documents.section_pages(spans, offsets).collect()))
    assert got == [(1, 0, 0, n - 1, n), (1, 1, 1, 3, 3), (2, 0, 0, 1, 2), (2, 1, 1, 2, 2)]


def test_sketches_are_merged(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_000).cast("string").alias("slug"), (F.col("id") % 9).alias("b"))
    sketches = registry.stored_sketches(rows, F.col("b"))
    one = registry.merged_estimate(sketches).first()
    assert (one.n_batches, one.n_rows) == (9, 60_000) and abs(one.n_distinct - 20_000) < 600
    active = spark.range(20_000).select(F.lit("active").alias("lifecycle_state"))
    assert registry.reconciled_by_sketch(active, sketches).first().agrees
    assert not registry.reconciled_by_sketch(active.limit(15_000), sketches, sketches).first().agrees
    assert tuple(registry.merged_estimate(sketches.where("false")).first()) == (0, 0, 0)
