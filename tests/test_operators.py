import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorefold.functions import csv_list, fingerprint, malformed_markers, ordered_markers, url_slug, yes_no
from lorefold.operators import answers, documents, registry, retrieval
from lorefold.sources import catalog_rows, landed, salvage
from lorefold.streaming import audit_counts, once_each


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a, b ,,c", " Yes ", "https://x.org/d/slug-1/?q=1")], "t string, y string, u string")
    r = df.select(csv_list(F.col("t")), yes_no(F.col("y")), url_slug(F.col("u"))).first()
    assert list(r) == [["a", "b", "c"], True, "slug-1"]


def test_salvage():
    assert list(salvage('{"title": "A"},{"title": "B"}]')) == ['{"title": "A"}', '{"title": "B"}']
    assert list(salvage('{"data": [{"a": 1}, 3]}')) == ['{"a": 1}']
    with pytest.raises(ValueError):
        list(salvage('{"a": 1} nonsense'))


def test_catalog_rows(spark):
    got = catalog_rows(spark.createDataFrame([('[{"title": "A"}]',), (None,)], "value string"), "title string")
    assert rows(got.select("title")) == [("A",)]


def test_markers(spark):
    df = spark.createDataFrame([("Keep logs [2] for a year [1], as said in [2]; see [2,3].",)], "t string")
    r = df.select(ordered_markers(F.col("t")), malformed_markers(F.col("t"))).first()
    assert list(r) == [["[2]", "[1]"], ["[2,3]"]]


def test_fingerprint_keeps_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    got = df.select(fingerprint(F.col("x"), F.col("y"), F.col("z")).alias("f")).distinct().count()
    assert got == 2


def test_page_lookup_is_inclusive_and_first(spark):
    pages = spark.createDataFrame([(1, 1, "ab"), (1, 2, "cd")], "doc_id long, page_number int, text string")
    offsets = documents.page_offsets(pages)
    assert rows(offsets) == [(1, 1, 0, 2), (1, 2, 3, 5)]
    at = spark.createDataFrame([(1, 2), (1, 3), (1, 9)], "doc_id long, at int")
    assert rows(documents.page_of_offset(at, offsets)) == [(1, 2, 1), (1, 3, 2)]


@pytest.mark.parametrize(
    "line, ok",
    [("1. Scope of the text", True), ("3. Every batch is kept cold.", False), ("CAUTION", False), ("BACKGROUND", True), ("SCOPE AND AIM", True), ("plain line", False), ("", False)],
)
def test_headings(spark, line, ok):
    assert spark.createDataFrame([(line,)], "l string").select(documents.is_heading(F.col("l"))).first()[0] is ok


def test_sections_slice_the_text(spark):
    text = "lead\nSCOPE AND AIM\nbody\n2. Next part\nrest"
    got = rows(documents.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")), "section_no")
    assert [(r[2], text[r[4] : r[5]].split("\n")[0]) for r in got] == [("Preamble", "lead"), ("SCOPE AND AIM", "SCOPE AND AIM"), ("2. Next part", "2. Next part")]
    assert got[-1][5] == len(text)


def test_windows_begin_at_words_and_fit():
    text = "alpha beta gamma delta epsilon zeta eta theta"
    spans = list(documents.window_spans(text, 20, 6))
    assert all(b - a <= 20 for a, b in spans) and all(a == 0 or text[a - 1] == " " for a, _ in spans)
    assert "".join(text[a:b] for a, b in spans).replace(" ", "").startswith("alphabeta")
    assert list(documents.window_spans("", 20, 6)) == []


def test_chunk_sizes_are_checked(spark):
    with pytest.raises(ValueError):
        documents.child_chunks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 10, 10)


def test_rrf_score(spark):
    schema = "query_id long, doc_id long, score double, rank int"
    a = spark.createDataFrame([(1, 10, 0.9, 1)], schema)
    b = spark.createDataFrame([(1, 11, 3.0, 1), (1, 10, 2.0, 2)], schema)
    got = rows(retrieval.fuse(a, b, 5).select("rank", "doc_id", "rrf_score"))
    assert got[0] == (1, 10, round(1 / 61 + 1 / 62, 9)) and got[1][1] == 11
    with pytest.raises(ValueError):
        retrieval.fuse(a, b, 0)


def test_dense_search_takes_queries_in_blocks(spark):
    v = spark.createDataFrame([(k, [float(k % 5 + 1), float(k % 3), float(k % 7)]) for k in range(40)], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    got = rows(retrieval.dense_search(q, v, 3, max_queries=16))
    assert len(got) == 120 and got == rows(retrieval.dense_search(q, v, 3))
    assert retrieval.dense_search(q.limit(0), v, 3).count() == 0


def test_registry_sync(spark):
    ts = dt.datetime(2024, 1, 1)
    schema = "slug string, status string, lifecycle_state string, changed_at timestamp, first_seen_at timestamp, last_seen_at timestamp"
    old = spark.createDataFrame([("same", "Final", "active", ts, ts, ts), ("flip", "Draft", "active", ts, ts, ts), ("gone", "Final", "active", ts, ts, ts), ("out", "Final", "withdrawn", ts, ts, ts)], schema)
    new = spark.createDataFrame([("same", "Final", ts), ("flip", "Final", ts), ("new", "Draft", None)], "slug string, status string, changed_at timestamp")
    got = {r["slug"]: r for r in registry.sync(old, new, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert {k: v["change_type"] for k, v in got.items()} == {"same": None, "flip": "updated", "gone": "withdrawn", "out": None, "new": "new"}
    assert got["flip"]["first_seen_at"] == ts and got["gone"]["lifecycle_state"] == "withdrawn" and got["out"]["last_seen_at"] == ts


def test_alert_states_never_go_back(spark):
    r = spark.createDataFrame([(1, 1, 1, "acknowledged"), (1, 2, 2, "open"), (1, 3, 3, "resolved"), (2, 1, 4, "open")], "alert_id long, at long, request_id long, to string")
    assert rows(registry.transitions(r)) == [(1, "resolved", 1), (2, "open", 0)]


def test_budget(spark):
    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([(1, 1, t), (1, 2, t), (1, 3, t + dt.timedelta(seconds=61))], "user_id long, event_id long, ts timestamp")
    got = rows(answers.budget(r, 1, 60).select("event_id", "accepted", "retry_after"))
    assert got == [(1, True, 0), (2, False, 60), (3, True, 0)]


def test_landing_reuses_known_content(spark):
    old = spark.createDataFrame([("a", "h1")], "slug string, sha256 string")
    new = spark.createDataFrame([("a", "h1"), ("a", "h2"), ("a", "h2")], "slug string, sha256 string")
    assert rows(landed(old, new)) == [("a", "h1", True), ("a", "h2", False)]


def test_streams_agree_with_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(t, "view"), (t, "click"), (t + dt.timedelta(hours=5), "view")], "ts timestamp, event_type string")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = audit_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").count() == 3
    for _ in range(2):
        once_each(stream, "event_type", str(tmp_path / "out"), str(tmp_path / f"cp{_}")).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
