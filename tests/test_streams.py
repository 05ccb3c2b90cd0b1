"""Streams with timed state and stored tables against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lorefold import streaming
from lorefold.operators import answers, index
from lorefold.operators import jobs as J
from lorefold.operators.documents import document_chunks
from lorefold.sources.tables import TableSet

T = dt.datetime(2024, 1, 1)
EVENT = "user_id long, event_id long, ts timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def requests(seed, n):
    """A hot user with a third of all requests, in bursts; times with fractions, some equal."""
    rnd = random.Random(seed)
    rows, at = [], 0.0
    for k in range(n):
        at += rnd.choice([0.0, 0.5, 3, 7, 100])
        rows.append((1 if k % 3 == 0 else rnd.randrange(2, 7), k, T + dt.timedelta(seconds=at)))
    return rows


def test_split_budget_equals_the_fold(spark):
    df = spark.createDataFrame(requests(1, 600), EVENT)
    for most, window in ((1, 20), (3, 90)):
        want = sorted(map(tuple, answers.budget(df, most, window).collect()))
        assert sorted(map(tuple, answers.budget(df, most, window, split=True).collect())) == want


def test_timed_budget_on_shuffled_batches(spark, tmp_path):
    rows = requests(2, 150)
    end = rows[-1][2]
    random.Random(3).shuffle(rows)
    far = [(99, 1000, end + dt.timedelta(hours=2)), (99, 1001, end + dt.timedelta(hours=4))]  # moves the watermark past all
    folder = str(tmp_path / "in")
    for part in (rows[:50], rows[50:100], rows[100:], far[:1], far[1:]):
        spark.createDataFrame(part, EVENT).repartition(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
        q = streaming.timed_budget(stream, 2, 60, "3 hours").writeStream.format("memory").queryName("timed").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.table("timed").where("user_id < 99").collect()))
    assert got == sorted(map(tuple, answers.budget(spark.createDataFrame(rows, EVENT), 2, 60).collect()))
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= 6  # the last far request, with its timers; nothing of the others


def test_fingerprints_are_added_once(spark, tmp_path):
    t = TableSet(spark, str(tmp_path / "t"), {"alerts": "event_fingerprint string, n long"}, {"alerts": "event_fingerprint"}, buckets=8)
    folder = str(tmp_path / "in")
    for part in ([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5)], [("a", 6)]):
        spark.createDataFrame(part, "event_fingerprint string, n long").repartition(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("event_fingerprint string, n long").parquet(folder)
        streaming.once_each_indexed(stream, t, "alerts", str(tmp_path / "c")).start().awaitTermination()
    assert sorted(r[0] for r in t.read("alerts").collect()) == ["a", "b", "c"]
    before = t.manifest()["version"]
    streaming.once_each_indexed(spark.readStream.schema("event_fingerprint string, n long").parquet(folder), t, "alerts", str(tmp_path / "other")).start().awaitTermination()
    assert t.manifest()["version"] == before and t.read("alerts").count() == 3  # the batches' numbers are known
    assert len(t.manifest()["tables"]["alerts"]) <= 3


META = ("slug", "title", "status", "lifecycle_state", "center", "issuing_office", "communication_type", "docket_number", "source_url")


def test_contents_are_indexed_as_they_arrive(spark, tmp_path):
    meta = spark.createDataFrame([("s:1", "One"), ("s2", "Two")], "slug string, title string")
    meta = meta.withColumns({**{c: F.lit("x") for c in META[2:]}, "version_hash": F.lit(None).cast("string"), "topics": F.array(F.lit("a")), "issue_date": F.lit("2024-01-02").cast("date")})
    rows = index.with_metadata(document_chunks(spark.createDataFrame([], "doc_id string, text string")).withColumn("slug", F.col("doc_id")), meta)
    schemas = {"dense": index.chunk_rows(rows).schema, "keyword": index.keyword_documents(rows).schema, "registry": "slug string, last_synced_at timestamp", "known": "slug string, version_hash string"}
    t = TableSet(spark, str(tmp_path / "t"), schemas, {"dense": "document_slug"}, buckets=4)
    t.commit("start", {"registry": spark.createDataFrame([("s:1", None), ("s2", None)], schemas["registry"])}, range(4))
    folder = str(tmp_path / "in")
    for part in ([("s:1", "one text"), ("s2", "two\n\ntexts")], [("s:1", "one text"), ("s2", "new text")], [("s2", "new text")]):
        spark.createDataFrame(part, "slug string, text string").repartition(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("slug string, text string").parquet(folder)
        streaming.content_index(stream, meta, t, str(tmp_path / "c"), F.lit(T)).start().awaitTermination()
    got = sorted((r.slug, r.text) for r in t.read("keyword").collect())
    assert got == [("s2", "new text"), ("s2", "texts"), ("s2", "two"), ("s:1", "one text")]
    assert t.read("known").count() == 3 and t.read("registry").where("last_synced_at IS NULL").count() == 0
    assert t.read("dense").where("chunk_type = 'parent'").count() == 3 and t.read("dense").where("embedding IS NOT NULL").count() == 4


def raw(rows):
    return [(f'<a href="/d/{s}">{t}</a>' if s else t, st, "2024-01-02T00:00:00Z", k) for k, (s, t, st) in enumerate(rows)]


def test_daily_job_goes_on_after_it_died(spark, tmp_path, monkeypatch):
    shape = "title string, field_final_guidance_1 string, changed string, place long"
    texts = lambda *rows: spark.createDataFrame(list(rows), "slug string, text string")
    t = J.job_tables(spark, str(tmp_path), 4)
    day = lambda k, rows, contents, run: J.daily_job(t, spark.createDataFrame(raw(rows), shape), contents, "https://x.org/", F.lit(T + dt.timedelta(days=k)), run)
    out, bad = day(1, [("a", "A", "Draft"), ("b", "B", "Draft"), (None, "no link", "Draft"), ("c", "C", "Draft")], texts(("a", "text a"), ("b", "text b"), ("z", "other")), "one")
    assert sorted((r.slug, r.change_type, r.dense_indexed) for r in out.collect()) == [("a", "new", 1), ("b", "new", 1)] and bad.count() == 1
    second = [("a", "A", "Final"), ("c", "C", "Draft")], texts(("a", "text a, again"))
    with monkeypatch.context() as m:
        m.setattr(J.index, "reindex_run", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            day(2, *second, "two")
    assert t.read("keyword").count() == 2  # the registry is done, the indexes are as they were
    out, _ = day(2, *second, "two")
    assert sorted((r.slug, r.change_type, r.dense_deleted, r.dense_indexed) for r in out.collect()) == [("a", "updated", 0, 1), ("b", "withdrawn", 1, 0)]
    assert sorted(r.text for r in t.read("keyword").collect()) == ["text a", "text a, again"]
    state = {r.slug: (r.lifecycle_state, r.last_synced_at) for r in t.read("registry").collect()}
    assert state == {"a": ("active", T + dt.timedelta(days=2)), "b": ("withdrawn", T + dt.timedelta(days=2)), "c": ("active", None)}
    version = t.manifest()["version"]
    assert day(3, *second, "two")[0].count() == 0 and t.manifest()["version"] == version
