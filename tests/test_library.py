import datetime as dt
import difflib
import json

import pytest
from pyspark.sql import functions as F

from lorefold import streaming
from lorefold.functions import malformed_markers
from lorefold.operators import answers, catalog, documents, filters, index, registry, retrieval
from lorefold.sources import artifact_lookup, artifacts, write_exports, write_report, write_snapshot

T = dt.datetime(2024, 1, 1)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.mark.parametrize("line, ok", [("Scope of review", True), ("Discussion of it", False), ("Recommendation for use", True), ("CONCLUSION", True), ("2.1. Dotted part", False), ("IV) Parts and pieces", True)])
def test_heading_words(spark, line, ok):
    assert spark.createDataFrame([(line,)], "l string").select(documents.is_heading(F.col("l"))).first()[0] is ok


def test_blank_preamble_is_no_section(spark):
    d = spark.createDataFrame([(1, " \n \nSCOPE AND AIM\nbody"), (2, "  \n"), (3, None), (4, "only text")], "doc_id long, text string")
    got = rows(documents.sections(d).select("doc_id", "title"))
    assert got == [(1, "SCOPE AND AIM"), (4, "Document")]


def test_parents_hold_whole_paragraphs_and_children_are_cut(spark):
    paragraphs = ["alpha beta gamma delta", "one two three", "w " * 30 + "end", "last"]
    text = "\n\n".join(paragraphs)
    got = documents.document_chunks(spark.createDataFrame([(7, text), (8, None), (9, " ")], "doc_id long, text string"), 40, 30, 6).orderBy("chunk_no").collect()
    assert {r["doc_id"] for r in got} == {7} and [r["chunk_no"] for r in got] == list(range(len(got)))
    parents = [r for r in got if r["chunk_type"] == "parent"]
    assert all(len(r["text"]) <= 40 and text[r["char_start"] : r["char_end"]] == r["text"] for r in parents)
    assert parents[0]["text"] == "alpha beta gamma delta\n\none two three" and parents[-1]["text"] == "last"
    ids = {r["chunk_id"] for r in parents}
    for r in got:
        if r["chunk_type"] == "child":
            assert r["parent_chunk_id"] in ids and len(r["text"]) <= 30
    with pytest.raises(ValueError):
        documents.check_sizes(0, 10, 1)


def test_pages_of_chunks(spark):
    pages = spark.createDataFrame([(1, 1, "first page"), (1, 2, " second "), (1, 3, None)], "doc_id long, page_number int, text string")
    a = documents.assemble(pages)
    assert a.first()["text"] == "first page\nsecond\n" and [tuple(p) for p in a.first()["pages"]] == [(1, 0, 10), (2, 11, 17), (3, 18, 18)]
    got = documents.document_chunks(a, 10, 10, 0).where("chunk_type = 'child'").orderBy("chunk_no").collect()
    assert all(r["page_number"] == (1 if r["char_start"] <= 10 else 2) for r in got) and {r["page_number"] for r in got} == {1, 2}
    assert rows(documents.low_text(pages, 7))[0][3] is True


def test_links_times_and_addresses(spark):
    d = spark.createDataFrame([('<p>x</p><A class="q" HREF=\'../a?b\'>one <b>two</b></A>',), ("no <i>anchor</i>",), (None,), ("<a>no link</a>",)], "f string")
    got = [r[0] if r[0] is None else tuple(r[0]) for r in d.select(catalog.link(F.col("f"), "https://h.org/d/page")).collect()]
    assert got == [("one two", "https://h.org/d/../a?b"), ("no anchor", None), (None, None), ("no link", None)]
    urls = spark.createDataFrame([("http://o/x",), ("//c/x",), ("/r",), ("s",), ("#f",)], "u string").select(catalog.resolve_url(F.col("u"), "https://h.org/d/page"))
    assert [r[0] for r in urls.collect()] == ["http://o/x", "https://c/x", "https://h.org/r", "https://h.org/d/s", "https://h.org/d/page#f"]
    t = spark.createDataFrame([("<time datetime='2024-01-02'>x</time>",), ("<time>y</time>",), ("z",)], "t string").select(catalog.time_of(F.col("t")))
    assert [r[0] for r in t.collect()] == ["2024-01-02", "y", "z"]


def test_rejected_rows_keep_their_reason(spark):
    d = spark.createDataFrame([("<a href='/d/s-1'>A</a>", "13/45/2020"), ("plain", None), ("<a href='http://h/'>B</a>", None), ("<a href='/x'>C</a>", "1/2/2020")], "title string, field_issue_datetime string")
    got = {r["title"]: (r["reject"], r["slug"]) for r in catalog.normalized(d, "https://h.org").collect()}
    assert got == {"A": ("issue date", "s-1"), "plain": ("no title link", None), "B": ("no slug", None), "C": (None, "x")}


def test_file_endings(spark):
    d = spark.createDataFrame([("Application/PDF; q", None, "u"), ("text/html", None, "u"), (None, "raw_html", "u"), ("x/y", None, "http://h/a.b/c.TXT?z"), (None, None, "http://h/")], "c string, k string, u string")
    assert [r[0] for r in d.select(catalog.extension(F.col("c"), F.col("k"), F.col("u"))).collect()] == ["pdf", "html", "html", "txt", "bin"]


def test_filters(spark):
    schema = "document_slug string, lifecycle_state string, center string, topics array<string>, issue_date date"
    d = spark.createDataFrame([("a", "active", "x", ["p", "q"], dt.date(2020, 1, 1)), ("b", "withdrawn", "x", ["p"], dt.date(2020, 1, 2)), ("c", "active", "y", ["p"], dt.date(2021, 1, 1))], schema)
    find = lambda f, **k: [r[0] for r in d.where(filters.clauses(f, **k)).orderBy("document_slug").collect()]
    assert find(None) == ["a", "c"] and find({"lifecycle_state": "withdrawn"}) == ["b"] and find({"center": "x", "topics": []}) == ["a"]
    assert find({"topics": ["p", "q"]}) == ["a"] and find({"topics": ["q", "z"]}, topics_mode="any") == ["a"]
    assert find({"issue_date_from": "2020-01-01", "issue_date_to": "2020-12-31"}) == ["a"]
    with pytest.raises(ValueError):
        filters.clauses({"colour": "red"})


def test_owners_and_phrases(spark):
    d = spark.createDataFrame([("u", "You Are Compliant."), ("v", "you are compliantly"), (None, None)], "user_id string, t string")
    assert d.where(filters.visible_to("u")).count() == 1 and d.where(filters.visible_to("u", admin=True)).count() == 3
    assert [r[0] for r in d.select(filters.decides_compliance(F.col("t"))).collect()] == [True, False, False]


def _side(spark, *r):
    return spark.createDataFrame(list(r), "query_id long, doc_id long, score double, rank int")


def test_hybrid_sides_may_fail(spark):
    q = spark.createDataFrame([(1, "red fox"), (2, "nothing")], "query_id long, text string")
    docs = spark.createDataFrame([(10, "a red fox"), (11, "a fox")], "doc_id long, text string")
    good = lambda a, b: _side(spark, (1, 11, 0.9, 1), (1, 10, 0.5, 2))

    def bad(*_):
        raise OSError("down")

    results, status = retrieval.hybrid(q, docs, bad, good, rerank_top_k=1)
    assert rows(results.select("query_id", "doc_id", "rank", "reranker_failed")) == [(1, 10, 1, False)]
    assert rows(status) == [(1, "failed", "success", "success"), (2, "failed", "empty", "skipped")]
    results, status = retrieval.hybrid(q, docs, good, good, reranker=bad, rerank_top_k=2)
    got = rows(results.select("doc_id", "rank", "rrf_score", "rerank_score", "reranker_failed"), "rank")
    assert [r[0] for r in got] == [11, 10] and all(r[2] == r[3] and r[4] for r in got) and status.where("query_id = 1").first()["reranker_status"] == "failed"
    with pytest.raises(retrieval.RetrievalError) as e:
        retrieval.hybrid(q, docs, bad, bad)
    assert e.value.diagnostic_codes == ["dense_unavailable", "keyword_unavailable"]


def test_models_as_callables(spark):
    q = spark.createDataFrame([(1, "x")], "query_id long, text string")
    docs = spark.createDataFrame([(k, "t" * k) for k in range(1, 6)], "doc_id long, text string")
    found = _side(spark, *[(1, k, 1.0, k) for k in range(1, 6)])
    fused = retrieval.fuse(found, found.limit(0), 5)
    best = retrieval.rerank(fused, q, docs, 2, retrieval.predicted(lambda pairs: [len(t) for _, t in pairs], 2))
    assert rows(best.select("doc_id", "rank"), "rank") == [(5, 1), (4, 2)]
    v = docs.select("doc_id", retrieval.encoded(lambda texts: [[len(t), 1.0] for t in texts], 2)(F.col("text")).alias("v"))
    assert rows(v)[4] == (5, [5.0, 1.0])
    with pytest.raises(ValueError):
        retrieval.check_search(" ", 1, 1)


def test_cards_close_on_gaps(spark):
    ranked = spark.createDataFrame([(1, 10, 1, 0.1, 2.0, False), (1, 11, 2, 0.1, 2.0, True)], "query_id long, doc_id long, rank int, rrf_score double, rerank_score double, reranker_failed boolean")
    chunks = spark.createDataFrame([(10, "text", "T", "u", "v", "Final", 0, 3), (11, "text", "T", "", "v", "Final", 2, 3)], "doc_id long, text string, title string, source_url string, version_hash string, status string, page int, page_number int")
    got = rows(retrieval.cards(ranked, chunks).select("citation_id", "page_number", "confidence", "missing"))
    assert got == [("[1]", 3, round(1 / (1 + 2.718281828459045**-2), 6), None), ("[2]", 2, 0.0, "source_url")]
    both = retrieval.renumbered(retrieval.cards(ranked, chunks), retrieval.cards(ranked, chunks))
    assert sorted(r[0] for r in both.select("citation_id").collect()) == ["[1]", "[2]", "[3]", "[4]"]


def test_index_upkeep(spark, tmp_path):
    now = F.lit(T)
    docs = spark.createDataFrame([(k, f"text of {k}\n\nmore of it") for k in range(4)], "doc_id long, text string")
    meta = docs.select(F.col("doc_id").cast("string").alias("slug"), F.lit("t").alias("title"), F.lit("v1").alias("version_hash"), *[F.lit("x").alias(c) for c in ("status", "lifecycle_state", "center", "issuing_office", "communication_type", "docket_number", "source_url")], F.array(F.lit("a")).alias("topics"), F.to_date(F.lit("2024-01-02")).alias("issue_date"))
    chunked = documents.document_chunks(docs, 100, 14, 0).withColumn("slug", F.col("doc_id").cast("string"))
    made = index.with_metadata(chunked, meta)
    dense, keyword = index.chunk_rows(made).where("chunk_type = 'child'"), index.keyword_documents(made)
    assert len(keyword.columns) == 23 and dense.count() == 8 and keyword.first()["evidence_payload"]["issue_date"] == "2024-01-02"
    changed = spark.createDataFrame([("1", "v1")], "slug string, version_hash string")
    gone = spark.createDataFrame([("2",), ("9",)], "slug string")
    d, k, out = index.reindexed(dense, keyword, made.where("slug = '1'"), changed, gone, now)
    assert d.count() == k.count() == 6 and d.where("document_slug = '2'").count() == 0
    assert rows(out.select("slug", "dense_deleted", "dense_indexed", "keyword_deleted", "keyword_indexed")) == [("1", 2, 2, 2, 2), ("2", 2, 0, 2, 0), ("9", 0, 0, 0, 0)]
    r = index.mark_indexed(spark.createDataFrame([("1", None), ("5", None)], "slug string, last_synced_at timestamp"), out)
    assert rows(r) == [("1", T), ("5", None)]
    old = spark.createDataFrame([("a", 1, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1))], "chunk_id string, v int, created_at timestamp, updated_at timestamp")
    up = index.upsert(old, spark.createDataFrame([("a", 2), ("b", 3)], "chunk_id string, v int"), "chunk_id", now)
    assert rows(up) == [("a", 2, dt.datetime(2020, 1, 1), T), ("b", 3, T, T)]
    path = str(tmp_path / "t")
    assert index.ensure_table(spark, path, "a long, b string") and not index.ensure_table(spark, path, "a long, b string")
    index.append_strict(spark.createDataFrame([("x", 1)], "b string, a long"), path)
    with pytest.raises(ValueError):
        index.append_strict(spark.createDataFrame([(1,)], "a long"), path)
    bad = index.with_metadata(chunked.withColumn("slug", F.lit(" ")), meta)
    assert index.chunk_rows(bad).count() == 0


def test_alert_fingerprints_differ_by_each_field(spark):
    schema = "slug string, change_type string, previous_status string, status string, previous_changed_at timestamp, changed_at timestamp"
    base = ["s", "updated", "Draft", "Final", T, T]
    other = [["z", "updated", "Draft", "Final", T, T], ["s", "updated", None, "Final", T, T], ["s", "updated", "Draft", "Final", None, T], ["s", "updated", "Draft", "Final", T, None]]
    titles = spark.createDataFrame([("s", "Title")], "slug string, title string")
    got = registry.alerts(spark.createDataFrame([base, base, *other], schema), titles)
    assert got.count() == 5 and {r["title"] for r in got.collect()} == {"Title", "z"}
    versions = spark.createDataFrame([("s", "h")], "slug string, version_hash string")
    one = spark.createDataFrame([base], schema)
    assert registry.alerts(one, titles, versions).first()[0] != registry.alerts(one, titles).first()[0]


def test_text_diff_is_the_library_s(spark):
    a, b = ["p one", "p two", "p three"], ["p one", "p 2", "p three"]
    rows_ = [("s", v, "parent", k, t) for v, ts in (("v1", a), ("v2", b)) for k, t in enumerate(ts)]
    chunks = spark.createDataFrame(rows_, "slug string, version_hash string, chunk_type string, chunk_no int, text string")
    pairs = spark.createDataFrame([("s", "v1", "v2"), ("none", "v1", "v2")], "slug string, previous string, current string")
    got = [r[2] for r in rows(registry.text_diff(chunks, pairs), "slug", "line_no")]
    assert got == list(difflib.unified_diff(a, b, "s@v1", "s@v2", lineterm=""))


def test_versions_supersede_by_docket(spark):
    v = spark.createDataFrame([("a", "D", 1, "h1", "Draft"), ("b", "D", 2, "h2", None), ("b", "D", 3, "h2", "x"), ("c", None, 4, "h3", "Withdrawn")], "slug string, docket string, created long, hash string, status string")
    got = rows(registry.version_snapshots(v), "created")
    assert [(r[3], r[4], r[5]) for r in got] == [("Draft", None, False), ("Final", "h1", False), ("Final", "h1", True), ("Withdrawn", None, False)]


def test_views(spark):
    chunks = spark.createDataFrame([("1", 1, "v2", 0, "s-1", "A", 1, "u"), ("1", 1, "v2", 1, "s-2", "B", 2, "u"), ("1", 1, "v2", 2, "s-1", "A", 3, "u")], "slug string, doc_id long, version_hash string, chunk_no int, section_id string, section_title string, page_number int, source_url string")
    versions = spark.createDataFrame([("1", "v1", 1), ("1", "v2", 2)], "slug string, hash string, created long")
    assert rows(registry.document_views(versions, chunks)) == [("1", ["v2", "v1"], "v2", ["s-1", "s-2"])]
    assert rows(registry.section_navigation(chunks)) == [(1, "s-1", 0, "A", 1), (1, "s-2", 1, "B", 2)]
    r = registry.reconciled(spark.createDataFrame([("a", "active"), ("b", "withdrawn")], "slug string, lifecycle_state string"), spark.createDataFrame([("a",)], "document_slug string"))
    assert tuple(r.first()) == (1, 1, None, True)


def test_secrets_are_hidden_at_any_depth(spark):
    value = {"Connection_String": "x", "list": [{"TOKEN": 1, "ok": [None, "é"]}], "cookie": "kept"}
    d = spark.createDataFrame([(json.dumps(value),), (None,)], "p string")
    got = [r[0] for r in d.select(answers.redact(F.col("p"))).collect()]
    assert json.loads(got[0]) == {"Connection_String": "[REDACTED]", "list": [{"TOKEN": "[REDACTED]", "ok": [None, "é"]}], "cookie": "kept"} and got[1] is None


def test_inner_brackets_are_malformed(spark):
    assert spark.createDataFrame([("a [b [1] c",)], "t string").select(malformed_markers(F.col("t"))).first()[0] == ["[b [1]"]


def test_refusals_and_transcripts(spark):
    d = spark.createDataFrame([("low_confidence",), ("odd",), (None,)], "r string")
    got = [r[0] for r in d.select(answers.refusal_message(F.col("r"), F.lit("Why."))).collect()]
    assert got == [answers.REFUSALS["low_confidence"] + " Why.", answers.OTHER_REFUSAL + " Why.", None]
    turns = spark.createDataFrame([(1, 5, True, None, []), (1, 9, False, "yes", ["[1] c"])], "conv_id long, turn int, refused boolean, text string, citations array<string>")
    assert answers.transcripts(turns, "T").first()["transcript"] == "T\n\nQ1 (refused):\n\n\nQ2 (answered):\nyes\nCitations:\n[1] c\n"


def test_stateful_budget_agrees_with_batch(spark, tmp_path):
    e = spark.createDataFrame([(u, k, T + dt.timedelta(seconds=20 * k)) for u in (1, 2) for k in range(12)], "user_id long, event_id long, ts timestamp")
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = streaming.budget(stream, 2, 60).writeStream.format("memory").queryName("budget").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("budget")) == rows(answers.budget(e, 2, 60))


def test_registry_and_content_streams(spark, tmp_path):
    schema = "slug string, status string, changed_at timestamp"
    folder, out = str(tmp_path / "feed"), str(tmp_path / "registry")
    for feed in ([("a", "Draft", T), ("b", "Final", T)], [("a", "Final", T)]):
        spark.createDataFrame(feed, schema).repartition(1).write.mode("append").parquet(folder)
        streaming.registry_sync(spark.readStream.schema(schema).parquet(folder), out, str(tmp_path / "c1"), F.lit(T)).start().awaitTermination()
    got = rows(spark.read.parquet(f"{out}/batch=1").select("slug", "status", "lifecycle_state", "change_type"))
    assert got == [("a", "Final", "active", "updated"), ("b", "Final", "withdrawn", "withdrawn")]
    contents, kept = str(tmp_path / "contents"), str(tmp_path / "kept")
    for batch in ([(1, "one text"), (2, "two texts")], [(1, "one text"), (2, "new text")]):
        spark.createDataFrame(batch, "doc_id long, text string").repartition(1).write.mode("append").parquet(contents)
        streaming.content_chunks(spark.readStream.schema("doc_id long, text string").parquet(contents), kept, str(tmp_path / "c2")).start().awaitTermination()
    assert rows(spark.read.parquet(f"{kept}/chunks/batch=1").where("chunk_type = 'child'").select("doc_id", "text")) == [(2, "new text")]
    assert spark.read.parquet(f"{kept}/known/batch=1").count() == 3


def test_files_and_sinks(spark, tmp_path):
    feeds = spark.createDataFrame([('{"a": 1}',)], "value string")
    target = write_snapshot(feeds, str(tmp_path), "20240101T000000Z")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_snapshot(feeds, str(tmp_path), "20240101T000000Z")
    found = artifacts(spark, target).collect()
    assert [r["size_bytes"] for r in found if r["size_bytes"]] == [9]
    write_report(spark.createDataFrame([(2, "x")], "b int, a string"), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first()[0] == '{"a":"x","b":2}'
    write_exports(spark.createDataFrame([("e1", "line"), ("e2", None)], "export_id string, text string"), str(tmp_path))
    assert rows(spark.read.text(str(tmp_path / "exports"))) == [("line", "e1")]
    table = spark.createDataFrame([("s", "h", "raw_pdf"), ("s", "h", "other")], "document_slug string, version_hash string, artifact_kind string")
    assert artifact_lookup(table, "s", "h").count() == 1
    assert spark.range(1000).agg(F.approx_count_distinct("id", 0.02)).first()[0] == pytest.approx(1000, rel=0.06)
