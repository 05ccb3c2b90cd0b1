"""Rules that are easily got nearly right: statuses as written, lineage by docket, instants, white space, text blocks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lorefold.functions import four_decimals, shown_status, utc_text
from lorefold.operators import answers, catalog, documents, registry
from lorefold.operators.asof import previous
from lorefold.sources import write_daily_report

UTC = dt.timezone.utc


def test_previous_rows_of_large_groups(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.choice("pppppq"), rnd.choice(["x", "y", None])) for k in range(300)]
    df = spark.createDataFrame(rows, "t long, g string, s string, v string").withColumn("extra", F.lit(1))
    plain = {r.t: r.o for r in previous(df, "g", ["t"], "v", "o").collect()}
    other = {r.t: r.o for r in previous(df, "g", ["t"], "v", "o", "s").collect()}
    for t, g, s, _ in rows:
        before = [r for r in rows if g is not None and r[1] == g and r[0] < t]
        assert plain[t] == (before[-1][3] if before else None)
        before = [r for r in before if r[2] != s]
        assert other[t] == (before[-1][3] if before else None)
    assert previous(df.where("false"), "g", ["t"], "v", "o").count() == 0


def test_version_events_compare_statuses_as_written(spark):
    v = spark.createDataFrame(
        [("a", 1, "h1", "Final", "active", None), ("a", 2, "h1", "Level 2", "active", None), ("a", 3, "h1", None, "withdrawn", None), ("a", 4, "h2", "Draft", "withdrawn", None), ("b", 5, "h9", "Draft", "active", "D"), ("c", 6, "h8", "Draft", "active", "D")],
        "slug string, created long, hash string, status string, lifecycle string, docket string",
    )
    got = {}
    for r in registry.version_events(v).orderBy("created", "no").collect():
        got.setdefault(r.created, []).append(r.event)
    assert got == {
        1: ["new_version"], 2: ["status_changed"], 3: ["status_changed", "lifecycle_changed"], 4: ["new_version", "supersedes_version"], 5: ["new_version"], 6: ["new_version", "supersedes_version"],
    }
    without = registry.version_events(v.drop("docket"))
    assert without.where("created = 6").count() == 1


def test_instants_are_told_apart_in_any_zone(spark):
    at = dt.datetime(2024, 2, 29, 23, 59, 59, 800000)
    d = spark.createDataFrame([(at,), (at.replace(microsecond=0),), (dt.datetime(1969, 12, 31, 1, 2, 3, 4),), (None,)], "t timestamp")
    want = [at.replace(tzinfo=UTC).isoformat(), at.replace(microsecond=0, tzinfo=UTC).isoformat(), "1969-12-31T01:02:03.000004+00:00", None]
    table = d.collect()
    assert [r[0] for r in d.select(utc_text(F.col("t"))).collect()] == want and len(table) == 4
    schema = "slug string, change_type string, previous_status string, status string, previous_changed_at timestamp, changed_at timestamp"
    changes = spark.createDataFrame([("s", "updated", None, "Final", None, at.replace(microsecond=m)) for m in (0, 800000)], schema)
    titles = spark.createDataFrame([], "slug string, title string")
    here = {r[0] for r in registry.alerts(changes, titles).collect()}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        there = {r[0] for r in registry.alerts(changes, titles).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(here) == 2 and here == there


def test_lines_lose_all_white_space(spark):
    text = "intro\r\n\tSCOPE AND AIM\r\n 2. Records 　\r\nbody\n \t \nWARNING\nBACKGROUND\x0b"
    got = [(r.line_no, r.line, r.char_start) for r in documents.text_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line_no").collect()]
    want, at = [], 0
    for k, raw in enumerate(text.split("\n")):
        line = raw.strip()
        want.append((k, line, at + (raw.find(line) if line else 0)))
        at += len(raw) + 1
    assert got == want
    found = documents.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section_no").collect()
    assert [(r.title, text[r.char_start :][: len(r.title)]) for r in found][1:] == [(t, t) for t in ("SCOPE AND AIM", "2. Records", "BACKGROUND")]


def test_evidence_blocks(spark):
    schema = "query_id long, citation_id string, title string, section_title string, section_id string, page_number int, document_status string, version_hash string, retrieval_score double, rerank_score double, confidence double, source_url string, passage string"
    cards = spark.createDataFrame(
        [(1, "[10]", "Ten", None, "", None, "Draft", "h2", 0.00005, -1.5, 0.18242552, "u2", "second\nline"), (1, "[2]", "Two", "Scope", "s", 3, "Final", "h1", 0.03, 2.0, 1.0, "u1", "first")], schema
    )
    got = answers.evidence_context(cards)
    two = "[2] Two\nSection: Scope; page 3\nStatus: Final; version: h1\nScores: retrieval=0.0300; rerank=2.0000; confidence=1.0000\nSource: u1\nPassage: first"
    ten = "[10] Ten\nSection: Unknown section; page unavailable\nStatus: Draft; version: h2\nScores: retrieval=%.4f; rerank=-1.5000; confidence=0.1824\nSource: u2\nPassage: second\nline" % 0.00005
    assert got.first()["context"] == two + "\n\n" + ten
    asked = spark.createDataFrame([(1, "why {evidence}?"), (2, "what?")], "query_id long, query string")
    p = {r.query_id: r.prompt for r in answers.prompts(asked, got, "Q: {query}\n{evidence}\nEnd {x}").collect()}
    assert p == {1: f"Q: why {{evidence}}?\n{two}\n\n{ten}\nEnd {{x}}", 2: "Q: what?\n\nEnd {x}"}


def test_four_decimals_as_printf(spark):
    rnd = random.Random(2)
    values = [round(rnd.uniform(-40, 40), 6) for _ in range(2000)] + [k / 20000 for k in range(400)] + [0.0, 12.34565, 1e6 + 0.00005, 0.99995, 2.5e-5]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", four_decimals(F.col("x")).alias("t")).collect()
    assert [r.t for r in got if r.t != "%.4f" % r.x and r.t.strip("-0.") + ("%.4f" % r.x).strip("-0.") != ""] == []


def test_shown_status(spark):
    d = spark.createDataFrame([("withdrawn", "Draft"), ("active", "Draft"), ("active", "Level 2"), ("active", None), ("active", "Withdrawn")], "l string, s string")
    assert [r[0] for r in d.select(shown_status(F.col("l"), F.col("s"))).collect()] == ["Withdrawn", "Draft", "Final", "Final", "Withdrawn"]


def test_payloads_that_are_no_json_are_hidden(spark):
    d = spark.createDataFrame([("not json token=1",), ('{"token": 1}',), (None,)], "p string")
    assert [r[0] for r in d.select(answers.redact(F.col("p"))).collect()] == ['"[REDACTED]"', '{"token":"[REDACTED]"}', None]


def test_gate_steps(spark):
    rows = [
        # id, text, cards, confidences, retrieval_failed, faithful, attempt -> failed_gate, reason, retries, next_step
        (1, "a [1]", ["[1]"], [0.9], True, True, 0, "retrieval", "retrieval_failure", 0, "respond"),
        (2, "a [1]", [], [], False, True, 0, "confidence", "no_evidence", 0, "respond"),
        (3, "a [1]", ["[1]"], [0.4], False, True, 0, "confidence", "low_confidence", 0, "respond"),
        (4, "a", ["[1]"], [0.9], False, True, 0, "binding", None, 1, "generate_answer"),
        (5, "a [2]", ["[1]"], [0.9], False, True, 1, "binding", "citation_binding_failure", 2, "respond"),
        (6, "a [1]", ["[1]"], [0.9], None, False, 1, "faithfulness", "faithfulness_failure", 2, "respond"),
        (7, "You are compliant [1]", ["[1]"], [0.9], None, True, 0, None, "compliance_determination_risk", 0, "respond"),
        (8, "a [1]", ["[1]"], [0.9], None, True, 1, None, None, 1, "respond"),
    ]
    schema = "answer_id long, text string, cards array<string>, confidences array<double>, retrieval_failed boolean, faithful boolean, attempt int"
    d = answers.bind_citations(spark.createDataFrame([r[:7] for r in rows], schema))
    got = answers.gate_steps(d, max_retries=2).orderBy("answer_id").collect()
    assert [(r.failed_gate, r.reason, r.retries, r.next_step) for r in got] == [r[7:] for r in rows]


def test_lists_of_sessions_and_alerts(spark, tmp_path):
    at = [dt.datetime(2024, 1, k + 1) for k in range(4)]
    s = spark.createDataFrame([(3, 7, "c", at[0], at[1]), (1, 7, "a", at[0], at[1]), (2, 8, "b", at[0], at[3]), (4, 7, "d", at[0], at[2])], "session_id long, user_id long, title string, created_at timestamp, updated_at timestamp")
    assert [r.session_id for r in answers.sessions_page(s, 7, 2).collect()] == [4, 1] and [r.session_id for r in answers.sessions_page(s, 7, 9, 2).collect()] == [3]
    table = spark.createDataFrame([(1, at[0], "open", "x"), (2, at[1], "open", "gone"), (3, at[2], "resolved", "x")], "alert_id long, detected_at timestamp, status string, slug string")
    page, audit = registry.alert_list(table, spark.createDataFrame([("x",)], "slug string"), "u1", F.lit(at[3]), "open", 10)
    assert [(r.alert_id, r.document) for r in page.collect()] == [(2, "withdrawn-document"), (1, "x")]
    row = audit.first()
    assert (row.event_type, row.user_id, row.payload) == ("alerts_listed", "u1", '{"status":"open","limit":10,"offset":0}')
    target = write_daily_report(spark.createDataFrame([(2, "x")], "b int, a string"), str(tmp_path), "2024-01-02")
    assert target.endswith("/reports/daily-updates/2024-01-02.json") and spark.read.text(target).first()[0] == '{"a":"x","b":2}'
    with pytest.raises(ValueError):
        catalog.seeds(spark.createDataFrame([("s", " ")], "slug string, pdf_url string"), 3)


def test_document_pages(spark):
    reg = spark.createDataFrame([("a", None, "Level 2", "active"), ("b", "B", "Draft", "withdrawn")], "slug string, title string, status string, lifecycle_state string")
    files = spark.createDataFrame([("a", "h1", "raw_pdf", 1), ("a", "h2", "raw_html", 2), ("a", "h1", "raw_html", 0)], "slug string, version_hash string, artifact_kind string, created_at long")
    chunks = spark.createDataFrame([("a", "h2", 1, "s2"), ("a", "h2", 0, "s1"), ("a", "h2", 2, "s1"), ("a", "h1", 0, "old")], "slug string, version_hash string, chunk_no int, section_id string")
    a, b = registry.document_pages(reg, files, chunks).orderBy("slug").collect()
    assert (a.title, a.status, a.versions, a.section_ids) == ("a", "Final", ["h2", "h1"], ["s1", "s2"]) and [tuple(x) for x in a.artifacts] == [("h2", "raw_html"), ("h1", "raw_pdf"), ("h1", "raw_html")]
    assert (b.title, b.status, b.versions, b.artifacts, b.section_ids) == ("B", "Withdrawn", [], [], [])
