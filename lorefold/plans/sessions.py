"""Queries on conversations, answers, audit rows and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefold.operators import answers as A
from lorefold.operators import jobs as J


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _turns(spark, d):
    c = _t(spark, d, "conversations")
    key = F.col("conv_id") + F.col("turn")
    line = A.citation_line(F.col("role"), F.when(key % 2 == 0, "s"), F.when(key % 3 == 0, F.col("turn")), F.lit("http://h"), F.lit("[1]"))
    return c.select("conv_id", "turn", "text", (key % 5 == 0).alias("refused"), F.when(key % 4 == 0, F.array(line)).otherwise(F.array().cast("array<string>")).alias("citations"))


def transcript_text(spark, d):
    return A.transcripts(_turns(spark, d))


def summary_texts(spark, d):
    rows = _turns(spark, d).where("turn = 0").select(F.col("conv_id").cast("string").alias("document_id"), F.lit("summary").alias("summary_type"), F.coalesce("text", F.lit("")).alias("text"), "citations")
    return A.summary_text(rows)


def summary_gates(spark, d):
    """Requests that fail at each gate in turn, by the remainders of their number."""
    k = F.col("doc_id")
    r = _t(spark, d, "documents").select(
        "doc_id", F.when(k % 3 == 0, "key_changes").otherwise("summary").alias("summary_type"), F.when(k % 4 != 0, F.when(k % 5 == 0, "v9").otherwise("v1")).alias("compare_version_hash"),
        (k % 7 != 0).alias("known"), F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("v2"), F.lit("v1"))).alias("versions"),
        F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("[1]"))).alias("cards"), ((k % 10) / 10.0).alias("confidence"),
        F.when(k % 17 == 0, "unknown").otherwise("bound").alias("verdict"), (k % 19 != 0).alias("faithful"),
    )
    return A.summary_gate(r, 0.3).select("doc_id", "reason")


def export_rows(spark, d):
    """Exports of summaries and sessions, some of both, some of neither."""
    k = F.col("doc_id")
    requests = _t(spark, d, "documents").select(k.alias("export_id"), F.when(k % 3 != 0, k % 50).alias("summary_id"), F.when(k % 4 == 0, k % 60).alias("session_id"))
    c = _t(spark, d, "conversations").where("turn = 0")
    return A.exports(requests, c.select(F.col("conv_id").alias("summary_id"), F.coalesce("role", F.lit("")).alias("text")), c.select(F.col("conv_id").alias("session_id"), F.lit("t").alias("text")))


def session_last_turn(spark, d):
    return A.latest_turn(_t(spark, d, "conversations"))


def session_page(spark, d):
    """The second page of ten sessions, longest first (a top-k report)."""
    n = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return n.orderBy(F.col("n_turns").desc(), "conv_id").offset(10).limit(10)


def _answers(spark, d):
    """Turns with markers set in: [1] always, an unknown [9] and a malformed [2,3] for some."""
    c = _t(spark, d, "conversations")
    key = F.col("conv_id") * 31 + F.col("turn")
    text = F.concat_ws(
        " ", F.when(key % 3 != 0, "Point [2]."), F.when(key % 3 == 1, "First [1]."), F.when(key % 5 == 0, "Other [9]."), F.when(key % 7 == 0, "Both [2,3].")
    )
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.when(key % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("[1]"), F.lit("[2]"))).alias("cards"),
        F.when(key % 11 == 0, F.array().cast("array<double>")).otherwise(F.array((key % 10) / 10.0, F.lit(0.3))).alias("confidences"),
        (key % 2).cast("int").alias("attempt"),
    )


def bind_citations(spark, d):
    b = A.bind_citations(_answers(spark, d))
    return b.select("answer_id", *[F.array_join(c, "|").alias(c) for c in ("used", "malformed", "unknown")], "verdict")


def answer_gate(spark, d):
    return A.gate(A.bind_citations(_answers(spark, d))).select("answer_id", "confidence", "reason", "needs_retry")


def _gated(spark, d):
    return A.faithfulness(A.gate(A.bind_citations(_answers(spark, d))))


def final_answers(spark, d):
    return A.final_answers(_gated(spark, d))


def answer_routes(spark, d):
    return A.routes(_gated(spark, d)).select("answer_id", "after_confidence", "after_binding", "after_faithfulness")


def refusal_rates(spark, d):
    g = answer_gate(spark, d)
    return g.groupBy(F.coalesce("reason", F.lit("answered")).alias("outcome")).agg(F.count("*").alias("n"))


def citation_rates(spark, d):
    return A.citation_rates(A.bind_citations(_answers(spark, d)))


def refusal_quality(spark, d):
    """Refusals against those that a rule asks for."""
    return A.refusal_quality(final_answers(spark, d).select("refused", (F.col("answer_id") % 3 == 0).alias("should_refuse")))


def query_understanding(spark, d):
    """Model answers about turns: good JSON, JSON with gaps, no JSON."""
    k = F.col("conv_id") + F.col("turn")
    raw = F.when(k % 3 == 0, F.concat(F.lit('{"rewritten_query": "q'), k.cast("string"), F.lit('", "intent": "find", "entities": {"a": "b"}}'))).when(k % 3 == 1, '{"rewritten_query": ""}').otherwise("no json")
    rows = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("role").alias("query"), raw.alias("raw"))
    u = A.understood(rows)
    return u.select("query_id", "rewritten_query", "intent", F.size("entities").alias("n_entities"))


def trace_durations(spark, d):
    """Steps of each session as an execution trace."""
    at = F.timestamp_seconds(F.col("turn") * 10)
    step = F.struct("turn", F.col("role").alias("node"), at.alias("started_at"), F.timestamp_seconds(F.col("turn") * 10 + F.col("conv_id") % 7).alias("completed_at"), F.lit("success").alias("status"))
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return A.trace_steps(c.select(F.col("conv_id").alias("run_id"), "steps"))


def session_create(spark, d):
    e = _t(spark, d, "events").select("user_id", F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.col("event_type")).alias("title"))
    return J.session_rows(e, F.lit("2025-01-01").cast("timestamp")).select("session_id", "user_id", "title")


def turn_records(spark, d):
    a = final_answers(spark, d).withColumns({"session_id": (F.col("answer_id") / 1000).cast("long"), "user_id": F.lit("u"), "query": F.lit("q")})
    r = J.turn_records(a)
    return r.select("session_id", "answer_id", "audit_type", F.col("guardrails.refusal_reason").alias("refusal_reason"), F.col("guardrails.n_evidence").alias("n_evidence"))


def summary_records(spark, d):
    k = F.col("doc_id")
    s = _t(spark, d, "documents").select(
        k.alias("summary_id"), F.lit("u").alias("user_id"), k.cast("string").alias("document_id"), F.lit("summary").alias("summary_type"), F.lit("t").alias("text"),
        F.array(F.lit("[1]"), F.lit("[2]")).alias("cards"), F.array(F.lit("v2"), F.lit("v1")).alias("versions"), F.when(k % 2 == 0, "v1").alias("compare_version_hash"),
        F.lit(0.5).alias("confidence"), F.when(k % 3 == 0, "no_evidence").alias("reason"),
    )
    r = J.summary_records(s)
    return r.select("summary_id", F.size("evidence").alias("n_evidence"), "versions.current", "versions.previous", F.col("guardrails.faithfulness_passed").alias("passed"), "audit_type")


def stored_candidates(spark, d):
    """Neighbours as stored rows with gaps that their payloads fill."""
    k = F.col("vec_id")
    payload = F.struct(F.lit("s").alias("slug"), F.lit("v").alias("version_hash"), F.lit("u").alias("source_url"), F.lit("x").alias("section_id"), F.lit(4).alias("page"))
    some = lambda m, c: F.when(k % m != 0, c)
    rows = _t(spark, d, "embeddings").select(
        (k % 10).alias("query_id"), k.alias("chunk_id"), (F.col("label") / 100.0).alias("distance"), payload.alias("payload"), some(2, F.lit("own")).alias("slug"), some(3, F.lit("w")).alias("version_hash"),
        some(5, F.lit("http")).alias("source_url"), some(7, F.lit("y")).alias("section_id"), some(11, F.lit(9)).alias("page_number"),
    )
    return J.stored_candidates(rows)


def answer_versions(spark, d):
    cards = _t(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("version_hash"))
    v = A.version_hashes(cards)
    return v.select("query_id", F.array_join("hashes", "|").alias("hashes"))


def audit_page(spark, d):
    return A.audit_page(_t(spark, d, "events"), "purchase").select("event_id", "ts", "user_id")


def audit_redact(spark, d):
    """Secrets at several depths, in objects and lists."""
    inner = F.struct(F.lit("dsn").alias("Connection_String"), F.col("user_id").alias("user"), F.array(F.struct(F.lit("t").alias("token"), F.lit(1).alias("n"))).alias("items"))
    payload = F.to_json(F.struct(F.col("event_type").alias("kind"), F.lit("abc").alias("Api_Key"), inner.alias("nested")))
    return _t(spark, d, "events").select("event_id", A.redact(payload).alias("payload"))


def audit_append(spark, d):
    """Search events as audit rows."""
    rows = _t(spark, d, "events").select("event_id", "user_id", F.lit(None).cast("string").alias("session_id"), F.lit("/api/search").alias("route"), "value")
    a = A.audit_rows(rows, "search", F.struct("event_id", F.lit("x").alias("password")), F.lit("2025-01-01").cast("timestamp"))
    return a.select("event_type", "user_id", "route", "payload")


def audit_counts(spark, d):
    e = _t(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))


def rate_limit_replay(spark, d):
    return A.budget(_t(spark, d, "events"), 3, 86_400)


def gate_steps(spark, d):
    """Answers through all gates; some retrievals fail, some answers decide a matter of compliance."""
    c = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), (F.col("conv_id") * 31 + F.col("turn")).alias("k"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    a = _answers(spark, d).join(c.hint("merge"), "answer_id")
    a = a.withColumn("text", F.when(F.col("size") % 6 == 0, F.concat("text", F.lit(" So you are compliant."))).otherwise(F.col("text")))
    a = A.bind_citations(a.withColumns({"retrieval_failed": F.col("size") % 9 == 0, "faithful": F.col("size") % 4 != 0}))
    return A.gate_steps(a, max_retries=2).select("answer_id", "failed_gate", "reason", "retries", "next_step")


def sessions_owned(spark, d):
    """A page of one owner's sessions."""
    e = _t(spark, d, "events").select(F.col("event_id").alias("session_id"), "user_id", F.col("event_type").alias("title"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return A.sessions_page(e, 7, 20, 3).select("session_id", "title", "updated_at")


QUERIES = {
    f.__name__: f
    for f in (gate_steps, sessions_owned, transcript_text, summary_texts, summary_gates, export_rows, session_last_turn, session_page, bind_citations, answer_gate, final_answers, answer_routes, refusal_rates, citation_rates, refusal_quality, query_understanding, trace_durations, session_create, turn_records, summary_records, stored_candidates, answer_versions, audit_append, audit_page, audit_redact, audit_counts, rate_limit_replay)
}

_ANSWERS = """WITH k AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id * 31 + turn AS k FROM conversations),
 a AS (SELECT answer_id, k, concat_ws(' ', CASE WHEN k % 3 <> 0 THEN 'Point [2].' END, CASE WHEN k % 3 = 1 THEN 'First [1].' END, CASE WHEN k % 5 = 0 THEN 'Other [9].' END, CASE WHEN k % 7 = 0 THEN 'Both [2,3].' END) AS text,
   CASE WHEN k % 11 = 0 THEN [] ELSE ['[1]', '[2]'] END AS cards, CASE WHEN k % 11 = 0 THEN 0 ELSE greatest((k % 10) / 10, 0.3) END AS confidence, k % 2 AS attempt FROM k),
 u AS (SELECT *, list_filter(['[2]', '[1]', '[9]'], lambda m: contains(text, m)) AS used, list_filter(regexp_extract_all(text, '\\[[^\\[\\]]*\\d[^\\[\\]]*\\]'), lambda m: NOT regexp_matches(m, '^\\[\\d+\\]$')) AS malformed FROM a),
 v AS (SELECT *, list_filter(used, lambda m: NOT list_contains(cards, m)) AS unknown FROM u),
 b AS (SELECT *, CASE WHEN len(malformed) > 0 THEN 'malformed' WHEN len(used) = 0 THEN 'none' WHEN len(unknown) > 0 THEN 'unknown' ELSE 'bound' END AS verdict FROM v),
 g AS (SELECT answer_id, confidence::DOUBLE AS confidence, CASE WHEN len(cards) = 0 THEN 'no_evidence' WHEN confidence < 0.5 THEN 'low_confidence' WHEN verdict <> 'bound' THEN 'citation_binding_failure' END AS reason, attempt FROM b)"""

ORACLES = {
    "transcript_text": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, conv_id + turn AS s FROM conversations)
      SELECT conv_id, count(*) AS n_turns, 'Transcript' || chr(10) || chr(10) || string_agg('Q' || k || ' (' || CASE WHEN s % 5 = 0 THEN 'refused' ELSE 'answered' END || '):' || chr(10) || coalesce(text, '') ||
        CASE WHEN s % 4 = 0 THEN chr(10) || 'Citations:' || chr(10) || '[1] ' || role || ' - ' || CASE WHEN s % 2 = 0 THEN 's' ELSE 'N/A' END || ' (page ' || CASE WHEN s % 3 = 0 THEN turn::VARCHAR ELSE 'N/A' END || ') - http://h' ELSE '' END || chr(10), chr(10) ORDER BY k) AS transcript FROM t GROUP BY conv_id""",
    "summary_texts": """SELECT CAST(conv_id AS VARCHAR) AS document_id, 'Summary: ' || conv_id || chr(10) || 'Type: summary' || chr(10) || chr(10) || coalesce(text, '') ||
        CASE WHEN conv_id % 4 = 0 THEN chr(10) || chr(10) || 'Citations:' || chr(10) || '[1] ' || role || ' - s (page ' || CASE WHEN conv_id % 3 = 0 THEN '0' ELSE 'N/A' END || ') - http://h' ELSE '' END AS text FROM conversations WHERE turn = 0""",
    "summary_gates": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'not_found' WHEN doc_id % 11 = 0 THEN 'no_evidence' WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN 'comparison_required' WHEN doc_id % 4 <> 0 AND doc_id % 5 = 0 THEN 'version_not_found'
      WHEN doc_id % 13 = 0 THEN 'no_evidence' WHEN doc_id % 10 < 3 THEN 'low_confidence' WHEN doc_id % 17 = 0 THEN 'citation_binding_failure' WHEN doc_id % 19 = 0 THEN 'faithfulness_failure' END AS reason FROM documents""",
    "export_rows": """WITH r AS (SELECT doc_id AS k, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 50 END AS s, CASE WHEN doc_id % 4 = 0 THEN doc_id % 60 END AS t FROM documents), c AS (SELECT conv_id, coalesce(role, '') AS role FROM conversations WHERE turn = 0),
      j AS (SELECT k, (s IS NULL) <> (t IS NULL) AS one, coalesce(a.role, CASE WHEN b.conv_id IS NOT NULL THEN 't' END) AS x FROM r LEFT JOIN c a ON a.conv_id = s LEFT JOIN c b ON b.conv_id = t)
      SELECT k AS export_id, CASE WHEN one AND x IS NOT NULL THEN 'exports/' || k || '.txt' END AS object_key, CASE WHEN one THEN x END AS text, CASE WHEN NOT one THEN 'rejected' WHEN x IS NULL THEN 'failed' ELSE 'completed' END AS status FROM j""",
    "final_answers": _ANSWERS + f""", m AS (SELECT g.answer_id, a.text, len(b.used) AS n, g.confidence, g.reason FROM g JOIN a USING (answer_id) JOIN b USING (answer_id))
      SELECT answer_id, CASE reason {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.REFUSALS.items())} ELSE text END AS text, CASE WHEN reason IS NULL THEN n ELSE 0 END::INT AS n_evidence, confidence, reason IS NOT NULL AS refused, reason AS refusal_reason FROM m""",
    "answer_routes": _ANSWERS + """ SELECT g.answer_id, CASE WHEN reason IN ('no_evidence', 'low_confidence') THEN 'respond' ELSE 'generate_answer' END AS after_confidence, CASE WHEN verdict = 'bound' THEN 'faithfulness_guard' WHEN g.attempt < 1 THEN 'generate_answer' ELSE 'respond' END AS after_binding,
      CASE WHEN len(cards) > 0 THEN 'respond' WHEN g.attempt < 1 THEN 'generate_answer' ELSE 'respond' END AS after_faithfulness FROM g JOIN b USING (answer_id)""",
    "citation_rates": _ANSWERS + " SELECT round(avg((len(used) > 0)::INT), 6)::DOUBLE AS coverage, round(sum(len(used) - len(unknown)) / greatest(sum(len(used)), 1), 6)::DOUBLE AS validity FROM b",
    "refusal_quality": _ANSWERS + " SELECT round(count(*) FILTER (reason IS NOT NULL AND answer_id % 3 = 0) / greatest(count(*) FILTER (reason IS NOT NULL), 1), 6)::DOUBLE AS precision, round(count(*) FILTER (reason IS NOT NULL AND answer_id % 3 = 0) / greatest(count(*) FILTER (answer_id % 3 = 0), 1), 6)::DOUBLE AS recall FROM g",
    "query_understanding": """SELECT conv_id * 1000 + turn AS query_id, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'q' || (conv_id + turn) ELSE role END AS rewritten_query, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'find' ELSE 'question' END AS intent, CASE WHEN (conv_id + turn) % 3 = 0 THEN 1 ELSE 0 END::INT AS n_entities FROM conversations""",
    "trace_durations": "SELECT conv_id AS run_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS step_no, role AS node, 'success' AS status, conv_id % 7 * 1000 AS duration_ms FROM conversations",
    "session_create": "SELECT sha256('session' || chr(31) || user_id || chr(31) || event_id) AS session_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'New session' ELSE event_type END AS title FROM events",
    "turn_records": _ANSWERS + " SELECT g.answer_id // 1000 AS session_id, g.answer_id, CASE WHEN reason IS NULL THEN 'answer_completed' ELSE 'answer_refused' END AS audit_type, reason AS refusal_reason, CASE WHEN reason IS NULL THEN len(used) ELSE 0 END::INT AS n_evidence FROM g JOIN b USING (answer_id)",
    "summary_records": "SELECT doc_id AS summary_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END::INT AS n_evidence, 'v2' AS current, CASE WHEN doc_id % 2 = 0 THEN 'v1' END AS previous, doc_id % 3 <> 0 AS passed, CASE WHEN doc_id % 3 = 0 THEN 'summary_refused' ELSE 'summary_completed' END AS audit_type FROM documents",
    "stored_candidates": """SELECT vec_id % 10 AS query_id, vec_id AS chunk_id, round(1 - label / 100, 6)::DOUBLE AS score, CASE WHEN vec_id % 2 <> 0 THEN 'own' ELSE 's' END AS slug, CASE WHEN vec_id % 3 <> 0 THEN 'w' ELSE 'v' END AS version_hash,
      CASE WHEN vec_id % 5 <> 0 THEN 'http' ELSE 'u' END AS source_url, CASE WHEN vec_id % 7 <> 0 THEN 'y' ELSE 'x' END AS section_id, CASE WHEN vec_id % 11 <> 0 THEN 9 ELSE 4 END::INT AS page_number FROM embeddings""",
    "answer_versions": "SELECT user_id AS query_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS hashes FROM events GROUP BY user_id",
    "audit_append": """SELECT 'search' AS event_type, user_id, '/api/search' AS route, '{"event_id":' || event_id || ',"password":"[REDACTED]"}' AS payload FROM events""",
    "rate_limit_replay": """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch(ts::TIMESTAMP) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      f AS (SELECT user_id, 1 AS k, event_id, ts, t, true AS accepted, 0::BIGINT AS retry_after, [t] AS held FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.k, e.event_id, e.ts, e.t, len(list_filter(held, lambda h: h >= e.t - 86400)) < 3, CASE WHEN len(list_filter(held, lambda h: h >= e.t - 86400)) < 3 THEN 0 ELSE greatest(1, ceil(list_filter(held, lambda h: h >= e.t - 86400)[1] + 86400 - e.t)) END::BIGINT,
          CASE WHEN len(list_filter(held, lambda h: h >= e.t - 86400)) < 3 THEN list_append(list_filter(held, lambda h: h >= e.t - 86400), e.t) ELSE list_filter(held, lambda h: h >= e.t - 86400) END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
      SELECT user_id, event_id, ts, accepted, retry_after FROM f""",
    "session_last_turn": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1",
    "session_page": "SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id ORDER BY n_turns DESC, conv_id LIMIT 10 OFFSET 10",
    "bind_citations": _ANSWERS + " SELECT answer_id, array_to_string(used, '|') AS used, array_to_string(malformed, '|') AS malformed, array_to_string(unknown, '|') AS unknown, verdict FROM b",
    "gate_steps": _ANSWERS + """, z AS (SELECT conv_id * 1000 + turn AS answer_id, length(coalesce(text, '')) AS n FROM conversations),
      e AS (SELECT b.answer_id, attempt, CASE WHEN n % 9 = 0 THEN 'retrieval_failure' WHEN len(cards) = 0 THEN 'no_evidence' WHEN confidence < 0.5 THEN 'low_confidence' END AS early,
        CASE WHEN n % 9 = 0 THEN 'retrieval' WHEN len(cards) = 0 OR confidence < 0.5 THEN 'confidence' WHEN verdict <> 'bound' THEN 'binding' WHEN n % 4 = 0 THEN 'faithfulness' END AS failed, n % 6 = 0 AS risky FROM b JOIN z USING (answer_id)),
      f AS (SELECT *, (attempt + CASE WHEN failed IN ('binding', 'faithfulness') THEN 1 ELSE 0 END)::INT AS retries FROM e)
      SELECT answer_id, failed AS failed_gate, coalesce(early, CASE WHEN failed = 'binding' AND retries >= 2 THEN 'citation_binding_failure' WHEN failed = 'faithfulness' AND retries >= 2 THEN 'faithfulness_failure' WHEN risky THEN 'compliance_determination_risk' END) AS reason,
        retries, CASE WHEN failed IN ('binding', 'faithfulness') AND retries < 2 THEN 'generate_answer' ELSE 'respond' END AS next_step FROM f""",
    "sessions_owned": "SELECT event_id AS session_id, event_type AS title, ts AS updated_at FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 20 OFFSET 3",
    "answer_gate": _ANSWERS + " SELECT answer_id, confidence, reason, coalesce(reason, '') = 'citation_binding_failure' AND attempt < 1 AS needs_retry FROM g",
    "refusal_rates": _ANSWERS + " SELECT coalesce(reason, 'answered') AS outcome, count(*) AS n FROM g GROUP BY 1",
    "audit_page": "SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 50",
    "audit_redact": """SELECT event_id, '{"kind":"' || event_type || '","Api_Key":"[REDACTED]","nested":{"Connection_String":"[REDACTED]","user":' || user_id || ',"items":[{"token":"[REDACTED]","n":1}]}}' AS payload FROM events""",
    "audit_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
