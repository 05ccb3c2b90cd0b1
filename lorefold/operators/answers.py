"""Citations, gates, transcripts, audit views and request budgets."""

from __future__ import annotations

import json
import math
import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorefold.functions import four_decimals, malformed_markers, ordered_markers
from lorefold.operators.asof import previous, running_max
from lorefold.operators.filters import decides_compliance

# Keys whose values are never shown
SECRETS = ("authorization", "token", "api_key", "secret", "password", "connection_string")
# What a refusal says
REFUSALS = {
    "no_evidence": "I could not find FDA guidance evidence strong enough to answer this with citations.",
    "low_confidence": "The retrieved FDA guidance evidence is too weak to support a citation-backed answer.",
    "retrieval_failure": "Retrieval failed before usable FDA guidance evidence could be collected.",
    "citation_binding_failure": "I could not bind the generated claims to valid FDA Evidence Cards.",
    "faithfulness_failure": "The generated answer could not be validated against the cited FDA evidence.",
    "unsupported_query": "This request is outside the supported FDA guidance research scope.",
    "compliance_determination_risk": "I cannot make final legal, compliance, approval, or submission-acceptance determinations.",
}
OTHER_REFUSAL = "I could not produce a supported citation-backed answer."
SUMMARY_TYPES = ("summary", "key_requirements", "key_changes")


def bind_citations(answers: DataFrame) -> DataFrame:
    """(answer_id, text, cards array<string>) with the markers used, those unknown or malformed, and a verdict."""
    a = answers.withColumn("used", ordered_markers(F.col("text"))).withColumn("malformed", malformed_markers(F.col("text")))
    a = a.withColumn("unknown", F.filter("used", lambda m: ~F.array_contains(F.col("cards"), m)))
    verdict = (
        F.when(F.size("malformed") > 0, "malformed").when(F.size("used") == 0, "none").when(F.size("unknown") > 0, "unknown").otherwise("bound")
    )
    return a.withColumn("verdict", verdict)


def gate(bound: DataFrame, threshold: float = 0.5, max_retries: int = 1) -> DataFrame:
    """Outcome of the gates in order: evidence, confidence, binding, faithfulness (bound evidence is there)."""
    confidence = F.coalesce(F.array_max("confidences"), F.lit(0.0))
    reason = (
        F.when(F.size("cards") == 0, "no_evidence")
        .when(confidence < threshold, "low_confidence")
        .when(F.col("verdict") != "bound", "citation_binding_failure")
    )
    b = bound.withColumn("confidence", confidence).withColumn("reason", reason)
    return b.withColumn("needs_retry", F.col("reason").eqNullSafe("citation_binding_failure") & (F.col("attempt") < max_retries))


def gate_steps(answers: DataFrame, threshold: float = 0.5, max_retries: int = 1) -> DataFrame:
    """answers with every gate's outcome as columns: failed_gate, reason, retries and next_step, as one pass through the gates leaves them.

    answers: bind_citations' columns, with retrieval_failed, confidences, faithful and attempt (retries so far). A failed retrieval, missing or weak evidence
    refuse at once. An answer that decides a matter of compliance is refused unless a later gate refuses it first. Binding and
    faithfulness each count a retry when they fail, and refuse once the retries are used up.
    """
    confidence = F.coalesce(F.array_max("confidences"), F.lit(0.0))
    early = (
        F.when(F.coalesce("retrieval_failed", F.lit(False)), "retrieval_failure").when(F.size("cards") == 0, "no_evidence").when(confidence < threshold, "low_confidence")
    )
    failed = F.when(early == "retrieval_failure", "retrieval").when(early.isNotNull(), "confidence").when(F.col("verdict") != "bound", "binding").when(~F.coalesce("faithful", F.lit(False)), "faithfulness")
    late = F.col("_failed").isin("binding", "faithfulness")
    over = late & (F.col("retries") >= max_retries)
    reason = (
        F.coalesce("_early", F.when(over & (F.col("_failed") == "binding"), "citation_binding_failure").when(over, "faithfulness_failure"))
    )
    risky = F.when(F.col("_early").isNull() & decides_compliance(F.col("text")), "compliance_determination_risk")
    d = answers.withColumns({"confidence": confidence, "_early": early, "_failed": failed})
    d = d.withColumn("retries", F.col("attempt") + F.coalesce(late, F.lit(False)).cast("int"))
    d = d.withColumn("reason", F.coalesce(reason, risky))
    step = F.when(F.coalesce(late, F.lit(False)) & ~over, "generate_answer").otherwise("respond")
    return d.withColumns({"failed_gate": F.col("_failed"), "next_step": step}).drop("_early", "_failed")


def sessions_page(sessions: DataFrame, user_id, limit: int = 50, offset: int = 0) -> DataFrame:
    """An owner's sessions (session_id, user_id, title, created_at, updated_at), the last one touched first, ties by id: a page of a report."""
    return sessions.where(F.col("user_id") == user_id).orderBy(F.col("updated_at").desc(), "session_id").offset(offset).limit(limit)


def refusal_message(reason: Column, detail: Column | None = None) -> Column:
    """What a refusal says, with a detail behind it if one is given; null without a reason."""
    table = F.create_map(*[F.lit(x) for pair in REFUSALS.items() for x in pair])
    text = F.coalesce(F.get(F.filter(F.array(F.try_element_at(table, reason)), F.isnotnull), F.lit(0)), F.lit(OTHER_REFUSAL))
    if detail is not None:
        text = F.when(F.coalesce(detail, F.lit("")) == "", text).otherwise(F.concat(text, F.lit(" "), detail))
    return F.when(reason.isNotNull(), text)


def faithfulness(bound: DataFrame, validate: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """bound with faithful and faithfulness_score: by validate(text, cards), a score column, else whether there is evidence."""
    score = validate(F.col("text"), F.col("cards")) if validate else F.when(F.size("cards") > 0, 1.0).otherwise(0.0)
    return bound.withColumn("faithfulness_score", score).withColumn("faithful", F.col("faithfulness_score") >= (0.5 if validate else 1.0))


def routes(gated: DataFrame, max_retries: int = 1) -> DataFrame:
    """gated (reason, verdict, faithful, attempt) with the next step after each gate: confidence, binding, faithfulness."""
    again = F.when(F.col("attempt") < max_retries, "generate_answer").otherwise("respond")
    early = F.coalesce(F.col("reason").isin("no_evidence", "low_confidence", "retrieval_failure"), F.lit(False))
    return gated.withColumns(
        {
            "after_confidence": F.when(early, "respond").otherwise("generate_answer"),
            "after_binding": F.when(F.col("verdict") == "bound", "faithfulness_guard").otherwise(again),
            "after_faithfulness": F.when(F.col("faithful"), "respond").otherwise(again),
        }
    )


def final_answers(gated: DataFrame) -> DataFrame:
    """(answer_id, text, n_evidence, confidence, refused, refusal_reason): a refusal wins, and so does missing bound evidence."""
    bound = F.when(F.col("verdict") == "bound", F.filter("used", lambda m: F.array_contains(F.col("cards"), m)))
    reason = F.coalesce("reason", F.when(F.coalesce(F.size(bound), F.lit(0)) < 1, F.lit("citation_binding_failure")))
    d = gated.withColumn("_reason", reason)
    refused = F.col("_reason").isNotNull()
    return d.select(
        "answer_id", F.when(refused, refusal_message(F.col("_reason"))).otherwise(F.col("text")).alias("text"),
        F.when(refused, 0).otherwise(F.size(bound)).alias("n_evidence"), "confidence", refused.alias("refused"), F.col("_reason").alias("refusal_reason"),
    )


def understood(raw: DataFrame) -> DataFrame:
    """raw (query_id, query, raw) with rewritten_query, intent and entities of a JSON answer; another text keeps the query."""
    j = F.from_json("raw", "rewritten_query string, intent string, entities map<string,string>")
    some = lambda c, other: F.coalesce(F.nullif(j[c], F.lit("")), other)
    none = F.create_map().cast("map<string,string>")
    return raw.select(
        "query_id", some("rewritten_query", F.col("query")).alias("rewritten_query"), some("intent", F.lit("question")).alias("intent"),
        F.coalesce(j["entities"], none).alias("entities"),
    )


def evidence_context(cards: DataFrame) -> DataFrame:
    """(query_id, context): the cards of each query as text blocks in their order, a blank line between them.

    cards: query_id, citation_id, title, section_title, section_id, page_number, document_status, version_hash, retrieval_score,
    rerank_score, confidence, source_url, passage.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    page = F.coalesce(F.concat(F.lit("page "), F.col("page_number").cast("string")), F.lit("page unavailable"))
    # The lines of a block
    lines = F.concat_ws(
        "\n",
        F.concat("citation_id", F.lit(" "), "title"),
        F.concat(F.lit("Section: "), F.coalesce(some("section_title"), some("section_id"), F.lit("Unknown section")), F.lit("; "), page),
        F.concat(F.lit("Status: "), "document_status", F.lit("; version: "), "version_hash"),
        F.concat(*[x for name, c in (("Scores: retrieval=", "retrieval_score"), ("; rerank=", "rerank_score"), ("; confidence=", "confidence")) for x in (F.lit(name), four_decimals(F.col(c)))]),
        F.concat(F.lit("Source: "), "source_url"),
        F.concat(F.lit("Passage: "), "passage"),
    )
    part = F.struct(F.regexp_extract("citation_id", r"(\d+)", 1).cast("int").alias("n"), lines.alias("p"))
    d = cards.groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("x"))
    return d.select("query_id", F.array_join(F.col("x.p"), "\n\n").alias("context"))


def prompts(queries: DataFrame, contexts: DataFrame, template: str) -> DataFrame:
    """(query_id, prompt) of queries (query_id, query) and evidence_context, set into the template's {query} and {evidence}."""
    parts = [p for p in re.split(r"(\{query\}|\{evidence\})", template) if p]
    column = {"{query}": F.col("query"), "{evidence}": F.coalesce("context", F.lit(""))}
    j = queries.join(contexts.hint("merge"), "query_id", "left")
    return j.select("query_id", F.concat(*[column.get(p, F.lit(p)) for p in parts]).alias("prompt"))


def citation_line(title: Column, section: Column, page: Column, url: Column, citation_id: Column) -> Column:
    none = F.lit("N/A")
    return F.concat(
        citation_id, F.lit(" "), title, F.lit(" - "), F.coalesce(section, none), F.lit(" (page "), F.coalesce(page.cast("string"), none), F.lit(") - "), url
    )


def summary_text(summaries: DataFrame, title: str = "Summary") -> DataFrame:
    """(document_id, text) of summaries (document_id, summary_type, text, citations): a heading, the text, the citation lines."""
    head = F.concat(F.lit(f"{title}: "), "document_id", F.lit("\nType: "), "summary_type", F.lit("\n\n"), "text")
    tail = F.when(F.size("citations") > 0, F.concat(F.lit("\n\nCitations:\n"), F.array_join("citations", "\n"))).otherwise("")
    return summaries.select("document_id", F.concat(head, tail).alias("text"))


def summary_gate(requests: DataFrame, threshold: float = 0.5) -> DataFrame:
    """requests with reason: the first gate that a summary request fails, or null.

    Columns: summary_type, compare_version_hash, known (the document is), versions (newest first), cards, confidence, verdict,
    faithful.
    """
    compare = F.coalesce(F.col("compare_version_hash"), F.lit("")) != ""
    reason = (
        F.when(~F.coalesce("known", F.lit(False)), "not_found")
        .when(F.coalesce(F.size("versions"), F.lit(0)) < 1, "no_evidence")
        .when((F.col("summary_type") == "key_changes") & ~compare, "comparison_required")
        .when(compare & ~F.array_contains("versions", F.col("compare_version_hash")), "version_not_found")
        .when(F.coalesce(F.size("cards"), F.lit(0)) < 1, "no_evidence")
        .when(F.coalesce("confidence", F.lit(0.0)) < threshold, "low_confidence")
        .when(~F.col("verdict").eqNullSafe("bound"), "citation_binding_failure")
        .when(~F.coalesce("faithful", F.lit(False)), "faithfulness_failure")
    )
    return requests.withColumn("reason", reason)


def transcripts(turns: DataFrame, title: str = "Transcript") -> DataFrame:
    """(conv_id, n_turns, transcript) of turns (conv_id, turn, refused, text, citations): numbered, answered or refused."""
    state = F.when(F.coalesce("refused", F.lit(False)), "refused").otherwise("answered")
    lines = F.when(F.size("citations") > 0, F.concat(F.lit("\nCitations:\n"), F.array_join("citations", "\n"))).otherwise("")
    body = F.concat(F.lit(" ("), state, F.lit("):\n"), F.coalesce("text", F.lit("")), lines, F.lit("\n"))
    t = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", body.alias("body")))).alias("t"))
    numbered = F.transform("t", lambda x, i: F.concat(F.lit("Q"), (i + 1).cast("string"), x["body"]))
    return t.select("conv_id", "n_turns", F.concat(F.lit(f"{title}\n\n"), F.array_join(numbered, "\n")).alias("transcript"))


def exports(requests: DataFrame, summaries: DataFrame, sessions: DataFrame) -> DataFrame:
    """(export_id, object_key, text, status) of requests (export_id, summary_id, session_id): exactly one of the two is asked for.

    A request for both or neither is rejected; one whose source is missing, failed.
    """
    j = requests.join(summaries.select("summary_id", F.col("text").alias("_s")).hint("merge"), "summary_id", "left")
    j = j.join(sessions.select("session_id", F.col("text").alias("_t")).hint("merge"), "session_id", "left")
    one = F.col("summary_id").isNull() != F.col("session_id").isNull()
    text = F.when(one, F.coalesce("_s", "_t"))
    status = F.when(~one, "rejected").when(text.isNull(), "failed").otherwise("completed")
    key = F.when(text.isNotNull(), F.concat(F.lit("exports/"), F.col("export_id").cast("string"), F.lit(".txt")))
    return j.select("export_id", key.alias("object_key"), text.alias("text"), status.alias("status"))


def hidden(value):
    """A JSON value with the secret keys' values replaced, at any depth."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if k.lower() in SECRETS else hidden(v) for k, v in value.items()}
    return [hidden(v) for v in value] if isinstance(value, list) else value


def _redacted(payload: str | None) -> str | None:
    if payload is None:
        return None
    try:
        value = json.loads(payload)
    except ValueError:
        return '"[REDACTED]"'  # nobody can say what is in it
    return json.dumps(hidden(value), separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(StringType())
def redacted_json(payload: pd.Series) -> pd.Series:
    return payload.map(_redacted)


def redact(payload: Column) -> Column:
    """A JSON text with the values of secret keys replaced, in objects and lists at any depth; the key order stays.

    A text that is no JSON is replaced as a whole.
    """
    return redacted_json(payload)


def trace_steps(traces: DataFrame) -> DataFrame:
    """(run_id, step_no, node, status, duration_ms) of traces (run_id, steps array<struct<node, started_at, completed_at, status>>)."""
    rows = traces.select("run_id", F.posexplode("steps").alias("step_no", "s"))
    ms = (F.unix_millis("s.completed_at") - F.unix_millis("s.started_at")).alias("duration_ms")
    return rows.select("run_id", "step_no", "s.node", "s.status", ms)


def audit_rows(rows: DataFrame, kind: str, payload: Column, now: Column) -> DataFrame:
    """Audit events of rows (user_id, session_id, route): a fixed id, the redacted payload, the time."""
    text = F.to_json(payload)
    key = F.sha2(F.concat_ws("\x1f", F.lit(kind), F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.coalesce(F.col("session_id").cast("string"), F.lit("")), text), 256)
    return rows.select(key.alias("event_id"), F.lit(kind).alias("event_type"), "user_id", "session_id", "route", redact(text).alias("payload"), now.alias("created_at"))


def version_hashes(cards: DataFrame) -> DataFrame:
    """(query_id, hashes): the distinct versions an answer rests on, ascending."""
    return cards.groupBy("query_id").agg(F.array_sort(F.collect_set("version_hash")).alias("hashes"))


def audit_page(events: DataFrame, kind: str, limit: int = 50, offset: int = 0) -> DataFrame:
    return events.where(F.col("event_type") == kind).orderBy(F.col("ts").desc(), "event_id").offset(offset).limit(min(limit, 200))


def budget(requests: DataFrame, most: int, window_s: int, split: bool = False) -> DataFrame:
    """(user_id, event_id, ts) with accepted and retry_after; a refused request takes nothing from the budget.

    A user's requests are folded in time order, in a stream of sorted rows, so that no user is held whole. With split, a user's log is
    first cut wherever two requests are further apart than the window: budgets are empty there, so that the parts of one user
    are folded by many tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held = None, deque()
        for b in batches:
            ok, wait = [], []
            for u, part, t in zip(b["user_id"], b["part"], b["ts"], strict=True):
                if (u, part) != user:
                    user, held = (u, part), deque()
                now = t.timestamp()
                while held and held[0] < now - window_s:
                    held.popleft()
                ok.append(len(held) < most)
                wait.append(0 if ok[-1] else max(1, math.ceil(held[0] + window_s - now)))
                if ok[-1]:
                    held.append(now)
            yield pd.DataFrame({"user_id": b["user_id"], "event_id": b["event_id"], "ts": b["ts"], "accepted": ok, "retry_after": wait})

    rows = requests.select("user_id", "event_id", "ts", F.lit(0).cast("long").alias("part"))
    if split:
        order = ["ts", "event_id"]
        rows = previous(rows, "user_id", order, "ts", "_before")
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        begins = F.col("_before").isNull() | (micros("ts") - micros("_before") > window_s * 1_000_000)
        rows = running_max(rows.drop("part"), "user_id", order, F.when(begins, micros("ts")), "part").drop("_before")
    rows = rows.repartition("user_id", "part").sortWithinPartitions("user_id", "part", "ts", "event_id")
    return rows.select("user_id", "event_id", "ts", "part").mapInPandas(run, "user_id long, event_id long, ts timestamp, accepted boolean, retry_after long")


def extractive(cards: DataFrame) -> DataFrame:
    """(query_id, answer) from cards (query_id, citation_id, rank, text): the first long sentence of the first two."""
    s = F.split("text", r"(?<=[.!?])\s+")
    first = F.coalesce(F.get(F.filter(s, lambda x: F.length(x) >= 40), F.lit(0)), F.get(s, F.lit(0)))
    part = cards.where("rank <= 2").select("query_id", F.struct("rank", F.concat_ws(" ", first, "citation_id").alias("p")).alias("x"))
    return part.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("x"))["p"], " ").alias("answer"))


def latest_turn(turns: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def citation_rates(bound: DataFrame) -> DataFrame:
    """(coverage, validity) over answers of bind_citations: those with a marker, and markers that are cards."""
    used, valid = F.size("used"), F.size("used") - F.size("unknown")
    return bound.agg(
        F.round(F.avg((used > 0).cast("int")), 6).alias("coverage"), F.round(F.sum(valid) / F.greatest(F.sum(used), F.lit(1)), 6).alias("validity")
    )


def refusal_quality(answers: DataFrame) -> DataFrame:
    """(precision, recall) of refusals: answers (refused, should_refuse)."""
    both = F.count_if(F.col("refused") & F.col("should_refuse"))
    rate = lambda n: F.round(both / F.greatest(n, F.lit(1)), 6)
    return answers.agg(rate(F.count_if("refused")).alias("precision"), rate(F.count_if("should_refuse")).alias("recall"))
