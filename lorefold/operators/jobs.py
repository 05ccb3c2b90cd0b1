"""Whole jobs of the operators, and the rows that are kept of searches, turns, summaries and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.operators import catalog, index, retrieval
from lorefold.operators import registry as R
from lorefold.operators.documents import document_chunks
from lorefold.sources.tables import TableSet, discard, written


def daily_run(registry: DataFrame, raw: DataFrame, base: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registry, changes, rejects) of one day's raw feed: normalised, the last row of a slug, compared and put in.

    registry: slug, status, lifecycle_state, changed_at, first_seen_at, last_seen_at; raw: catalog.RAW columns and place, their order
    in the feed. Rows that are refused change nothing.
    """
    rows = catalog.normalized(raw, base).withColumn("place", F.get_json_object("raw_payload", "$.place").cast("long"))
    feed = R.last_wins(rows.where("reject IS NULL").select("slug", "status", "changed_at", "place"), "slug", "place")
    synced = R.sync(registry, feed.select("slug", "status", "changed_at"), now, previous=True)
    changes = synced.where("change_type IS NOT NULL").select("slug", "change_type", "previous_status", "status", "previous_changed_at", "changed_at")
    return synced.drop("previous_status", "previous_changed_at", "change_type"), changes, rows.where("reject IS NOT NULL").select("title", "reject")


#: Columns of the tables that a daily job keeps, beside dense and keyword.
REGISTRY = "slug string, status string, lifecycle_state string, changed_at timestamp, first_seen_at timestamp, last_seen_at timestamp, last_synced_at timestamp"
CHANGES = "slug string, change_type string, previous_status string, status string, previous_changed_at timestamp, changed_at timestamp, run_id string"


def job_tables(spark, root: str, buckets: int = 64) -> TableSet:
    """The tables of daily_job: registry, changes, dense and keyword."""
    none = spark.createDataFrame([], "doc_id string, text string")
    rows = index.with_metadata(document_chunks(none).withColumn("slug", F.col("doc_id")), _as_documents(catalog.normalized(spark.createDataFrame([], "title string"), "http://h/")))
    schemas = {"registry": REGISTRY, "changes": CHANGES, "dense": index.chunk_rows(rows).schema, "keyword": index.keyword_documents(rows).schema}
    return TableSet(spark, root, schemas, {"dense": "document_slug"}, buckets)


def _as_documents(rows: DataFrame) -> DataFrame:
    """Normalised rows under the names that index.with_metadata reads."""
    return rows.select(
        "slug", "title", F.lit(None).cast("string").alias("version_hash"), "status", "lifecycle_state", "center", F.lit(None).cast("string").alias("issuing_office"),
        "communication_type", "topics", F.col("docket_id").alias("docket_number"), "issue_date", F.col("landing_url").alias("source_url"),
    )


def daily_job(tables: TableSet, raw: DataFrame, contents: DataFrame, base: str, now: Column, run_id: str, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """(outcomes, rejects) of one day: the feed is synced with the registry, and the contents of what has changed are indexed.

    raw: catalog.RAW columns and place; contents: (slug, text) as fetched. New and updated documents that have a content are chunked, embedded and
    put in the place of the version they had; withdrawn ones are taken out; a change without a content has no outcome. outcomes: (slug, change_type,
    version_hash, what was deleted and indexed). The registry and the day's changes are put in place first, the indexes
    second, each at once; a job that dies goes on from there under its run id, and one that is done changes nothing.
    """
    spark = tables.spark
    rows = written(catalog.normalized(raw, base).withColumn("place", F.get_json_object("raw_payload", "$.place").cast("long")), "feed")
    feed = R.last_wins(rows.where("reject IS NULL"), "slug", "place")
    if f"{run_id}-registry" not in tables.manifest()["runs"]:
        old = tables.read("registry")
        synced = written(R.sync(old.drop("last_synced_at"), feed.select("slug", "status", "changed_at"), now, previous=True), "synced")
        times = old.select("slug", "last_synced_at")
        registry = synced.drop("previous_status", "previous_changed_at", "change_type").join(times.hint("merge"), "slug", "left")
        moved = synced.where("change_type IS NOT NULL").withColumn("run_id", F.lit(run_id))
        every = range(tables.buckets)
        tables.commit(f"{run_id}-registry", {"registry": registry, "changes": tables.read("changes").unionByName(moved.select(*tables.read("changes").columns))}, every)
        discard(synced)
    changes = tables.read("changes").where(F.col("run_id") == run_id)
    texts = contents.select("slug", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["slug"])
    fresh = written(texts.join(changes.where("change_type <> 'withdrawn'").select("slug").hint("merge"), "slug", "left_semi").withColumn("version_hash", F.sha2("text", 256)), "fresh")
    chunks = document_chunks(fresh.select(F.col("slug").alias("doc_id"), "text", "version_hash"), **sizes)
    chunks = chunks.withColumns({"slug": F.col("doc_id"), "version_hash": F.split_part("chunk_id", F.lit(":"), F.lit(-2))})
    done = index.reindex_run(tables, f"{run_id}-contents", index.with_metadata(chunks, _as_documents(feed)), fresh.select("slug", "version_hash"), changes.where("change_type = 'withdrawn'").select("slug"), now)
    refused = rows.where("reject IS NOT NULL").select("title", "reject")
    if done is None:
        shape = "slug string, change_type string, version_hash string, dense_deleted long, dense_indexed long, keyword_deleted long, keyword_indexed long"
        return spark.createDataFrame([], shape), refused
    outcomes = changes.select("slug", "change_type").join(done[0].hint("merge"), "slug")
    return outcomes.select("slug", "change_type", "version_hash", "dense_deleted", "dense_indexed", "keyword_deleted", "keyword_indexed"), refused


def stored_candidates(rows: DataFrame) -> DataFrame:
    """Candidates of stored rows (query_id, chunk_id, distance, payload and columns): score 1 - distance, gaps filled from the payload."""
    either = lambda c, *p: F.coalesce(F.col(c), *[F.col(f"payload.{x}") for x in (p or (c,))]).alias(c)
    return rows.select(
        "query_id", "chunk_id", F.round(1 - F.col("distance"), 6).alias("score"), either("slug"), either("version_hash"), either("source_url"),
        either("section_id"), either("page_number", "page"),
    )


def version_evidence(requests: DataFrame, chunks: DataFrame, k: int = 20, rerank_k: int = 10) -> DataFrame:
    """(query_id, doc_id, rank, rerank_score) within one version of one document each.

    requests: query_id, text, slug, version_hash; chunks: doc_id, slug, version_hash, text. The k best by words, reranked by overlap.
    """
    retrieval.check_k(k, rerank_k)
    version = F.when(F.col("slug").isNotNull() & F.col("version_hash").isNotNull(), F.to_json(F.struct("slug", "version_hash")))
    found = retrieval.bm25(requests, chunks, k, own=version)
    return retrieval.rerank(found, requests, chunks, rerank_k).select("query_id", "doc_id", "rank", "rerank_score")


def session_rows(requests: DataFrame, now: Column) -> DataFrame:
    """New sessions of requests (user_id, request_id, title): a fixed id, a title that isn't blank, both times now."""
    key = F.sha2(F.concat_ws("\x1f", F.lit("session"), F.col("user_id").cast("string"), F.col("request_id").cast("string")), 256)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("New session"))
    return requests.select(key.alias("session_id"), "user_id", title.alias("title"), now.alias("created_at"), now.alias("updated_at"))


def turn_records(answers: DataFrame) -> DataFrame:
    """What is kept of a turn: answers of final_answers with session_id, user_id and query; guardrails as a struct."""
    guard = F.struct("confidence", "refused", "refusal_reason", "n_evidence")
    kind = F.when(F.col("refused"), "answer_refused").otherwise("answer_completed")
    return answers.select("session_id", "user_id", "answer_id", "query", "text", guard.alias("guardrails"), kind.alias("audit_type"))


def summary_records(summaries: DataFrame) -> DataFrame:
    """What is kept of a summary: its text, evidence, pair of versions and guardrails, and the audit type.

    summaries: summary_id, user_id, document_id, summary_type, text, cards, versions, compare_version_hash, confidence, reason.
    """
    pair = F.struct(F.get("versions", F.lit(0)).alias("current"), F.col("compare_version_hash").alias("previous"))
    guard = F.struct("confidence", F.col("reason").alias("refusal_reason"), F.col("reason").isNull().alias("faithfulness_passed"))
    kind = F.when(F.col("reason").isNull(), "summary_completed").otherwise("summary_refused")
    evidence = F.when(F.col("reason").isNull(), F.col("cards")).otherwise(F.slice("cards", 1, 0))
    return summaries.select("summary_id", "user_id", "document_id", "summary_type", "text", evidence.alias("evidence"), pair.alias("versions"), guard.alias("guardrails"), kind.alias("audit_type"))
