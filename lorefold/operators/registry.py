"""Registry of documents: diff, upsert, versions, alerts, reports and reconciliation."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefold.functions import fingerprint, shown_status, status_of, utc_text
from lorefold.operators.answers import audit_rows
from lorefold.operators.asof import previous
from lorefold.operators.pieces import rows_to_rows


def last_wins(feed: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order."""
    rest = [c for c in feed.columns if c != key]
    one = feed.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return one.select(key, "r.*")


def updated(old_state, old_status, new_status, old_ts, new_ts) -> Column:
    """Whether a known row counts as updated, rules in order."""
    return (
        F.when(old_state == "withdrawn", True)
        .when(~old_status.eqNullSafe(new_status), True)
        .when(old_ts.isNull(), new_ts.isNotNull())
        .when(new_ts.isNull(), False)
        .otherwise(new_ts > old_ts)
    )


def sync(registry: DataFrame, feed: DataFrame, now: Column, previous: bool = False) -> DataFrame:
    """One full join of registry and feed (slug, status, changed_at): the new registry with each row's change_type.

    Registry columns: slug, status, lifecycle_state, changed_at, first_seen_at, last_seen_at. With previous, the old status and
    time stand beside the new ones.
    """
    old = [F.col("o_status").alias("previous_status"), F.col("o_changed_at").alias("previous_changed_at")] if previous else []
    o = registry.select([F.col(c).alias(f"o_{c}") for c in registry.columns]).withColumn("o_here", F.lit(True))
    n = feed.select([F.col(c).alias(f"n_{c}") for c in feed.columns]).withColumn("n_here", F.lit(True))
    j = o.join(n.hint("merge"), F.col("o_slug") == F.col("n_slug"), "full_outer")
    both = F.col("o_here") & F.col("n_here")
    gone = F.col("o_here") & F.col("n_here").isNull()
    change = (
        F.when(F.col("o_here").isNull(), "new")
        .when(both & updated(F.col("o_lifecycle_state"), F.col("o_status"), F.col("n_status"), F.col("o_changed_at"), F.col("n_changed_at")), "updated")
        .when(gone & (F.col("o_lifecycle_state") != "withdrawn"), "withdrawn")
    )
    seen = F.col("n_here") | (gone & (F.col("o_lifecycle_state") != "withdrawn"))
    return j.select(
        F.coalesce("n_slug", "o_slug").alias("slug"),
        F.when(F.col("n_here"), F.col("n_status")).otherwise(F.col("o_status")).alias("status"),
        F.when(F.col("n_here"), "active").otherwise("withdrawn").alias("lifecycle_state"),
        F.when(F.col("n_here"), F.col("n_changed_at")).otherwise(F.col("o_changed_at")).alias("changed_at"),
        F.coalesce(F.col("o_first_seen_at"), now).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("o_last_seen_at")).alias("last_seen_at"),
        change.alias("change_type"),
        *old,
    )


def version_events(versions: DataFrame) -> DataFrame:
    """(slug, created, no, event) of versions (slug, created, hash, status, lifecycle, and optionally docket), in the fixed order of kinds.

    Statuses are compared as they are, a null one included; a change needs a previous value. What a version supersedes is as in
    version_snapshots.
    """
    v = versions if "docket" in versions.columns else versions.withColumn("docket", F.lit(None).cast("string"))
    v = _with_superseded(v)
    v = previous(v.withColumn("_now", F.struct("status", "lifecycle")), "slug", ["created"], "_now", "_p")
    moved = lambda c: F.col(f"_p.{c}").isNotNull() & ~F.col(f"_p.{c}").eqNullSafe(F.col(c))
    kinds = F.array(
        F.when(F.col("_own").isNull() | (F.col("_own") != F.col("hash")), "new_version"),
        F.when(moved("status"), "status_changed"),
        F.when(moved("lifecycle"), "lifecycle_changed"),
        F.when(F.col("supersedes").isNotNull(), "supersedes_version"),
    )
    return v.select("slug", "created", F.posexplode(F.filter(kinds, F.isnotnull)).alias("no", "event"))


def change_report(changes: DataFrame) -> DataFrame:
    kind = F.col("change_type")
    return changes.agg(
        F.count(kind).alias("total"),
        *[F.count_if(kind == k).alias(f"n_{k}") for k in ("new", "updated", "withdrawn")],
    )


def alerts(changes: DataFrame, titles: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """(event_fingerprint, slug, title, change_type) once for each fingerprint; a missing title is the slug.

    changes: rows of sync with previous; versions: (slug, version_hash). The fingerprint is of the change type, the slug, the
    statuses and times before and after, and the current version.
    """
    a = changes.where("change_type IS NOT NULL").join(titles.hint("merge"), "slug", "left")
    a = a.join(versions.select("slug", "version_hash").hint("merge"), "slug", "left") if versions is not None else a.withColumn("version_hash", F.lit(None).cast("string"))
    print_ = fingerprint(F.col("change_type"), F.col("slug"), F.col("previous_status"), F.col("status"), F.col("version_hash"), utc_text(F.col("previous_changed_at")), utc_text(F.col("changed_at")))
    a = a.select(print_.alias("event_fingerprint"), "slug", F.coalesce("title", "slug").alias("title"), "change_type")
    return a.dropDuplicates(["event_fingerprint"])


def alerts_page(table: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Alerts (alert_id, detected_at, status, ...), newest first, ties by id: a page of a report."""
    rows = table if status is None else table.where(F.col("status") == status)
    return rows.orderBy(F.col("detected_at").desc(), "alert_id").offset(offset).limit(limit)


def with_documents(rows: DataFrame, registry: DataFrame, other: str = "withdrawn-document") -> DataFrame:
    """rows (slug) with document: the slug if the registry has it, else a stand-in."""
    known = registry.select("slug", F.lit(True).alias("_known")).distinct()
    return rows.join(known.hint("merge"), "slug", "left").withColumn("document", F.when(F.col("_known"), F.col("slug")).otherwise(other)).drop("_known")


def nested_report(changes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row a change type with its number and the changes themselves, by slug, beside what was indexed of each.

    changes: (slug, change_type, previous_status, status); outcomes: (slug, dense_indexed, keyword_indexed). To be written as JSON.
    """
    j = changes.join(outcomes.hint("merge"), "slug", "left")
    row = F.struct("slug", "previous_status", "status", "dense_indexed", "keyword_indexed")
    return j.groupBy("change_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(row)).alias("changes"))


def backfill_summary(changes: DataFrame) -> DataFrame:
    """(record_count, change_count, n_new, n_updated, n_withdrawn) of rows of sync: records are those of the feed."""
    kind = F.col("change_type")
    return changes.agg(
        F.count_if(F.col("lifecycle_state") == "active").alias("record_count"),
        F.count(kind).alias("change_count"),
        *[F.count_if(kind == k).alias(f"n_{k}") for k in ("new", "updated", "withdrawn")],
    )


def reconciled(registry: DataFrame, dense: DataFrame, keyword: DataFrame | None = None) -> DataFrame:
    """(active, dense, keyword, agrees): documents of the registry and of each index (document_slug or slug); keyword may be missing."""
    one = registry.agg(F.count_if(F.col("lifecycle_state") == "active").alias("active"))
    one = one.crossJoin(dense.agg(F.countDistinct("document_slug").alias("dense")))
    third = keyword.agg(F.countDistinct("slug").alias("keyword")) if keyword is not None else None
    one = one.crossJoin(third) if third is not None else one.withColumn("keyword", F.lit(None).cast("long"))
    return one.withColumn("agrees", (F.col("active") == F.col("dense")) & (F.col("keyword").isNull() | (F.col("keyword") == F.col("active"))))


def _with_superseded(versions: DataFrame) -> DataFrame:
    """versions with _own, the slug's previous hash, and supersedes: that hash if it differs, else the docket's latest earlier one of another slug, if it differs."""
    v = previous(versions, "slug", ["created"], "hash", "_own")
    v = previous(v, "docket", ["created", "slug"], "hash", "_other", other="slug")
    differs = lambda c: F.when(F.col(c) != F.col("hash"), F.col(c))
    return v.withColumn("supersedes", F.coalesce(differs("_own"), differs("_other")))


def stored_sketches(rows: DataFrame, batch: Column, key: str = "slug", log_k: int = 14) -> DataFrame:
    """(batch, sketch, n_rows): a HyperLogLog sketch of the distinct keys of each batch, to be stored; some kB whatever the batch."""
    return rows.groupBy(batch.alias("batch")).agg(F.hll_sketch_agg(key, F.lit(log_k)).alias("sketch"), F.count("*").alias("n_rows"))


def merged_estimate(sketches: DataFrame) -> DataFrame:
    """(n_batches, n_rows, n_distinct) of stored sketches: they are merged, no row is read again. With log_k 14 the standard error is 0.8 %."""
    one = sketches.agg(F.count("*").alias("n_batches"), F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
    return one.select("n_batches", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def reconciled_by_sketch(registry: DataFrame, dense: DataFrame, keyword: DataFrame | None = None, error: float = 0.03) -> DataFrame:
    """(active, dense, keyword, agrees): reconciled from stored sketches of each index; counts agree within the error, about four standard errors."""
    one = registry.agg(F.count_if(F.col("lifecycle_state") == "active").alias("active")).crossJoin(merged_estimate(dense).select(F.col("n_distinct").alias("dense")))
    one = one.crossJoin(merged_estimate(keyword).select(F.col("n_distinct").alias("keyword"))) if keyword is not None else one.withColumn("keyword", F.lit(None).cast("long"))
    near = lambda c: F.abs(F.col(c) - F.col("active")) <= F.greatest(error * F.col("active"), F.lit(0.5))
    return one.withColumn("agrees", near("dense") & (F.col("keyword").isNull() | near("keyword")))


def version_snapshots(versions: DataFrame) -> DataFrame:
    """(slug, created, hash, document_status, supersedes, unchanged) of versions (slug, docket, created, hash, status).

    A version supersedes the slug's previous one if its hash is another. If it is the slug's first, or unchanged, it supersedes
    the latest earlier version of its docket of another slug, if its hash is another. Neither a hot slug nor a hot docket is one task.
    """
    v = _with_superseded(versions)
    return v.select(
        "slug", "created", "hash", status_of(F.col("status")).alias("document_status"), "supersedes",
        F.coalesce(F.col("_own") == F.col("hash"), F.lit(False)).alias("unchanged"),
    )


def text_diff(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(slug, line_no, line): unified diffs, three lines of context, of the parent chunks of two versions of each document.

    chunks: (slug, version_hash, chunk_type, chunk_no, text); pairs: (slug, previous, current).
    """
    parts = chunks.where("chunk_type = 'parent'").groupBy("slug", "version_hash")
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("chunk_no", "text")))["text"].alias("t"))
    side = lambda name: parts.select("slug", F.col("version_hash").alias(name), F.col("t").alias(f"{name}_t")).hint("merge")
    j = pairs.join(side("previous"), ["slug", "previous"], "left").join(side("current"), ["slug", "current"], "left")

    def diff(slug, p, c, a, z):
        lines = difflib.unified_diff(a or [], z or [], f"{slug}@{p[:12]}", f"{slug}@{c[:12]}", lineterm="")
        return ((slug, k, line) for k, line in enumerate(lines))

    return rows_to_rows(j.select("slug", "previous", "current", "previous_t", "current_t"), diff, "slug string, line_no int, line string")


def document_views(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(slug, versions newest first, current, section_ids in order) of versions (slug, hash, created) and chunks (slug, version_hash, chunk_no, section_id)."""
    one = versions.groupBy("slug", "hash").agg(F.max("created").alias("at"))
    v = one.groupBy("slug").agg(F.reverse(F.array_sort(F.collect_list(F.struct("at", "hash")))).alias("v"))
    v = v.select("slug", F.col("v.hash").alias("versions"), F.get(F.col("v.hash"), F.lit(0)).alias("current"))
    c = chunks.join(v.select("slug", F.col("current").alias("version_hash")).hint("merge"), ["slug", "version_hash"], "left_semi")
    s = c.groupBy("slug").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("chunk_no", "section_id")))["section_id"]).alias("section_ids"))
    return v.join(s.hint("merge"), "slug", "left")


def document_pages(registry: DataFrame, artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a document's page shows: (slug, title, status, versions newest first, artifacts, section_ids) of every document of the registry.

    registry: slug, title, status, lifecycle_state; artifacts: slug, version_hash, artifact_kind, created_at, which also tell the versions; chunks: slug, version_hash,
    chunk_no, section_id, of which the current version's sections are shown in order. A document without artifacts has empty lists.
    """
    made = artifacts.select("slug", F.col("version_hash").alias("hash"), F.col("created_at").alias("created"))
    views = document_views(made, chunks).select("slug", "versions", "section_ids")
    row = F.struct(F.col("created_at"), F.col("version_hash"), F.col("artifact_kind"))
    files = artifacts.groupBy("slug").agg(F.transform(F.reverse(F.array_sort(F.collect_list(row))), lambda x: F.struct(x["version_hash"].alias("version_hash"), x["artifact_kind"].alias("artifact_kind"))).alias("artifacts"))
    j = registry.join(views.hint("merge"), "slug", "left").join(files.hint("merge"), "slug", "left")
    none = F.array().cast("array<string>")
    return j.select(
        "slug", F.coalesce("title", "slug").alias("title"), shown_status(F.col("lifecycle_state"), F.col("status")).alias("status"), F.coalesce("versions", none).alias("versions"),
        F.coalesce("artifacts", F.array().cast("array<struct<version_hash:string,artifact_kind:string>>")).alias("artifacts"), F.coalesce("section_ids", none).alias("section_ids"),
    )


def alert_list(table: DataFrame, registry: DataFrame, user_id: str, now: Column, status: str | None = None, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, audit): alerts_page with each alert's document, and the audit row of who has looked at it."""
    page = with_documents(alerts_page(table, status, limit, offset), registry).orderBy(F.col("detected_at").desc(), "alert_id")
    who = table.sparkSession.range(1).select(F.lit(user_id).alias("user_id"), F.lit(None).cast("string").alias("session_id"), F.lit("alerts").alias("route"))
    payload = F.struct(F.lit(status).alias("status"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset"))
    return page, audit_rows(who, "alerts_listed", payload, now)


def section_navigation(chunks: DataFrame) -> DataFrame:
    """(doc_id, section_id, chunk_no, section_title, page_number): each section's first chunk, in the order of chunks."""
    first = F.min(F.struct("chunk_no", "section_title", "page_number")).alias("f")
    return chunks.where("section_id IS NOT NULL").groupBy("doc_id", "section_id").agg(first).select("doc_id", "section_id", "f.*")


def passages(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """requests (doc_id, chunk_id) with the passage, where the chunk is the document's and has a source."""
    c = chunks.where(F.coalesce("source_url", F.lit("")) != "").select("doc_id", "chunk_id", "text", "page_number", "source_url")
    return requests.join(c.hint("merge"), ["doc_id", "chunk_id"])


def freshness(registry: DataFrame, now: Column) -> DataFrame:
    """(last_synced_at, age_hours) of a registry."""
    last = registry.agg(F.max("last_synced_at").alias("last_synced_at"))
    hours = (F.unix_seconds(now) - F.unix_seconds("last_synced_at")) / 3600
    return last.select("last_synced_at", F.round(hours, 6).alias("age_hours"))


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Of rows those whose key the table lacks."""
    return rows.join(table.select(key).hint("merge"), key, "left_anti")


def transitions(requests: DataFrame, stamps: bool = False) -> DataFrame:
    """Final state and number of refused requests of each alert: requests (alert_id, at, to) folded in time order.

    open may become acknowledged or resolved, acknowledged may become resolved; the same state again is no change. With stamps,
    also who acknowledged it (user_id) and when, and when it was resolved.
    """
    level = F.when(F.col("to") == "open", 0).when(F.col("to") == "acknowledged", 1).otherwise(2)
    r = requests.withColumn("level", level)
    before = Window.partitionBy("alert_id").orderBy("at", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("state", F.coalesce(F.max("level").over(before), F.lit(0)))
    end = F.element_at(F.array(*map(F.lit, ("open", "acknowledged", "resolved"))), F.max(F.greatest("level", "state")) + 1)
    more = []
    if stamps:
        moved = lambda to: (F.col("level") == to) & (F.col("state") < to)
        more = [
            F.min(F.when(moved(1), F.col("at"))).alias("acknowledged_at"),
            F.min_by(F.when(moved(1), F.col("user_id")), F.when(moved(1), F.col("at"))).alias("acknowledged_by"),
            F.min(F.when(moved(2), F.col("at"))).alias("resolved_at"),
        ]
    return r.groupBy("alert_id").agg(end.alias("state"), F.count_if(F.col("level") < F.col("state")).alias("refused"), *more)
