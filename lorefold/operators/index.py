"""Chunk rows and keyword documents, their upsert, and the upkeep of both indexes for many documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefold.operators.retrieval import hash_vector
from lorefold.sources.tables import TableSet, discard, written


def with_metadata(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks (columns of document_chunks, and optionally slug, version_hash, source_url) beside their documents' metadata.

    documents: slug, title, version_hash, status, lifecycle_state, center, issuing_office, communication_type, topics, docket_number,
    issue_date, source_url; m_ stands before each. The chunk's own value comes first, then the document's.
    """
    m = documents.select([F.col(c).alias(f"m_{c}") for c in documents.columns])
    j = chunks.join(m.hint("merge"), F.col("slug") == F.col("m_slug"), "left")
    for c in ("version_hash", "source_url"):
        own = F.col(c) if c in chunks.columns else F.lit(None).cast("string")
        j = j.withColumn(c, F.coalesce(own, F.col(f"m_{c}")))
    return j


def rejected(rows: DataFrame) -> Column:
    """Why a row cannot be indexed, or null: it needs a slug and a version."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return F.when(blank("slug"), "document_slug").when(blank("version_hash"), "version_hash")


def evidence_payload(model: str) -> Column:
    """The 18 fields that an evidence card is made of, dates as ISO text."""
    return F.struct(
        "chunk_id", "slug", F.col("m_title").alias("doc_title"), "version_hash", F.col("m_status").alias("status"),
        F.coalesce("m_center", "m_issuing_office").alias("center"), F.col("m_communication_type").alias("comm_type"),
        F.coalesce("m_topics", F.array().cast("array<string>")).alias("topics"), F.col("m_docket_number").alias("docket_id"),
        F.date_format("m_issue_date", "yyyy-MM-dd").alias("issue_date"), "source_url", "section_id", "section_title",
        F.col("page_number").alias("page"), "char_start", "char_end", F.col("parent_chunk_id").alias("parent_id"), F.lit(model).alias("embedding_model"),
    )


def chunk_rows(rows: DataFrame, model: str = "feature-hash", dim: int = 64) -> DataFrame:
    """Rows of the dense index: every chunk of with_metadata, embedded if it is a child, with its evidence payload."""
    child = F.col("chunk_type") == "child"
    vector = F.when(child, hash_vector(F.when(child, F.col("text")), dim))  # a parent's text is not sent to the function
    return rows.where(rejected(rows).isNull()).select(
        "chunk_id", F.col("slug").alias("document_slug"), "version_hash", "chunk_type", "parent_chunk_id", "text", vector.alias("embedding"),
        F.lit(model).alias("embedding_model"), "source_url", "section_id", "section_title", "page_number", "char_start", "char_end",
        "token_count", evidence_payload(model).alias("evidence_payload"),
    )


def keyword_documents(rows: DataFrame, model: str = "feature-hash") -> DataFrame:
    """The 23 columns of the keyword index for children of with_metadata."""
    return rows.where(rejected(rows).isNull() & (F.col("chunk_type") == "child")).select(
        "chunk_id", "slug", F.col("m_title").alias("doc_title"), "version_hash", "chunk_type", F.col("parent_chunk_id").alias("parent_id"), "text",
        F.col("m_status").alias("status"), F.col("m_lifecycle_state").alias("lifecycle_state"), F.coalesce("m_center", "m_issuing_office").alias("center"),
        F.col("m_communication_type").alias("comm_type"), F.coalesce("m_topics", F.array().cast("array<string>")).alias("topics"),
        F.col("m_docket_number").alias("docket_id"), F.date_format("m_issue_date", "yyyy-MM-dd").alias("issue_date"), "source_url", "section_id",
        "section_title", F.col("page_number").alias("page"), "char_start", "char_end", "token_count", F.lit(model).alias("embedding_model"),
        evidence_payload(model).alias("evidence_payload"),
    )


def rejects(rows: DataFrame) -> DataFrame:
    """(chunk_id, slug, version_hash, reject) of the rows that cannot be indexed, by the first field that they lack."""
    return rows.select("chunk_id", "slug", "version_hash", rejected(rows).alias("reject")).where("reject IS NOT NULL")


def upsert(table: DataFrame, rows: DataFrame, key: str, now: Column, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """table with rows put in by key: the keep columns stay as they are in it, updated_at is now for what came."""
    fresh = rows.withColumns({"created_at": now, "updated_at": now})
    old = table.select(key, *[F.col(c).alias(f"_old_{c}") for c in keep])
    put = fresh.join(old.hint("merge"), key, "left").withColumns({c: F.coalesce(F.col(f"_old_{c}"), F.col(c)) for c in keep})
    rest = table.join(fresh.select(key).hint("merge"), key, "left_anti")
    return rest.unionByName(put.select(*table.columns))


def without_versions(table: DataFrame, versions: DataFrame, slug: str = "document_slug") -> DataFrame:
    """table less the rows of (slug, version_hash)."""
    v = versions.select(F.col("slug").alias(slug), "version_hash").distinct()
    return table.join(v.hint("merge"), [slug, "version_hash"], "left_anti")


def without(table: DataFrame, versions: DataFrame, documents: DataFrame, slug: str = "document_slug") -> DataFrame:
    """table less the rows of (slug, version_hash) and all rows of the documents (slug), in one join that doesn't sort the table's wide rows."""
    v = versions.select("slug", "version_hash", F.lit(False).alias("_all"))
    gone = v.unionByName(documents.select("slug", F.lit(None).cast("string").alias("version_hash"), F.lit(True).alias("_all"))).distinct()
    gone = gone.select(F.col("slug").alias("_slug"), F.col("version_hash").alias("_version"), "_all")
    return table.join(gone.hint("shuffle_hash"), (F.col(slug) == F.col("_slug")) & (F.col("_all") | (F.col("version_hash") == F.col("_version"))), "left_anti")


def without_documents(table: DataFrame, documents: DataFrame, slug: str = "document_slug") -> DataFrame:
    """table less all rows of the documents (slug)."""
    return table.join(documents.select(F.col("slug").alias(slug)).distinct().hint("merge"), slug, "left_anti")


def _counts(table: DataFrame, keys: list[str], name: str) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias(name))


def reindexed(dense: DataFrame, keyword: DataFrame, rows: DataFrame, changed: DataFrame, withdrawn: DataFrame, now: Column, parents: bool = False):
    """(dense, keyword, outcomes) once changed versions are replaced by rows and withdrawn documents are gone.

    dense and keyword: the indexes, columns of chunk_rows and keyword_documents; rows: with_metadata; changed: (slug, version_hash);
    withdrawn: (slug). outcomes: one row a document, with what was deleted and indexed on either side. With parents, parent chunks are kept
    in the dense table for diffs of texts; they are never counted.
    """
    new_dense, new_keyword = chunk_rows(rows if parents else rows.where("chunk_type = 'child'")), keyword_documents(rows)
    children = lambda t: t.where("chunk_type = 'child'").withColumnRenamed("document_slug", "slug")
    out = [
        without(dense, changed, withdrawn).unionByName(new_dense),
        without(keyword, changed, withdrawn, "slug").unionByName(new_keyword),
    ]
    of = changed.select("slug", "version_hash").distinct()
    sides = {"dense": (children(dense), children(new_dense)), "keyword": (keyword, new_keyword)}
    gone = withdrawn.select("slug").distinct()
    for side, (old, new) in sides.items():
        for name, table in ((f"{side}_deleted", old), (f"{side}_indexed", new)):
            of = of.join(_counts(table, ["slug", "version_hash"], name).hint("merge"), ["slug", "version_hash"], "left")
        gone = gone.join(_counts(old, ["slug"], f"{side}_deleted").hint("merge"), "slug", "left").withColumn(f"{side}_indexed", F.lit(0).cast("long"))
    outcomes = of.unionByName(gone.withColumn("version_hash", F.lit(None).cast("string"))).fillna(0).withColumn("synced_at", now)
    return *out, outcomes


def reindex_run(tables: TableSet, run_id: str, rows: DataFrame, changed: DataFrame, withdrawn: DataFrame, now: Column, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame] | None:
    """reindexed over stored tables dense, keyword and registry, all three put in place at once; (outcomes, rejects), or None if run_id is done.

    Only the buckets of changed and withdrawn documents are read and written. The registry's last_synced_at is set with them. A run
    that dies before its end leaves the tables as they were, and may be run again under its id. known: further rows (slug,
    version_hash) of the table known, which are added to it.
    """
    if run_id in tables.manifest()["runs"]:
        return None
    slugs = changed.select("slug").union(withdrawn.select("slug")).distinct()
    buckets = tables.touched(slugs)
    rows = written(rows, "rows")
    dense, keyword = (tables.read(n, buckets) for n in ("dense", "keyword"))
    new_dense, new_keyword, outcomes = reindexed(dense, keyword, rows, changed, withdrawn, now, parents=True)
    outcomes = written(outcomes, "outcomes")
    registry = mark_indexed(tables.read("registry", buckets), outcomes)
    refused = written(rejects(rows), "rejects")
    put = {"dense": new_dense, "keyword": new_keyword, "registry": registry}
    if known is not None:
        put["known"] = tables.read("known", buckets).unionByName(known)
    done = tables.commit(run_id, put, buckets)
    discard(rows)
    return (outcomes, refused) if done else None


def mark_indexed(registry: DataFrame, outcomes: DataFrame) -> DataFrame:
    """registry (slug, last_synced_at, ...) with the last outcome's time."""
    o = outcomes.groupBy("slug").agg(F.max("synced_at").alias("_synced"))
    j = registry.join(o.hint("merge"), "slug", "left")
    return j.withColumn("last_synced_at", F.coalesce("_synced", "last_synced_at")).select(*registry.columns)


def ensure_table(spark: SparkSession, path: str, schema: str) -> bool:
    """Makes an empty Parquet table if there is none; whether it did. Rows of other columns cannot be appended by append_strict."""
    try:
        spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return True
    return False


def append_strict(rows: DataFrame, path: str) -> None:
    """Appends rows to a table that has exactly their columns, by name."""
    columns = rows.sparkSession.read.parquet(path).columns
    if sorted(columns) != sorted(rows.columns):
        raise ValueError(f"columns differ: {sorted(set(columns) ^ set(rows.columns))}")
    rows.select(*columns).write.mode("append").parquet(path)
