"""Queries over stored indexes: postings with block maxima, vector cells, filtered hybrid search, tables that change together."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorefold.operators import answers as A
from lorefold.operators import index as I
from lorefold.operators import jobs as J
from lorefold.operators import lexical_index as X
from lorefold.operators import retrieval as R
from lorefold.operators import stored_search as S
from lorefold.operators import vector_index as V
from lorefold.plans import retrieval as P
from lorefold.plans import sessions
from lorefold.sources.tables import TableSet, shared_dir

_t, _queries = P._t, P._queries


def bm25_indexed(spark, d):
    """bm25_topk from the stored index."""
    index = X.build(_t(spark, d, "documents").select("doc_id", "text"))
    return X.search(index, _queries(spark, d), 10)[0]


def bm25_fields_indexed(spark, d):
    """bm25_multifield from the stored index: three fields, rows of one language allowed."""
    docs = _t(spark, d, "documents")
    fields = docs.select("doc_id", "text", F.substring_index("text", "\n", 1).alias("doc_title"), F.col("source").alias("section_title"))
    index = X.build(fields, tuple(R.BOOSTS))
    return X.search(index, _queries(spark, d), 10, R.BOOSTS, docs.where("lang = 'en'").select("doc_id"))[0]


def stored_terms(spark, d):
    """The stored words with their number of documents and greatest impact, and what their blocks hold in all."""
    index = X.build(_t(spark, d, "documents").select("doc_id", "text"))
    held = index.blocks.groupBy("term").agg(F.sum("size").alias("n_postings"))
    rows = index.terms.join(held.hint("merge"), "term")
    return rows.select("term", "df", "n_postings", F.round("top", 6).alias("top"))


def dense_indexed(spark, d):
    """dense_topk from the cells."""
    index = V.build(_t(spark, d, "embeddings").select("vec_id", "embedding"))
    return V.search(index, P._vector_queries(spark, d), 10)[0]


def _registry(spark, d):
    """One row a document: languages and sources are what filters ask for; a document in nine is withdrawn."""
    k = F.col("doc_id")
    return _t(spark, d, "documents").select(
        k.cast("string").alias("slug"), F.when(k % 9 == 0, "withdrawn").otherwise("active").alias("lifecycle_state"), F.when(F.col("n_chars") % 2 == 0, "Draft").otherwise("Final").alias("status"),
        F.array(F.coalesce("lang", F.lit("-")), F.when(F.col("n_chars") > 800, "long").otherwise("short")).alias("topics"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 365).cast("int")).alias("issue_date"),
    )


FILTERS = {"status": "Final", "topics": ["en", "long"], "issue_date_from": "2024-02-01", "issue_date_to": "2024-11-30"}


def filtered_hybrid(spark, d):
    """Hybrid search under four filters: documents of one status, issued within a range, with all topics (dense) or any (keyword)."""
    docs = P._plain(spark, d).withColumn("slug", F.col("doc_id").cast("string"))
    lexical = X.build(docs.select("doc_id", "text"))
    vectors = V.build(docs.select(F.col("doc_id").alias("vec_id"), R.hash_vector(F.col("text"), 64).alias("embedding")))
    results, _ = S.filtered_search(_queries(spark, d), docs, _registry(spark, d), lexical, vectors, FILTERS)
    return results.select("query_id", "doc_id", "rank", "dense_score", "keyword_score", "rrf_score", "rerank_score")


def _rows(spark, d, version: str, where: str):
    """Lines as children of their text, with metadata: the chunks of a version."""
    k = F.col("doc_id")
    meta = _t(spark, d, "documents").where(where).select(
        k.cast("string").alias("slug"), F.coalesce("source", F.lit("none")).alias("title"), F.lit(version).alias("version_hash"), F.lit("Final").alias("status"), F.lit("active").alias("lifecycle_state"), F.col("lang").alias("center"),
        F.lit("office").alias("issuing_office"), F.lit("guide").alias("communication_type"), F.array(F.coalesce("lang", F.lit("-"))).alias("topics"), F.lit("D-1").alias("docket_number"), F.lit("2024-05-06").cast("date").alias("issue_date"),
        F.concat(F.lit("http://h/"), k.cast("string")).alias("source_url"),
    )
    docs = _t(spark, d, "documents").where(where).select("doc_id", k.cast("string").alias("slug"), F.coalesce("text", F.lit("")).alias("text"))
    # metadata meets whole documents, one row each; of a document's rows number 0 is its text, the others are its lines
    docs = I.with_metadata(docs.withColumn("version_hash", F.lit(version)), meta)
    held = [c for c in docs.columns if c not in ("text", "version_hash", "source_url")]
    rows = docs.select(*held, "version_hash", "source_url", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("n", "text")).where("n = 0 OR trim(text) <> ''")
    name, whole = F.concat("slug", F.lit(f":{version}:")), F.col("n") == 0
    return rows.withColumns({
        "chunk_id": F.concat(name, F.when(whole, "p").otherwise((F.col("n") - 1).cast("string"))), "chunk_type": F.when(whole, "parent").otherwise("child"), "parent_chunk_id": F.when(~whole, F.concat(name, F.lit("p"))),
        "section_id": F.lit("document"), "section_title": F.lit("Document"), "page_number": F.lit(1), "char_start": F.lit(0).cast("long"), "char_end": F.length("text").cast("long"), "token_count": F.size(F.split(F.trim("text"), r"\s+")),
    }).drop("n")


def atomic_reindex(spark, d):
    """A first run over all documents, a second one of changed and withdrawn documents, and the second again: what the tables hold then."""
    every = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), "n_chars", "doc_id")
    first = _rows(spark, d, "v1", "true")
    at = lambda day: F.lit(f"2025-01-0{day}").cast("timestamp")
    known = every.select("slug", F.lit(None).cast("timestamp").alias("last_synced_at"))
    schemas = {"dense": I.chunk_rows(first).schema, "keyword": I.keyword_documents(first).schema, "registry": known.schema}
    tables = TableSet(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", schemas, {"dense": "document_slug"}, buckets=16)
    tables.commit("registry", {"registry": known}, range(16))
    none = every.where("false").select("slug")
    I.reindex_run(tables, "day-1", first, every.select("slug", F.lit("v1").alias("version_hash")), none, at(1))
    moved = "n_chars % 4 = 0 AND doc_id % 9 <> 0"
    for _ in range(2):  # the second time changes nothing
        I.reindex_run(tables, "day-2", _rows(spark, d, "v2", moved), every.where(moved).select("slug", F.lit("v2").alias("version_hash")), every.where("doc_id % 9 = 0").select("slug"), at(2))
    n = lambda c: F.count_if(c)
    dense = tables.read("dense").groupBy(F.col("document_slug").alias("slug"), "version_hash").agg(n(F.col("embedding").isNotNull()).alias("n_dense"), n(F.col("chunk_type") == "parent").alias("n_parents"))
    keyword = tables.read("keyword").groupBy("slug", "version_hash").agg(F.count("*").alias("n_keyword"), F.sum("token_count").alias("n_tokens"))
    j = dense.join(keyword.hint("merge"), ["slug", "version_hash"], "left").join(tables.read("registry").hint("merge"), "slug")
    return j.select("slug", "version_hash", "n_dense", "n_parents", F.coalesce("n_keyword", F.lit(0)).alias("n_keyword"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.date_format("last_synced_at", "yyyy-MM-dd").alias("synced_on"))


def daily_contents(spark, d):
    """Two days of a feed: all documents, then a feed without a ninth of them, with other statuses and some new texts; the second day twice.

    A document's text is its page's title line; the outcomes of the second day.
    """
    k = F.col("doc_id")
    docs = _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("none")).alias("source"), "n_chars")
    link = F.concat(F.lit('<a href="/docs/'), k.cast("string"), F.lit('">'), F.col("source"), F.lit("</a>"))
    feed = lambda rows, status: rows.select(link.alias("title"), status.alias("field_final_guidance_1"), F.lit("2024-01-02T00:00:00Z").alias("changed"), k.alias("place"))
    texts = lambda rows, more: rows.select(k.cast("string").alias("slug"), F.concat(F.regexp_replace("text", "\n", "\n\n"), more).alias("text"))
    tables = J.job_tables(spark, f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}", 16)
    at = lambda day: F.lit(f"2025-01-0{day}").cast("timestamp")
    size = {"parent": 1_000_000, "child": 1_000_000, "overlap": 0}
    J.daily_job(tables, feed(docs, F.lit("Draft")), texts(docs, F.lit("")), "https://x.org/base", at(1), "day-1", **size)
    later = docs.where("doc_id % 9 <> 0")
    second = feed(later, F.when(F.col("n_chars") % 3 == 0, "Final").otherwise("Draft"))
    new = texts(later.where("n_chars % 2 = 0"), F.lit("\n\nAdded at the end."))
    outcomes, _ = J.daily_job(tables, second, new, "https://x.org/base", at(2), "day-2", **size)
    again, _ = J.daily_job(tables, second, new, "https://x.org/base", at(3), "day-2", **size)
    return outcomes.union(again).select("slug", "change_type", (F.col("version_hash").isNotNull()).alias("has_version"), "dense_deleted", "dense_indexed", "keyword_indexed")


def rate_limit_split(spark, d):
    """rate_limit_replay with each user's log cut at the gaps: budgets of minutes over days of events."""
    return A.budget(_t(spark, d, "events"), 3, 86_400, split=True)


QUERIES = {f.__name__: f for f in (bm25_indexed, bm25_fields_indexed, stored_terms, dense_indexed, filtered_hybrid, atomic_reindex, daily_contents, rate_limit_split)}

_REG = """reg AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'withdrawn' ELSE 'active' END AS state, CASE WHEN n_chars % 2 = 0 THEN 'Draft' ELSE 'Final' END AS status,
    [coalesce(lang, '-'), CASE WHEN n_chars > 800 THEN 'long' ELSE 'short' END] AS topics, DATE '2024-01-01' + (n_chars % 365)::INT AS issued FROM documents),
  ok AS (SELECT doc_id, list_has_all(topics, ['en', 'long']) AS has_all, list_has_any(topics, ['en', 'long']) AS has_any FROM reg WHERE state = 'active' AND status = 'Final' AND issued BETWEEN DATE '2024-02-01' AND DATE '2024-11-30')"""
_FILTERED = (
    "WITH " + _REG + ", d_t AS (SELECT doc_id AS id, text AS t FROM documents SEMI JOIN (SELECT doc_id FROM ok WHERE has_all) USING (doc_id)), q_t AS (SELECT item_id AS id, text AS t FROM benchmark), "
    + P._HASHED.format(n="d") + "," + P._HASHED.format(n="q")
    + """, a AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM (
    SELECT q_v.id AS query_id, d_v.id AS doc_id, round(list_cosine_similarity(d_v.e, q_v.e), 6) AS score FROM d_v, q_v)) WHERE rank <= 20),"""
    + P._bm25("b", "text", 20)
    + """,
  c AS (SELECT * FROM (SELECT b_s.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM b_s SEMI JOIN (SELECT doc_id FROM ok WHERE has_any) USING (doc_id)) WHERE rank <= 20),
  u AS (SELECT query_id, doc_id, max(ds) AS dense_score, max(ks) AS keyword_score, max(dr) AS dense_rank, max(kr) AS keyword_rank FROM (
    SELECT query_id, doc_id, score AS ds, NULL::DOUBLE AS ks, rank AS dr, NULL::INT AS kr FROM a UNION ALL SELECT query_id, doc_id, NULL, score, NULL, rank FROM c) GROUP BY query_id, doc_id),
  v AS (SELECT *, round(coalesce(1::DOUBLE / (60 + dense_rank), 0) + coalesce(1::DOUBLE / (60 + keyword_rank), 0), 9) AS rrf_score FROM u),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, least(dense_rank, keyword_rank), doc_id) AS k FROM v) WHERE k <= 10),
  q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark),
  o AS (SELECT f.*, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))) / len(q) END, 6)::DOUBLE AS rerank_score FROM f JOIN q USING (query_id) JOIN documents USING (doc_id))
  SELECT query_id, doc_id, rank, dense_score, keyword_score, rrf_score, rerank_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS INT) AS rank FROM o) WHERE rank <= 5"""
)

ORACLES = {
    "rate_limit_split": sessions.ORACLES["rate_limit_replay"],
    "daily_contents": """WITH l AS (SELECT doc_id, n_chars, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS BIGINT) AS n FROM documents)
      SELECT CAST(doc_id AS VARCHAR) AS slug, 'withdrawn' AS change_type, false AS has_version, n AS dense_deleted, 0::BIGINT AS dense_indexed, 0::BIGINT AS keyword_indexed FROM l WHERE doc_id % 9 = 0
      UNION ALL SELECT CAST(doc_id AS VARCHAR), 'updated', true, 0, n + 1, n + 1 FROM l WHERE doc_id % 9 <> 0 AND n_chars % 6 = 0""",
    "bm25_indexed": P.ORACLES["bm25_topk"],
    "bm25_fields_indexed": P.ORACLES["bm25_multifield"],
    "dense_indexed": P.ORACLES["dense_topk"],
    "filtered_hybrid": _FILTERED,
    "stored_terms": "WITH " + P._bm25("b", "text", 1) + """ SELECT term, count(*) AS df, count(*) AS n_postings, round(max(tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS top FROM b_tf JOIN b_l USING (doc_id), b_f GROUP BY term""",
    "atomic_reindex": r"""WITH l AS (SELECT doc_id, n_chars, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents WHERE doc_id % 9 <> 0),
      s AS (SELECT *, CAST(coalesce(list_sum(list_transform(l, lambda x: len(string_split_regex(trim(x, ' '), '\s+')))), 0) AS BIGINT) AS t FROM l),
      v AS (SELECT *, 'v1' AS version_hash FROM s UNION ALL SELECT *, 'v2' FROM s WHERE n_chars % 4 = 0)
      SELECT CAST(doc_id AS VARCHAR) AS slug, version_hash, len(l) AS n_dense, 1::BIGINT AS n_parents, len(l) AS n_keyword, t AS n_tokens, CASE WHEN n_chars % 4 = 0 THEN '2025-01-02' ELSE '2025-01-01' END AS synced_on FROM v""",
}
