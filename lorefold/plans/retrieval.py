"""Queries on retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefold.functions import all_of, any_of
from lorefold.operators import answers as A
from lorefold.operators import filters as C
from lorefold.operators import jobs as J
from lorefold.operators import retrieval as R


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _queries(spark, d):
    """Benchmark items as the stated query set."""
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def feature_hash_vectors(spark, d):
    return R.feature_hash(_t(spark, d, "documents"))


def _vector_queries(spark, d):
    return _t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_topk(spark, d):
    return R.dense_search(_vector_queries(spark, d), _t(spark, d, "embeddings"), 10)


def dense_topk_filtered(spark, d):
    return R.dense_search(_vector_queries(spark, d), _t(spark, d, "embeddings").where("label = 1"), 5)


def bm25_topk(spark, d):
    return R.bm25(_queries(spark, d), _t(spark, d, "documents").select("doc_id", "text"), 10)


def bm25_multifield(spark, d):
    """Three fields of the documents of one language: text, first line, source."""
    docs = _t(spark, d, "documents").select(
        "doc_id", "text", F.substring_index("text", "\n", 1).alias("doc_title"), F.col("source").alias("section_title"), "lang"
    )
    return R.bm25_fields(_queries(spark, d), docs, 10, where=F.col("lang") == "en")


def _plain(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text")


def rrf_fusion(spark, d):
    queries, docs = _queries(spark, d), _plain(spark, d)
    return R.fuse(R.hash_search(queries, docs, 20), R.bm25(queries, docs, 20), 10)


def _hybrid(spark, d):
    dense, keyword = (lambda q, t: R.hash_search(q, t, 20)), (lambda q, t: R.bm25(q, t, 20))
    return R.hybrid(_queries(spark, d), _plain(spark, d), dense, keyword, top_k=10)


def hybrid_search(spark, d):
    """Dense and lexical rankings fused, reranked by word overlap, as evidence cards."""
    return R.evidence_cards(_hybrid(spark, d)[0], _t(spark, d, "documents"))


def hybrid_status(spark, d):
    """What each side gave for each query."""
    return _hybrid(spark, d)[1]


def fallback_rank(spark, d):
    """The order without a reranker."""
    return R.fallback(rrf_fusion(spark, d), 5).select("query_id", "doc_id", "rank", "rerank_score", "reranker_failed")


def _chunks(spark, d):
    """documents as chunks with gaps in their metadata."""
    k = F.col("doc_id")
    return _t(spark, d, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(k % 13 != 0, F.col("source")).alias("title"), F.concat(F.lit("http://h/"), k.cast("string")).alias("source_url"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("version_hash"), F.lit("Final").alias("status"), (k % 3).cast("int").alias("page"),
        (k % 2).cast("int").alias("page_number"), F.lit(7).alias("chunk_page"), F.lit("s").alias("section_id"),
    )


def evidence_gaps(spark, d):
    """Cards, with the first field that each lacks."""
    chunks = _chunks(spark, d)
    keyword = R.bm25(_queries(spark, d), _plain(spark, d), 20)
    cards = R.cards(R.fallback(R.fuse(keyword.limit(0), keyword, 10), 5), chunks)
    return cards.select("query_id", "citation_id", "doc_id", "page_number", "confidence", "missing")


def extractive_answer(spark, d):
    docs = _t(spark, d, "documents")
    flat = docs.select("doc_id", F.regexp_replace("text", "\n", " ").alias("text"))
    cards = R.bm25(_queries(spark, d), docs.select("doc_id", "text"), 2).join(flat.hint("merge"), "doc_id")
    return A.extractive(cards.withColumn("citation_id", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]"))))


def version_evidence(spark, d):
    """Each item in the version of one document by its number: those of one language and source stand for a version."""
    docs = _plain(spark, d).join(_t(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("slug"), F.coalesce("lang", F.lit("-")).alias("version_hash")), "doc_id")
    pick = docs.groupBy("slug", "version_hash").agg(F.min("doc_id").alias("m")).withColumn("n", F.pmod("m", F.lit(7)))
    requests = _queries(spark, d).withColumn("n", F.pmod("query_id", F.lit(7))).join(pick.hint("merge"), "n").groupBy("query_id", "text").agg(F.min(F.struct("slug", "version_hash")).alias("s")).select("query_id", "text", "s.*")
    return J.version_evidence(requests, docs, 20, 5)


def evidence_context(spark, d):
    """The block of each item's three best documents, as a digest: some have no section title or page."""
    n = F.col("n_chars")
    docs = _t(spark, d, "documents").select(
        "doc_id", F.coalesce("source", F.lit("none")).alias("title"), F.when(n % 3 != 0, F.concat(F.lit("Part "), F.coalesce("lang", F.lit("-")))).alias("section_title"), F.when(n % 2 == 0, "s1").otherwise("").alias("section_id"),
        F.when(n % 5 != 0, (n % 40).cast("int")).alias("page_number"), F.lit("Final").alias("document_status"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("version_hash"),
        F.concat(F.lit("http://h/"), F.col("doc_id").cast("string")).alias("source_url"), F.coalesce("text", F.lit("")).alias("passage"),
    )
    cards = R.bm25(_queries(spark, d), _plain(spark, d), 3).join(docs.hint("merge"), "doc_id")
    cards = cards.withColumns({"citation_id": F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")), "retrieval_score": F.col("score"), "rerank_score": F.col("score") * 2, "confidence": F.lit(0.5)})
    return A.evidence_context(cards).select("query_id", F.sha2("context", 256).alias("digest"), F.length("context").alias("n_chars"))


def _labelled(spark, d):
    v = _t(spark, d, "embeddings")
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label"), v.select(F.col("vec_id").alias("doc_id"), "label")


def retrieval_metrics(spark, d):
    """Same-label neighbours as the relevant rows of dense search."""
    return R.label_metrics(dense_topk(spark, d).withColumnRenamed("vec_id", "doc_id"), *_labelled(spark, d), 10)


def retrieval_lift(spark, d):
    """What ten results gain over five."""
    ranked = dense_topk(spark, d).withColumnRenamed("vec_id", "doc_id")
    return R.lift(R.label_metrics(ranked, *_labelled(spark, d), 5), R.label_metrics(ranked, *_labelled(spark, d), 10))


def filter_normalize(spark, d):
    """Raw filters of each part, some unknown, by name; the route they lead to."""
    k = F.col("p_partkey")
    raw = F.map_filter(
        F.create_map(
            F.lit("topics"), F.when(k % 2 == 0, F.regexp_replace("p_type", " ", " , ")), F.lit("center"), F.when(k % 3 == 0, F.col("p_brand")), F.lit("zeal"), F.lit("x"), F.lit("age"), F.when(k % 5 == 0, F.lit("y")),
        ),
        lambda n, v: v.isNotNull(),
    )
    q = C.normalize(_t(spark, d, "part").select("p_partkey", raw.alias("filters")))
    join = lambda name: F.coalesce(F.array_join(F.col("used")[name], "|"), F.lit(""))
    return q.select("p_partkey", join("topics").alias("topics"), join("center").alias("center"), F.array_join("ignored", "|").alias("ignored"), "route")


def metadata_filters(spark, d):
    """Orders under five filters at once."""
    o = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("document_slug"), F.when(F.col("o_orderkey") % 11 == 0, "withdrawn").otherwise("active").alias("lifecycle_state"), F.col("o_orderstatus").alias("status"),
        F.split("o_orderpriority", "-").alias("topics"), F.to_date("o_orderdate").alias("issue_date"),
    )
    where = C.clauses({"status": "O", "topics": ["1", "URGENT"], "issue_date_from": "1994-01-01", "issue_date_to": "1997-12-31"})
    return o.where(where).select("document_slug", F.date_format("issue_date", "yyyy-MM-dd").alias("issue_date"))


def compliance_phrases(spark, d):
    """Turns that decide a matter of compliance; a phrase is set into some."""
    c = _t(spark, d, "conversations")
    key = F.col("conv_id") * 31 + F.col("turn")
    phrase = F.when(key % 7 == 0, " So You are compliant.").when(key % 7 == 1, " So you are compliantly.").otherwise("")
    return c.select("conv_id", "turn", C.decides_compliance(F.concat(F.coalesce("text", F.lit("")), phrase)).alias("decides"))


def topics_any_all(spark, d):
    topics = F.split("p_type", " ")
    wanted = ["STANDARD", "BRASS"]
    return _t(spark, d, "part").select("p_partkey", all_of(topics, wanted).alias("has_all"), any_of(topics, wanted).alias("has_any"))


QUERIES = {f.__name__: f for f in (feature_hash_vectors, dense_topk, dense_topk_filtered, bm25_topk, bm25_multifield, rrf_fusion, hybrid_search, hybrid_status, fallback_rank, evidence_gaps, extractive_answer, version_evidence, evidence_context, retrieval_metrics, retrieval_lift, filter_normalize, metadata_filters, compliance_phrases, topics_any_all)}

_DENSE = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
  s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q WHERE {where}),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)"""


def _bm25(name: str, text: str, k: int) -> str:
    return f"""{name}_w AS (SELECT doc_id, regexp_extract_all(lower({text}), '([\\p{{L}}\\p{{N}}]+)', 1) AS t FROM documents WHERE {text} IS NOT NULL),
  {name}_tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM {name}_w) GROUP BY ALL),
  {name}_l AS (SELECT doc_id, len(t) AS dl FROM {name}_w WHERE len(t) > 0),
  {name}_f AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_l),
  {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
  {name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}]+)', 1)) AS term FROM benchmark) GROUP BY ALL),
  {name}_raw AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * qtf) AS s
    FROM {name}_tf JOIN {name}_q USING (term) JOIN {name}_df USING (term) JOIN {name}_l USING (doc_id), {name}_f GROUP BY query_id, doc_id),
  {name}_s AS (SELECT query_id, doc_id, round(s, 6) AS score FROM {name}_raw),
  {name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM {name}_s) WHERE rank <= {k})"""


_HASHED = """{n}_w AS (SELECT id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS w FROM {n}_t),
  {n}_h AS (SELECT id, sha256(w) AS h, count(*) AS n FROM {n}_w GROUP BY id, w),
  {n}_s AS (SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS slot, sum(CASE WHEN ('0x' || substr(h, 10, 1))::BIGINT % 2 = 0 THEN n ELSE -n END) AS v FROM {n}_h GROUP BY ALL),
  {n}_l AS (SELECT id, sqrt(sum(v * v)) AS l FROM {n}_s GROUP BY id HAVING sum(v * v) > 0),
  {n}_v AS (SELECT l.id, list(round(coalesce(v, 0) / l, 6)::DOUBLE ORDER BY k.slot) AS e FROM {n}_l l CROSS JOIN (SELECT unnest(range(64)) AS slot) k LEFT JOIN {n}_s s ON s.id = l.id AND s.slot = k.slot GROUP BY l.id)"""

_FUSE = (
    "WITH d_t AS (SELECT doc_id AS id, text AS t FROM documents), q_t AS (SELECT item_id AS id, text AS t FROM benchmark), "
    + _HASHED.format(n="d")
    + ","
    + _HASHED.format(n="q")
    + """, a AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM (
    SELECT q_v.id AS query_id, d_v.id AS doc_id, round(list_cosine_similarity(d_v.e, q_v.e), 6) AS score FROM d_v, q_v)) WHERE rank <= 20),"""
    + _bm25("b", "text", 20)
    + """,
  u AS (SELECT query_id, doc_id, max(ds) AS dense_score, max(ks) AS keyword_score, max(dr) AS dense_rank, max(kr) AS keyword_rank FROM (
    SELECT query_id, doc_id, score AS ds, NULL::DOUBLE AS ks, rank AS dr, NULL::INT AS kr FROM a UNION ALL SELECT query_id, doc_id, NULL, score, NULL, rank FROM b) GROUP BY query_id, doc_id),
  v AS (SELECT *, round(coalesce(1::DOUBLE / (60 + dense_rank), 0) + coalesce(1::DOUBLE / (60 + keyword_rank), 0), 9) AS rrf_score FROM u),
  fused AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, least(dense_rank, keyword_rank), doc_id) AS INT) AS rank FROM v) WHERE rank <= 10)"""
)
_FIELDS = "".join(_bm25(n, t, 1_000_000_000) + ",\n" for n, t in (("x", "text"), ("y", "string_split(text, chr(10))[1]"), ("z", "source")))
_METRICS = """, l AS (SELECT vec_id, label FROM embeddings), q2 AS (SELECT query_id, label FROM q JOIN l ON query_id = vec_id),
      m AS (SELECT query_id, count(*) AS m FROM q2 JOIN l USING (label) GROUP BY query_id),
      g AS (SELECT k, r.query_id, sum((l.label = q2.label)::INT) AS n, min(CASE WHEN l.label = q2.label THEN rank END) AS first FROM r JOIN l USING (vec_id) JOIN q2 ON q2.query_id = r.query_id JOIN (VALUES (5), (10)) t(k) ON rank <= k GROUP BY ALL),
      e AS (SELECT k, query_id, round(coalesce(n, 0) / m, 6)::DOUBLE AS recall, round(coalesce(n, 0) / k, 6)::DOUBLE AS precision, round(coalesce(1 / first, 0), 6)::DOUBLE AS reciprocal_rank FROM m LEFT JOIN g USING (query_id))"""

ORACLES = {
    "feature_hash_vectors": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
      h AS (SELECT doc_id, n, sha256(w) AS h FROM c),
      s AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS slot, sum(CASE WHEN ('0x' || substr(h, 10, 1))::BIGINT % 2 = 0 THEN n ELSE -n END) AS v FROM h GROUP BY ALL)
      SELECT doc_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6)::DOUBLE AS value FROM s WHERE v <> 0""",
    "dense_topk": _DENSE.format(where="true") + " SELECT * FROM r WHERE rank <= 10",
    "dense_topk_filtered": _DENSE.format(where="label = 1") + " SELECT * FROM r WHERE rank <= 5",
    "bm25_topk": "WITH " + _bm25("b", "text", 10) + " SELECT query_id, doc_id, score, rank FROM b",
    "rrf_fusion": _FUSE + " SELECT query_id, doc_id, dense_score, keyword_score, dense_rank, keyword_rank, rrf_score, rank FROM fused",
    "hybrid_search": _FUSE
    + """, q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark),
      o AS (SELECT f.query_id, f.doc_id, source, lang, text AS passage, rrf_score, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))) / len(q) END, 6) AS rerank_score
        FROM fused f JOIN q USING (query_id) JOIN documents USING (doc_id)),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rank FROM o)
      SELECT query_id, '[' || rank || ']' AS citation_id, doc_id, source, lang, passage, rrf_score, rerank_score::DOUBLE AS rerank_score, round(1 / (1 + exp(-rerank_score)), 6) AS confidence FROM r WHERE rank <= 5""",
    "retrieval_metrics": _DENSE.format(where="true") + _METRICS + " SELECT query_id, recall, precision, reciprocal_rank FROM e WHERE k = 10",
    "retrieval_lift": _DENSE.format(where="true") + _METRICS + """ SELECT round(avg(recall) FILTER (k = 10) - avg(recall) FILTER (k = 5), 6) AS recall_lift, round(avg(precision) FILTER (k = 10) - avg(precision) FILTER (k = 5), 6) AS precision_lift,
      round(avg(reciprocal_rank) FILTER (k = 10) - avg(reciprocal_rank) FILTER (k = 5), 6) AS reciprocal_rank_lift FROM e""",
    "bm25_multifield": "WITH " + _FIELDS + """ s AS (SELECT query_id, doc_id, round(max(s), 6) AS score FROM (SELECT query_id, doc_id, 3 * s AS s FROM xx UNION ALL SELECT query_id, doc_id, 2 * s FROM yy UNION ALL SELECT query_id, doc_id, s FROM zz) GROUP BY ALL),
      r AS (SELECT s.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s JOIN documents USING (doc_id) WHERE lang = 'en') SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""".replace("xx", "x_raw").replace("yy", "y_raw").replace("zz", "z_raw"),
    "hybrid_status": _FUSE + """ SELECT item_id AS query_id, CASE WHEN count(dense_rank) > 0 THEN 'success' ELSE 'empty' END AS dense_status, CASE WHEN count(keyword_rank) > 0 THEN 'success' ELSE 'empty' END AS keyword_status,
      CASE WHEN count(doc_id) > 0 THEN 'success' ELSE 'skipped' END AS reranker_status FROM benchmark LEFT JOIN fused ON query_id = item_id GROUP BY item_id""",
    "fallback_rank": _FUSE + " SELECT query_id, doc_id, rank, rrf_score AS rerank_score, true AS reranker_failed FROM fused WHERE rank <= 5",
    "evidence_gaps": "WITH " + _bm25("b", "text", 5) + """ SELECT query_id, '[' || rank || ']' AS citation_id, doc_id, CAST(coalesce(nullif(doc_id % 3, 0), nullif(doc_id % 2, 0), 7) AS INT) AS page_number, 0.0::DOUBLE AS confidence,
      CASE WHEN doc_id % 13 = 0 OR coalesce(source, '') = '' THEN 'title' END AS missing FROM b JOIN documents USING (doc_id)""",
    "extractive_answer": "WITH " + _bm25("b", "text", 2) + """, s AS (SELECT query_id, rank, string_split_regex(regexp_replace(replace(text, chr(10), ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM b JOIN documents USING (doc_id)),
      p AS (SELECT query_id, rank, coalesce(list_filter(s, lambda x: length(x) >= 40)[1], s[1]) || ' [' || rank || ']' AS p FROM s) SELECT query_id, string_agg(p, ' ' ORDER BY rank) AS answer FROM p GROUP BY query_id""",
    "version_evidence": "WITH " + _bm25("b", "text", 20) + """, p AS (SELECT coalesce(source, '-') AS slug, coalesce(lang, '-') AS ver, min(doc_id) % 7 AS n FROM documents GROUP BY ALL),
      q AS (SELECT item_id AS query_id, text, min({'slug': slug, 'ver': ver}) AS s FROM benchmark JOIN p ON item_id % 7 = n GROUP BY item_id, text),
      c AS (SELECT q.query_id, d.doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, d.doc_id) AS k, round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')))) / greatest(len(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+'))), 1), 6)::DOUBLE AS rerank_score
        FROM b_s JOIN q USING (query_id) JOIN documents d ON d.doc_id = b_s.doc_id AND coalesce(source, '-') = s.slug AND coalesce(lang, '-') = s.ver)
      SELECT query_id, doc_id, rank, rerank_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS INT) AS rank FROM c WHERE k <= 20) WHERE rank <= 5""",
    "evidence_context": "WITH " + _bm25("b", "text", 3) + """, c AS (SELECT query_id, string_agg('[' || rank || '] ' || coalesce(source, 'none') || chr(10)
        || 'Section: ' || CASE WHEN n_chars % 3 <> 0 THEN 'Part ' || coalesce(lang, '-') WHEN n_chars % 2 = 0 THEN 's1' ELSE 'Unknown section' END || '; ' || CASE WHEN n_chars % 5 <> 0 THEN 'page ' || (n_chars % 40) ELSE 'page unavailable' END || chr(10)
        || 'Status: Final; version: ' || sha256(coalesce(text, '')) || chr(10) || 'Scores: retrieval=' || printf('%.4f', score) || '; rerank=' || printf('%.4f', score * 2) || '; confidence=0.5000' || chr(10)
        || 'Source: http://h/' || doc_id || chr(10) || 'Passage: ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM b JOIN documents USING (doc_id) GROUP BY query_id)
      SELECT query_id, sha256(context) AS digest, length(context)::INT AS n_chars FROM c""",
    "filter_normalize": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(p_type, ' ', '|') ELSE '' END AS topics, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS center,
      CASE WHEN p_partkey % 5 = 0 THEN 'age|zeal' ELSE 'zeal' END AS ignored, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 'metadata_constrained' ELSE 'hybrid' END AS route FROM part""",
    "metadata_filters": """SELECT o_orderkey AS document_slug, strftime(o_orderdate, '%Y-%m-%d') AS issue_date FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_orderdate::DATE BETWEEN DATE '1994-01-01' AND DATE '1997-12-31'""",
    "compliance_phrases": "SELECT conv_id, turn, (conv_id * 31 + turn) % 7 = 0 OR coalesce(regexp_matches(text, '(?i)\\b(you are compliant|you are not compliant|fda will approve|submission will be accepted|will be accepted by fda)\\b'), false) AS decides FROM conversations",
    "topics_any_all": """SELECT p_partkey, list_has_all(string_split(p_type, ' '), ['STANDARD', 'BRASS']) AS has_all, list_has_any(string_split(p_type, ' '), ['STANDARD', 'BRASS']) AS has_any FROM part""",
}
