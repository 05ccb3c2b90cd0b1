"""Queries on the registry, versions, alerts and reports; orders give two snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefold.operators import documents as D
from lorefold.operators import filters as C
from lorefold.operators import registry as R

NOW = "2025-01-01 00:00:00"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _now():
    return F.lit(NOW).cast("timestamp")


def _registry(spark, d):
    o = _t(spark, d, "orders").where("o_orderkey % 7 <> 0")
    return o.select(
        F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string")).alias("slug"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 11 == 0, "withdrawn").otherwise("active").alias("lifecycle_state"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate").cast("timestamp")).alias("changed_at"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen_at"),
        F.col("o_orderdate").cast("timestamp").alias("last_seen_at"),
    )


def _feed(spark, d):
    o = _t(spark, d, "orders").where("o_orderkey % 5 <> 0")
    return o.select(
        F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string")).alias("slug"),
        F.when(F.col("o_orderkey") % 17 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderdate").cast("timestamp") + F.expr("make_interval(0, 0, 0, if(o_orderkey % 3 = 0, 1, 0))")).alias("changed_at"),
    )


def registry_upsert(spark, d):
    return R.sync(_registry(spark, d), _feed(spark, d), _now())


def registry_diff(spark, d):
    return registry_upsert(spark, d).where("change_type IS NOT NULL").select("slug", "change_type", "status")


def last_wins(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return R.last_wins(e, "user_id", "event_id")


def daily_report(spark, d):
    return R.change_report(registry_upsert(spark, d))


def reconcile_counts(spark, d):
    r = registry_upsert(spark, d)
    dense = _feed(spark, d).select(F.col("slug").alias("document_slug"))
    return R.reconciled(r, dense, _feed(spark, d).where("slug NOT LIKE '%77'"))


def approx_docs(spark, d):
    return _t(spark, d, "documents").agg(F.approx_count_distinct(F.sha2(F.coalesce("text", F.lit("")), 256), 0.02).alias("n"))


def _changes(spark, d):
    return R.sync(_registry(spark, d), _feed(spark, d), _now(), previous=True)


def alert_fingerprint(spark, d):
    o = _t(spark, d, "orders")
    slug = F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string")).alias("slug")
    titles = o.where("o_orderkey % 2 = 0").select(slug, F.col("o_orderpriority").alias("title"))
    versions = o.where("o_orderkey % 3 = 0").select(slug, F.sha2(F.col("o_orderpriority"), 256).alias("version_hash"))
    return R.alerts(_changes(spark, d), titles, versions)


def alerts_page(spark, d):
    """A page of the open alerts, as events of one kind."""
    e = _t(spark, d, "events").select(F.col("event_id").alias("alert_id"), F.col("ts").alias("detected_at"), F.when(F.col("event_type") == "purchase", "open").otherwise("resolved").alias("status"))
    return R.alerts_page(e, "open", 50, 10)


def alert_stamps(spark, d):
    """Who acknowledged what, and when."""
    e = _t(spark, d, "events")
    to = F.when(F.col("event_type").isin("view", "click"), "acknowledged").when(F.col("event_type") == "purchase", "resolved").otherwise("open")
    r = e.select((F.col("event_id") % 997).alias("alert_id"), F.col("event_id").alias("at"), F.col("event_id").alias("request_id"), "user_id", to.alias("to"))
    return R.transitions(r, stamps=True)


def dangling_documents(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string")).alias("slug"))
    return R.with_documents(rows, _registry(spark, d)).select("o_orderkey", "document")


def report_nested(spark, d):
    """The changes by kind, as one digest of each list."""
    outcomes = _feed(spark, d).select("slug", F.lit(2).alias("dense_indexed"), F.lit(3).alias("keyword_indexed"))
    changes = _changes(spark, d).where("change_type IS NOT NULL").select("slug", "change_type", "previous_status", "status")
    r = R.nested_report(changes, outcomes)
    part = lambda x: F.concat_ws(":", x["slug"], F.coalesce(x["previous_status"], F.lit("-")), x["status"], F.coalesce(x["dense_indexed"].cast("string"), F.lit("-")))
    return r.select("change_type", "n", F.sha2(F.array_join(F.transform("changes", part), ";"), 256).alias("digest"))


def backfill_summary(spark, d):
    return R.backfill_summary(registry_upsert(spark, d))


def _versions(spark, d):
    k = F.col("doc_id")
    return _t(spark, d, "documents").select(
        (k % 500).cast("string").alias("slug"), F.when(k % 3 != 0, F.concat(F.lit("D-"), (k % 200).cast("string"))).alias("docket"), k.alias("created"),
        F.sha2(F.concat_ws("/", "lang", "source"), 256).alias("hash"), F.when(k % 4 == 0, "Draft").otherwise("Guide").alias("status"),
    )


def version_snapshots(spark, d):
    """Versions of documents that share dockets; hashes of language and source, so that some are unchanged."""
    return R.version_snapshots(_versions(spark, d))


def _two_versions(spark, d):
    """documents in two versions: every seventh line of the second is another."""
    docs = _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 7 == 3, F.concat(x, F.lit(" changed"))).otherwise(x))
    new = docs.select("doc_id", F.array_join(lines, "\n").alias("text"))
    for name, v in (("v1", docs), ("v2", new)):
        para = v.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"), F.lit(name).alias("version_hash"))
        yield D.document_chunks(para, 200, 200, 20).withColumns({"slug": F.col("doc_id").cast("string"), "version_hash": F.lit(name)})


def text_diff(spark, d):
    old, new = _two_versions(spark, d)
    pairs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.lit("v1").alias("previous"), F.lit("v2").alias("current"))
    return R.text_diff(old.unionByName(new), pairs)


def document_contents(spark, d):
    """Each document's versions, newest first, and the sections of the current one."""
    old, new = _two_versions(spark, d)
    v = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.explode(F.array(F.struct(F.lit("v1").alias("hash"), F.lit(1).alias("created")), F.struct(F.lit("v2").alias("hash"), F.lit(2).alias("created")))).alias("x")).select("slug", "x.*")
    views = R.document_views(v, old.unionByName(new))
    return views.select("slug", F.array_join("versions", "|").alias("versions"), "current", F.array_join("section_ids", "|").alias("section_ids"))


def document_pages(spark, d):
    """Pages of documents: those of a language and source, with the texts as versions and their lines as sections."""
    docs = _t(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source", (F.col("n_chars") % 50).cast("string")).alias("slug"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("version_hash"), "lang", F.coalesce("text", F.lit("")).alias("text"), "n_chars")
    registry = docs.groupBy("slug").agg(F.min("lang").alias("title"), F.when(F.min("n_chars") % 3 == 0, "Draft").when(F.min("n_chars") % 3 == 1, "Level 2").alias("status"), F.when(F.max("n_chars") % 5 == 0, "withdrawn").otherwise("active").alias("lifecycle_state"))
    files = docs.where("n_chars % 7 <> 0").select("slug", "version_hash", F.when(F.col("n_chars") % 2 == 0, "raw_pdf").otherwise("raw_html").alias("artifact_kind"), F.col("doc_id").alias("created_at"))
    chunks = docs.select("slug", "version_hash", F.posexplode(F.split("text", "\n")).alias("chunk_no", "line")).select("slug", "version_hash", "chunk_no", F.substring("line", 1, 3).alias("section_id"))
    pages = R.document_pages(registry, files, chunks)
    listed = F.array_join(F.transform("artifacts", lambda x: F.concat(F.substring(x["version_hash"], 1, 8), F.lit(":"), x["artifact_kind"])), "|")
    return pages.select("slug", "title", "status", F.array_join("versions", "|").alias("versions"), listed.alias("artifacts"), F.size("section_ids").cast("long").alias("n_sections"))


def stored_cardinality(spark, d):
    """Rows and batches of the sketches stored of documents by source."""
    sketches = R.stored_sketches(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.coalesce("source", F.lit("-")).alias("source")), F.col("source"))
    one = R.merged_estimate(sketches)
    n = _t(spark, d, "documents").agg(F.countDistinct("doc_id").alias("n"))
    return one.crossJoin(n).select("n_batches", "n_rows", (F.abs(F.col("n_distinct") - F.col("n")) <= 0.03 * F.col("n")).alias("within"))


def section_nav(spark, d):
    return R.section_navigation(next(iter(_two_versions(spark, d)))).select("doc_id", "section_id", "chunk_no", "section_title", "page_number")


def passage_lookup(spark, d):
    """The first chunk of every fourth document, where it has a source."""
    chunks = next(iter(_two_versions(spark, d))).withColumn("source_url", F.when(F.col("doc_id") % 8 != 0, "http://h"))
    requests = _t(spark, d, "documents").where("doc_id % 4 = 0").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":v1:0")).alias("chunk_id"))
    return R.passages(requests, chunks).select("doc_id", "chunk_id", "page_number", "source_url")


def sync_freshness(spark, d):
    r = _registry(spark, d).withColumn("last_synced_at", F.col("last_seen_at"))
    return R.freshness(r, _now()).select(F.date_format("last_synced_at", "yyyy-MM-dd").alias("last_synced_on"), "age_hours")


def audit_filters(spark, d):
    """Audit rows of one kind and user group within a range of times, both ends in it."""
    e = _t(spark, d, "events").select("event_id", "event_type", "user_id", F.col("ts").alias("created_at"), F.col("event_type").alias("route"))
    lo, hi = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
    return e.where(C.audit_filter(event_type="purchase", route="purchase", created_from=lo, created_to=hi)).select("event_id")


def alerts_insert_new(spark, d):
    a = alert_fingerprint(spark, d)
    return R.insert_new(a.where("slug LIKE '%1'"), a, "event_fingerprint")


def alert_transitions(spark, d):
    e = _t(spark, d, "events")
    to = F.when(F.col("event_type").isin("view", "click"), "acknowledged").when(F.col("event_type") == "purchase", "resolved").otherwise("open")
    return R.transitions(e.select(F.col("user_id").alias("alert_id"), F.col("ts").alias("at"), F.col("event_id").alias("request_id"), to.alias("to")))


def version_events(spark, d):
    """Versions of which some are unchanged, with statuses as they are written, some of them missing, and dockets."""
    k = F.col("doc_id")
    status = F.when(k % 3 == 0, "Draft").when(k % 5 == 0, "Level 2").when(k % 7 != 0, "Final")
    v = _versions(spark, d).withColumn("k", F.col("created")).drop("status")
    s = _t(spark, d, "documents").select(k.alias("k"), status.alias("status"), F.when(k % 11 == 0, "withdrawn").otherwise("active").alias("lifecycle"))
    return R.version_events(v.join(s.hint("merge"), "k").drop("k"))


def index_swap(spark, d):
    """Chunk counts by version once changed documents' rows are replaced and withdrawn ones removed."""
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, 2).otherwise(1).alias("version"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    old = docs.withColumn("version", F.lit(1))
    gone = docs.where("doc_id % 9 = 0").select("doc_id")
    fresh = docs.where("version = 2")
    kept = old.join(fresh.select("doc_id"), "doc_id", "left_anti").join(gone, "doc_id", "left_anti")
    now = kept.unionByName(fresh.join(gone, "doc_id", "left_anti"))
    return now.groupBy("version").agg(F.count("*").alias("n_docs"), F.sum("size").alias("n_chars"))


def document_view(spark, d):
    """Each source's versions, newest first, and its current one."""
    v = _t(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("slug"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    one = v.groupBy("slug", "hash").agg(F.max("doc_id").alias("at"))
    return one.groupBy("slug").agg(F.count("*").alias("n_versions"), F.max_by("hash", "at").alias("current_hash"), F.max("at").alias("newest"))


QUERIES = {
    f.__name__: f
    for f in (registry_upsert, registry_diff, last_wins, daily_report, report_nested, backfill_summary, reconcile_counts, approx_docs, alert_fingerprint, alerts_page, alert_stamps, dangling_documents, version_snapshots, text_diff, document_contents, document_pages, stored_cardinality, section_nav, passage_lookup, sync_freshness, audit_filters, alerts_insert_new, alert_transitions, version_events, index_swap, document_view)
}

_SYNC = f"""WITH o AS (SELECT 'doc-' || o_orderkey AS slug, o_orderstatus AS status, CASE WHEN o_orderkey % 11 = 0 THEN 'withdrawn' ELSE 'active' END AS state, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate::TIMESTAMP END AS ts, o_orderdate::TIMESTAMP AS seen FROM orders WHERE o_orderkey % 7 <> 0),
 n AS (SELECT 'doc-' || o_orderkey AS slug, CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderdate::TIMESTAMP + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END END AS ts FROM orders WHERE o_orderkey % 5 <> 0),
 s AS (SELECT coalesce(n.slug, o.slug) AS slug, CASE WHEN n.slug IS NOT NULL THEN n.status ELSE o.status END AS status, CASE WHEN n.slug IS NOT NULL THEN 'active' ELSE 'withdrawn' END AS lifecycle_state,
   CASE WHEN n.slug IS NOT NULL THEN n.ts ELSE o.ts END AS changed_at, coalesce(o.seen, TIMESTAMP '{NOW}') AS first_seen_at, CASE WHEN n.slug IS NULL AND o.state = 'withdrawn' THEN o.seen ELSE TIMESTAMP '{NOW}' END AS last_seen_at,
   CASE WHEN o.slug IS NULL THEN 'new' WHEN n.slug IS NULL THEN CASE WHEN o.state <> 'withdrawn' THEN 'withdrawn' END
     WHEN o.state = 'withdrawn' OR o.status IS DISTINCT FROM n.status OR (o.ts IS NULL AND n.ts IS NOT NULL) OR n.ts > o.ts THEN 'updated' END AS change_type, o.status AS p_status, o.ts AS p_ts
   FROM o FULL JOIN n ON o.slug = n.slug)"""
_ALERTS = _SYNC + """, t AS (SELECT 'doc-' || o_orderkey AS slug, o_orderpriority AS title FROM orders WHERE o_orderkey % 2 = 0), w AS (SELECT 'doc-' || o_orderkey AS slug, sha256(o_orderpriority) AS v FROM orders WHERE o_orderkey % 3 = 0),
 a AS (SELECT sha256(concat_ws(chr(31), change_type, s.slug, coalesce(p_status, ''), coalesce(status, ''), coalesce(v, ''), coalesce(strftime(p_ts, '%Y-%m-%dT%H:%M:%S+00:00'), ''), coalesce(strftime(changed_at, '%Y-%m-%dT%H:%M:%S+00:00'), ''))) AS event_fingerprint, s.slug, coalesce(title, s.slug) AS title, change_type
   FROM s LEFT JOIN t ON s.slug = t.slug LEFT JOIN w ON s.slug = w.slug WHERE change_type IS NOT NULL)"""

ORACLES = {
    "registry_upsert": _SYNC + " SELECT * EXCLUDE (p_status, p_ts) FROM s",
    "registry_diff": _SYNC + " SELECT slug, change_type, status FROM s WHERE change_type IS NOT NULL",
    "last_wins": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "daily_report": _SYNC + " SELECT count(change_type) AS total, count(*) FILTER (change_type = 'new') AS n_new, count(*) FILTER (change_type = 'updated') AS n_updated, count(*) FILTER (change_type = 'withdrawn') AS n_withdrawn FROM s",
    "reconcile_counts": _SYNC + """ SELECT *, active = dense AND keyword = active AS agrees FROM (SELECT (SELECT count(*) FROM s WHERE lifecycle_state = 'active') AS active, (SELECT count(DISTINCT slug) FROM n) AS dense, (SELECT count(DISTINCT slug) FROM n WHERE slug NOT LIKE '%77') AS keyword)""",
    "backfill_summary": _SYNC + " SELECT count(*) FILTER (lifecycle_state = 'active') AS record_count, count(change_type) AS change_count, count(*) FILTER (change_type = 'new') AS n_new, count(*) FILTER (change_type = 'updated') AS n_updated, count(*) FILTER (change_type = 'withdrawn') AS n_withdrawn FROM s",
    "report_nested": _SYNC + """ SELECT change_type, count(*) AS n, sha256(string_agg(s.slug || ':' || coalesce(p_status, '-') || ':' || s.status || ':' || CASE WHEN n.slug IS NULL THEN '-' ELSE '2' END, ';' ORDER BY s.slug)) AS digest
      FROM s LEFT JOIN n ON s.slug = n.slug WHERE change_type IS NOT NULL GROUP BY change_type""",
    "alerts_page": "SELECT event_id AS alert_id, ts AS detected_at, 'open' AS status FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10",
    "alert_stamps": """WITH r AS (SELECT event_id % 997 AS alert_id, event_id, user_id, CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'purchase' THEN 2 ELSE 0 END AS l FROM events),
      b AS (SELECT *, coalesce(max(l) OVER (PARTITION BY alert_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM r)
      SELECT alert_id, ['open', 'acknowledged', 'resolved'][max(greatest(l, s)) + 1] AS state, count(*) FILTER (l < s) AS refused, min(event_id) FILTER (l = 1 AND s < 1) AS acknowledged_at,
        arg_min(user_id, event_id) FILTER (l = 1 AND s < 1) AS acknowledged_by, min(event_id) FILTER (l = 2 AND s < 2) AS resolved_at FROM b GROUP BY alert_id""",
    "dangling_documents": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 'doc-' || o_orderkey ELSE 'withdrawn-document' END AS document FROM orders",
    "version_snapshots": """WITH v AS (SELECT CAST(doc_id % 500 AS VARCHAR) AS slug, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 200 END AS docket, doc_id AS created, sha256(concat_ws('/', lang, source)) AS hash, CASE WHEN doc_id % 4 = 0 THEN 'Draft' ELSE 'Final' END AS status FROM documents),
      l AS (SELECT *, lag(hash) OVER (PARTITION BY slug ORDER BY created) AS p FROM v),
      r AS (SELECT l.*, q FROM l LEFT JOIN (SELECT a.created, arg_max(b.hash, b.created) AS q FROM v a JOIN v b ON a.docket = b.docket AND a.slug <> b.slug AND b.created < a.created GROUP BY a.created) USING (created))
      SELECT slug, created, hash, status AS document_status, CASE WHEN p IS NOT NULL AND p <> hash THEN p WHEN q IS NOT NULL AND q <> hash THEN q END AS supersedes, coalesce(p = hash, false) AS unchanged FROM r""",
    "document_pages": """WITH d AS (SELECT doc_id, concat_ws('/', lang, source, (n_chars % 50)::VARCHAR) AS slug, sha256(coalesce(text, '')) AS h, lang, coalesce(text, '') AS text, n_chars FROM documents),
      r AS (SELECT slug, coalesce(min(lang), slug) AS title, CASE WHEN max(n_chars) % 5 = 0 THEN 'Withdrawn' WHEN min(n_chars) % 3 = 0 THEN 'Draft' ELSE 'Final' END AS status FROM d GROUP BY slug),
      a AS (SELECT * FROM d WHERE n_chars % 7 <> 0), v AS (SELECT slug, h, max(doc_id) AS pos FROM a GROUP BY ALL),
      w AS (SELECT slug, string_agg(h, '|' ORDER BY pos DESC, h DESC) AS versions, arg_max(h, pos) AS cur FROM v GROUP BY slug),
      f AS (SELECT slug, string_agg(substr(h, 1, 8) || ':' || CASE WHEN n_chars % 2 = 0 THEN 'raw_pdf' ELSE 'raw_html' END, '|' ORDER BY doc_id DESC) AS artifacts FROM a GROUP BY slug),
      s AS (SELECT w.slug, count(DISTINCT substr(line, 1, 3)) AS n FROM w JOIN (SELECT slug, h, unnest(string_split(text, chr(10))) AS line FROM d) l ON l.slug = w.slug AND l.h = w.cur GROUP BY w.slug)
      SELECT r.slug, title, status, coalesce(versions, '') AS versions, coalesce(artifacts, '') AS artifacts, coalesce(n, 0)::BIGINT AS n_sections FROM r LEFT JOIN w USING (slug) LEFT JOIN f USING (slug) LEFT JOIN s USING (slug)""",
    "stored_cardinality": "SELECT count(DISTINCT coalesce(source, '-')) AS n_batches, count(*) AS n_rows, true AS within FROM documents",
    "sync_freshness": "SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS last_synced_on, round((epoch(TIMESTAMP '2025-01-01') - epoch(max(o_orderdate)::TIMESTAMP)) / 3600, 6)::DOUBLE AS age_hours FROM orders WHERE o_orderkey % 7 <> 0",
    "audit_filters": "SELECT event_id FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
    "passage_lookup": "SELECT doc_id, doc_id || ':v1:0' AS chunk_id, 1 AS page_number, 'http://h' AS source_url FROM documents WHERE doc_id % 8 = 4 AND trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) <> ''",
    "alert_fingerprint": _ALERTS + " SELECT * FROM a",
    "alerts_insert_new": _ALERTS + " SELECT * FROM a WHERE slug NOT LIKE '%1'",
    "alert_transitions": """WITH r AS (SELECT user_id AS alert_id, ts, event_id, CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'purchase' THEN 2 ELSE 0 END AS l FROM events),
      b AS (SELECT *, coalesce(max(l) OVER (PARTITION BY alert_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM r)
      SELECT alert_id, ['open', 'acknowledged', 'resolved'][max(greatest(l, s)) + 1] AS state, count(*) FILTER (l < s) AS refused FROM b GROUP BY alert_id""",
    "version_events": """WITH v AS (SELECT CAST(doc_id % 500 AS VARCHAR) AS slug, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 200 END AS docket, doc_id AS created, sha256(concat_ws('/', lang, source)) AS hash,
        CASE WHEN doc_id % 3 = 0 THEN 'Draft' WHEN doc_id % 5 = 0 THEN 'Level 2' WHEN doc_id % 7 <> 0 THEN 'Final' END AS status, CASE WHEN doc_id % 11 = 0 THEN 'withdrawn' ELSE 'active' END AS life FROM documents),
      l AS (SELECT *, lag(hash) OVER w AS ph, lag(status) OVER w AS ps, lag(life) OVER w AS pl FROM v WINDOW w AS (PARTITION BY slug ORDER BY created)),
      r AS (SELECT l.*, q FROM l LEFT JOIN (SELECT a.created, arg_max(b.hash, b.created) AS q FROM v a JOIN v b ON a.docket = b.docket AND a.slug <> b.slug AND b.created < a.created GROUP BY a.created) USING (created)),
      e AS (SELECT slug, created, list_filter([CASE WHEN ph IS NULL OR ph <> hash THEN 'new_version' END, CASE WHEN ps IS NOT NULL AND ps IS DISTINCT FROM status THEN 'status_changed' END, CASE WHEN pl IS NOT NULL AND pl <> life THEN 'lifecycle_changed' END,
        CASE WHEN ph <> hash OR q <> hash THEN 'supersedes_version' END], lambda x: x IS NOT NULL) AS es FROM r)
      SELECT slug, created, CAST(generate_subscripts(es, 1) - 1 AS INT) AS no, unnest(es) AS event FROM e""",
    "index_swap": "SELECT CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS version, count(*) AS n_docs, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars FROM documents WHERE doc_id % 9 <> 0 GROUP BY 1",
    "document_view": """WITH v AS (SELECT coalesce(source, 'none') AS slug, sha256(coalesce(text, '')) AS hash, max(doc_id) AS pos FROM documents GROUP BY ALL)
      SELECT slug, count(*) AS n_versions, arg_max(hash, pos) AS current_hash, max(pos) AS newest FROM v GROUP BY slug""",
}
