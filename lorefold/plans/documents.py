"""Queries on document structure and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefold.functions import csv_list, url_slug, yes_no
from lorefold.operators import catalog as C
from lorefold.operators import documents as D
from lorefold.operators import index as I
from lorefold.operators import jobs as J
from lorefold.sources import artifact_rows, catalog_rows, landed

PAGE = 1000


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def _pages(spark, d):
    """documents cut in pages of PAGE characters."""
    docs = _docs(spark, d).select("doc_id", "text", F.explode(F.expr(f"sequence(0, cast((greatest(length(text), 1) - 1) div {PAGE} as int))")).alias("page_number"))
    return docs.select("doc_id", "page_number", F.expr(f"substring(text, page_number * {PAGE} + 1, {PAGE})").alias("text"))


def page_offsets(spark, d):
    return D.page_offsets(_pages(spark, d))


def page_of_offset(spark, d):
    points = _docs(spark, d).select("doc_id", F.explode(F.expr("sequence(0, length(text), 1500)")).alias("at"))
    return D.page_of_offset(points, D.page_offsets(_pages(spark, d)))


def _headed(spark, d):
    """documents with a numbered heading before every tenth line, set off by white space of several kinds."""
    rows = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 10 == 3, F.concat(F.lit("\t\u00a0"), (i / 10).cast("int").cast("string"), F.lit(". Part of the text \r\n"), x)).otherwise(x),
    )
    return _docs(spark, d).select("doc_id", F.array_join(rows, "\n").alias("text"))


def section_headings(spark, d):
    lines = D.text_lines(_headed(spark, d)).where(D.is_heading(F.col("line")))
    return lines.select("doc_id", "line_no", "line", "char_start")


def section_spans(spark, d):
    return D.sections(_headed(spark, d))


def chunk_paragraphs(spark, d):
    docs = _docs(spark, d).select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return D.paragraphs(docs)


def chunk_windows(spark, d):
    return D.child_chunks(_docs(spark, d)).drop("text")


def document_text(spark, d):
    """The pages joined again."""
    a = D.assemble(_pages(spark, d))
    return a.select("doc_id", F.length("text").alias("n_chars"), F.size("pages").alias("n_pages"), F.sha2("text", 256).alias("text_sha256"))


def section_pages(spark, d):
    offsets = D.page_offsets(_pages(spark, d))
    return D.section_pages(D.sections(_headed(spark, d)), offsets)


def low_text(spark, d):
    return D.low_text(_pages(spark, d), 400)


def _halved(spark, d):
    """documents with a blank line behind every second line."""
    rows = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 1, F.concat(x, F.lit("\n"))).otherwise(x))
    return _docs(spark, d).select("doc_id", F.array_join(rows, "\n").alias("text"))


def chunk_rows(spark, d):
    """Parents and children of documents with headings: their kinds, places and pages."""
    pages = D.assemble(_pages(spark, d)).select("doc_id", "pages")
    docs = _headed(spark, d).join(pages.hint("merge"), "doc_id")
    return D.document_chunks(docs, 2000, 600, 80).drop("text")


def chunk_counts(spark, d):
    """Each document's chunks by kind: blank lines make paragraphs, parents hold those that fit."""
    c = D.document_chunks(_halved(spark, d), 1500, 400, 50)
    return c.groupBy("doc_id", "chunk_type").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.min("chunk_no").alias("first_no"))


def page_pdf_url(spark, d):
    """The first link to a file of each page; pages get a link set in by their number."""
    k = F.col("page_id")
    extra = F.when(k % 3 == 0, '<p><a class="x" href="/media/7/download">file</a>').when(k % 3 == 1, "<a href='docs/A.PDF?x=1'>b</a>").otherwise('<a href="/y"> a <b>Pdf</b></a>')
    pages = _t(spark, d, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), extra).alias("html"))
    return C.pdf_links(pages, "https://x.org/a/b")


def source_choice(spark, d):
    """What would be fetched for each part, and under which ending it would be kept."""
    k = F.col("p_partkey")
    registry = _t(spark, d, "part").select(
        k.cast("string").alias("slug"), F.when(k % 4 == 0, F.concat(F.lit("http://x/"), k.cast("string"), F.lit(".pdf"))).alias("pdf_url"),
        F.when(k % 5 != 0, F.concat(F.lit("http://x/page/"), (k % 50).cast("string"))).alias("landing_url"),
    )
    landing = _t(spark, d, "part").where(k < 50).select(F.concat(F.lit("http://x/page/"), k.cast("string")).alias("landing_url"), F.when(k % 3 == 0, "http://x/of-page.pdf").alias("page_pdf_url"))
    s = C.sources(registry, landing)
    return s.select("slug", "url", "artifact_kind", C.extension(F.lit("text/plain; x"), F.col("artifact_kind"), F.col("url")).alias("extension"))


def artifact_meta(spark, d):
    docs = _docs(spark, d).select(
        F.col("doc_id").cast("string").alias("slug"), F.col("text").cast("binary").alias("content"), F.when(F.col("doc_id") % 2 == 0, "application/pdf").alias("content_type"),
        F.lit(None).cast("string").alias("artifact_kind"), F.concat(F.lit("http://x/f/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".Docx").otherwise("")).alias("url"),
    )
    return artifact_rows(docs)


def references(spark, d):
    """Citations set into documents."""
    k = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" See 21 CFR 314.50 and "), (k % 9 + 1).cast("string"), F.lit(" CFR Part 11; 21 CFR 314.50. Product codes: "), F.when(k % 2 == 0, "QAB").otherwise("XYZ"))
    r = D.references(_t(spark, d, "documents").select("doc_id", text.alias("text")))
    return r.select("doc_id", F.array_join("cfr_references", "|").alias("cfr"), F.array_join("product_codes", "|").alias("codes"))


def _feed(spark, d):
    """part as raw catalog rows with markup in them."""
    k = F.col("p_partkey")
    text = k.cast("string")
    return _t(spark, d, "part").select(
        F.when(k % 17 != 0, F.concat(F.lit('&lt;a class=&quot;t&quot; href="/docs/'), text, F.lit('/"&gt;'), F.col("p_name"), F.lit(" &amp; <i>co</i></a>"))).otherwise(F.col("p_name")).alias("title"),
        F.when(k % 2 == 0, F.concat(F.lit("<a href='media/"), text, F.lit("/download'>x</a>"))).alias("field_associated_media_2"),
        F.when(k % 19 == 0, "2020-01-02").otherwise(F.concat((k % 12 + 1).cast("string"), F.lit("/07/2021"))).alias("field_issue_datetime"),
        F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" <b>"), F.col("p_brand"), F.lit("</b> "))).alias("field_center"),
        F.lit("Office &amp; more").alias("field_issuing_office_taxonomy"),
        F.when(k % 5 != 0, F.regexp_replace("p_type", " ", ", ")).alias("topics-product"),
        F.lit("a, ,b").alias("term_node_tid"),
        F.when(k % 2 == 0, " Yes ").otherwise("n/a").alias("open-comment"),
        F.when(k % 7 == 0, F.lit('<a href="http://r/x?d=1">D-1</a>')).otherwise("D-2").alias("field_docket_number"),
        F.concat(F.lit('<time datetime="2021-03-04T05:06:0'), (k % 10).cast("string"), F.lit('Z" class="d">then</time>')).alias("changed"),
    )


def catalog_fields(spark, d):
    """The registry columns of raw rows, and why some are refused."""
    n = C.normalized(_feed(spark, d), "https://x.org/base/page")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return n.select(
        "slug", "title", "landing_url", "pdf_url", "lifecycle_state", "center", F.array_join("topics", "|").alias("topics"), "docket_id", "docket_url",
        day("issue_date"), "open_comment", F.unix_seconds("changed_at").alias("changed_s"), "reject",
    )


def daily_ingestion(spark, d):
    """The changes of a day: the raw feed against a registry of every third slug, one more and one withdrawn."""
    k = F.col("p_partkey")
    raw = _feed(spark, d).withColumn("field_final_guidance_1", F.lit("Final")).withColumn("place", F.monotonically_increasing_id())
    at = F.timestamp_seconds(F.lit(1614834360) + k % 10)
    old = _t(spark, d, "part").where(k % 3 == 0).select(
        k.cast("string").alias("slug"), F.when(k % 6 == 0, "Draft").otherwise("Final").alias("status"), F.lit("active").alias("lifecycle_state"), at.alias("changed_at"), at.alias("first_seen_at"), at.alias("last_seen_at"),
    )
    _, changes, _ = J.daily_run(old, raw, "https://x.org/base/page", F.lit("2025-01-01").cast("timestamp"))
    return changes.select("slug", "change_type", "previous_status", "status")


def _metadata(spark, d, version):
    k = F.col("doc_id")
    return _t(spark, d, "documents").select(
        k.cast("string").alias("slug"), F.coalesce("source", F.lit("none")).alias("title"), version.alias("version_hash"), F.lit("Final").alias("status"), F.lit("active").alias("lifecycle_state"),
        F.when(k % 2 == 0, F.col("lang")).alias("center"), F.lit("office").alias("issuing_office"), F.lit("guide").alias("communication_type"), F.array(F.coalesce("lang", F.lit("-"))).alias("topics"),
        F.concat(F.lit("D-"), (k % 5).cast("string")).alias("docket_number"), F.to_date(F.lit("2024-05-06")).alias("issue_date"), F.concat(F.lit("http://h/"), k.cast("string")).alias("source_url"),
    )


def _indexed(spark, d, version, where="true"):
    """Chunks with metadata of one version of the documents."""
    docs = _docs(spark, d).where(where).select("doc_id", "text", version.alias("version_hash"))
    chunks = D.document_chunks(docs, 2000, 600, 80).withColumns({"slug": F.col("doc_id").cast("string"), "version_hash": version})
    return I.with_metadata(chunks, _metadata(spark, d, version))


def evidence_payloads(spark, d):
    """What is stored of each child beside its text."""
    k = I.keyword_documents(_indexed(spark, d, F.lit("v1")))
    p = F.col("evidence_payload")
    return k.groupBy("slug").agg(
        F.count("*").alias("n"), F.min("doc_title").alias("doc_title"), F.min("center").alias("center"), F.min(F.array_join("topics", "|")).alias("topics"), F.min(p["issue_date"]).alias("issue_date"),
        F.min(p["docket_id"]).alias("docket_id"), F.min(p["source_url"]).alias("source_url"), F.min(p["page"]).alias("page"),
    )


def index_reindexed(spark, d):
    """What is deleted and indexed once a fourth of the documents have new versions, and a ninth are withdrawn."""
    old = _indexed(spark, d, F.lit("v1"))
    fresh = _indexed(spark, d, F.lit("v1"), "doc_id % 4 = 0 AND doc_id % 9 <> 0")
    ids = _docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("slug"), F.lit("v1").alias("version_hash"))
    changed, gone = ids.where("doc_id % 4 = 0 AND doc_id % 9 <> 0"), ids.where("doc_id % 9 = 0")
    dense = I.chunk_rows(old).where("chunk_type = 'child'")
    _, _, outcomes = I.reindexed(dense, I.keyword_documents(old), fresh, changed, gone, F.lit("2025-01-01").cast("timestamp"))
    return outcomes.select("slug", "version_hash", "dense_deleted", "dense_indexed", "keyword_deleted", "keyword_indexed")


def page_slug(spark, d):
    return _t(spark, d, "pages").select("page_id", url_slug(F.col("url")).alias("slug"))


def page_links(spark, d):
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return _t(spark, d, "pages").select("page_id", F.posexplode(found).alias("place", "href"))


def page_title(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return _t(spark, d, "pages").select("page_id", F.nullif(F.trim(title), F.lit("")).alias("title"))


def catalog_normalize(spark, d):
    p = _t(spark, d, "part")
    feed = F.struct(
        F.concat(F.lit('<a href="/docs/'), F.col("p_partkey").cast("string"), F.lit('/">'), F.col("p_name"), F.lit("</a>")).alias("title"),
        F.when(F.col("p_size") % 3 == 0, " Yes ").when(F.col("p_size") % 3 == 1, "no").otherwise("maybe").alias("open_comment"),
        F.regexp_replace("p_type", " ", " , ").alias("topics"),
        F.col("p_brand").alias("center"),
    )
    feeds = p.select(F.concat(F.lit("["), F.to_json(feed), F.lit("]")).alias("value"))
    rows = catalog_rows(feeds, "title string, open_comment string, topics string, center string")
    return rows.select(
        url_slug(F.regexp_extract("title", 'href="([^"]*)"', 1)).alias("slug"),
        F.trim(F.regexp_replace("title", "<[^>]*>", "")).alias("title"),
        yes_no(F.col("open_comment")).alias("open_comment"),
        F.array_join(csv_list(F.col("topics")), "|").alias("topics"),
        F.coalesce("center", F.lit("none")).alias("center"),
    )


def content_landing(spark, d):
    rows = _docs(spark, d).select("doc_id", F.col("source").alias("slug"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size_bytes"))
    old = rows.where("doc_id % 3 = 0")
    new = rows.where("doc_id % 3 <> 0").select("slug", "sha256", "size_bytes")
    return landed(old, new).select("slug", "sha256", "size_bytes", "reused")


QUERIES = {
    f.__name__: f
    for f in (page_offsets, page_of_offset, document_text, section_pages, low_text, section_headings, section_spans, chunk_paragraphs, chunk_windows, chunk_rows, chunk_counts, page_pdf_url, source_choice, artifact_meta, references, catalog_fields, daily_ingestion, evidence_payloads, index_reindexed, page_slug, page_links, page_title, catalog_normalize, content_landing)
}

_PAGES = f"""pages_ AS (SELECT doc_id, CAST(k AS INT) AS page_number, trim(substr(coalesce(text, ''), CAST(k * {PAGE} + 1 AS BIGINT), {PAGE}), ' ') AS t
  FROM documents, unnest(range(0, (greatest(length(coalesce(text, '')), 1) - 1) // {PAGE} + 1)) AS u(k)),
offsets AS (SELECT doc_id, page_number, CAST(coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, length(t) AS n FROM pages_)"""
# white space as the reference rows are stripped of it
_WS = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160))
_HEADED = """h AS (SELECT doc_id, string_split(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN (i - 1) % 10 = 3 THEN chr(9) || chr(160) || ((i - 1) // 10) || '. Part of the text ' || chr(13) || chr(10) || x ELSE x END), chr(10)), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS raw FROM h),
o AS (SELECT doc_id, line_no, trim(raw, @WS) AS line, length(raw) AS n, CAST(coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) - length(ltrim(raw, @WS)) AS BIGINT) AS char_start FROM l),
w AS (SELECT *, regexp_extract(line, '^(?:[IVXLCDM]+|\\d+)[.)]\\s+(\\S.*)$', 1) AS title, len(regexp_split_to_array(line, '\\s+')) AS nw FROM o),
heads AS (SELECT * FROM w WHERE length(line) BETWEEN 1 AND 140 AND CASE
  WHEN regexp_matches(line, '^(?:[IVXLCDM]+|\\d+)[.)]\\s+\\S') THEN len(regexp_split_to_array(title, '\\s+')) <= 10 AND NOT ends_with(title, '.')
  WHEN line = upper(line) AND line <> lower(line) AND nw <= 12 THEN nw > 1 OR line IN ('BACKGROUND', 'INTRODUCTION', 'SCOPE', 'CONCLUSION')
  ELSE regexp_matches(line, '^(?i:introduction|background|scope|recommendations?|conclusion)\\b') END)""".replace("@WS", _WS)

_SPANS = """t AS (SELECT doc_id, array_to_string(ls, chr(10)) AS txt FROM h),
f AS (SELECT doc_id, txt, CAST(length(txt) AS BIGINT) AS doc_end, (SELECT min(char_start) FROM heads WHERE heads.doc_id = t.doc_id) AS f FROM t),
r AS (SELECT doc_id, line AS title, char_start FROM heads UNION ALL SELECT doc_id, CASE WHEN f IS NULL THEN 'Document' ELSE 'Preamble' END, 0 FROM f
  WHERE (f IS NULL OR f > 0) AND trim(CASE WHEN f IS NULL THEN txt ELSE substr(txt, 1, f) END, @WS) <> ''),
spans AS (SELECT r.doc_id, CAST(row_number() OVER s AS INT) AS section_no, title, coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'section-' || row_number() OVER s) AS section_id,
  char_start, coalesce(lead(char_start) OVER s, doc_end) AS char_end FROM r JOIN f ON r.doc_id = f.doc_id WINDOW s AS (PARTITION BY r.doc_id ORDER BY char_start))""".replace("@WS", _WS)
# whole texts are one paragraph each, as they have no blank lines: windows of 1200 characters with 150 in common
_WINDOWS = """WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) - length(ltrim(text, ' ' || chr(10) || chr(9) || chr(13))) AS lo, length(rtrim(text, ' ' || chr(10) || chr(9) || chr(13))) AS hi,
    list_filter(list_transform(string_split(text, ''), lambda c, i: CASE WHEN c IN (' ', chr(10)) THEN i - 1 ELSE -1 END), lambda x: x >= 0) AS br FROM documents WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''),
  w AS (SELECT doc_id, lo AS pos, CASE WHEN hi - lo <= 1200 THEN hi END AS fin, 0 AS k FROM d
    UNION ALL SELECT n.doc_id, n.pos, NULL, k FROM (
      SELECT w.doc_id, k + 1 AS k, CASE WHEN coalesce(list_max(list_filter(br, lambda x: x >= lo AND x < e - 150)) + 1, lo) > w.pos THEN coalesce(list_max(list_filter(br, lambda x: x >= lo AND x < e - 150)) + 1, lo) ELSE e END AS pos
      FROM (SELECT w.doc_id, w.pos, w.k, br, lo, hi, CASE WHEN list_max(list_filter(br, lambda x: x >= lo AND x < w.pos + 1200)) > w.pos + 600 THEN list_max(list_filter(br, lambda x: x >= lo AND x < w.pos + 1200)) ELSE w.pos + 1200 END AS e
        FROM w JOIN d ON w.doc_id = d.doc_id WHERE w.fin IS NULL AND w.pos + 1200 < hi) w) n),
  e AS (SELECT w.doc_id, k, w.pos, t, CASE WHEN w.pos + 1200 >= hi THEN hi WHEN list_max(list_filter(br, lambda x: x >= lo AND x < w.pos + 1200)) > w.pos + 600 THEN list_max(list_filter(br, lambda x: x >= lo AND x < w.pos + 1200)) ELSE w.pos + 1200 END AS e FROM w JOIN d ON w.doc_id = d.doc_id),
  s AS (SELECT doc_id, k, pos, e, substr(t, pos + 1, e - pos) AS b, ' ' || chr(10) || chr(9) || chr(13) AS ws FROM e)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_no, CAST(pos + length(b) - length(ltrim(b, ws)) AS INT) AS char_start, CAST(pos + length(rtrim(b, ws)) AS INT) AS char_end,
    CAST(len(regexp_extract_all(b, '\\S+')) AS INT) AS token_count FROM s WHERE trim(b, ws) <> ''"""

ORACLES = {
    "page_offsets": f"WITH {_PAGES} SELECT doc_id, page_number, char_start, CAST(char_start + n AS BIGINT) AS char_end FROM offsets",
    "page_of_offset": f"""WITH {_PAGES}, p AS (SELECT doc_id, CAST(k AS INT) AS pos FROM documents, unnest(range(0, length(coalesce(text, '')) + 1, 1500)) AS u(k))
      SELECT p.doc_id, pos AS "at", min(page_number) AS page_number FROM p JOIN offsets o ON p.doc_id = o.doc_id AND pos BETWEEN char_start AND char_start + n GROUP BY p.doc_id, pos""",
    "section_headings": f"WITH {_HEADED} SELECT doc_id, CAST(line_no AS INT) AS line_no, line, char_start FROM heads",
    "section_spans": f"WITH {_HEADED}, {_SPANS} SELECT * FROM spans",
    "document_text": f"WITH {_PAGES}, t AS (SELECT doc_id, count(*) AS n, string_agg(t, chr(10) ORDER BY page_number) AS t FROM pages_ GROUP BY doc_id) SELECT doc_id, length(t)::INT AS n_chars, n::INT AS n_pages, sha256(t) AS text_sha256 FROM t",
    "section_pages": f"""WITH {_PAGES}, {_HEADED}, {_SPANS} SELECT s.doc_id, section_no, min(page_number) AS first_page, max(page_number) AS last_page, count(*) AS n_pages FROM spans s JOIN offsets p ON s.doc_id = p.doc_id
      AND NOT (p.char_start + p.n < s.char_start OR p.char_start > s.char_end) GROUP BY s.doc_id, section_no""",
    "low_text": f"WITH {_PAGES} SELECT doc_id, count(*) AS n_pages, round(sum(length(t)) / count(*), 6)::DOUBLE AS chars_per_page, sum(length(t)) < 400 * count(*) AS low FROM pages_ GROUP BY doc_id",
    "chunk_windows": _WINDOWS,
    "page_pdf_url": """SELECT page_id, CASE WHEN first <> '' THEN first WHEN page_id % 3 = 0 THEN 'https://x.org/media/7/download' WHEN page_id % 3 = 1 THEN 'https://x.org/a/docs/A.PDF?x=1' ELSE 'https://x.org/y' END AS pdf_url
      FROM (SELECT page_id, '' AS first FROM pages)""",
    "source_choice": """WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'http://x/' || p_partkey || '.pdf' END AS p, CASE WHEN p_partkey % 5 <> 0 THEN 'http://x/page/' || (p_partkey % 50) END AS l FROM part),
      j AS (SELECT k, coalesce(p, CASE WHEN l IS NOT NULL AND k % 50 > 0 AND k % 50 % 3 = 0 THEN 'http://x/of-page.pdf' END) AS p, l FROM r)
      SELECT CAST(k AS VARCHAR) AS slug, coalesce(p, l) AS url, CASE WHEN p IS NOT NULL THEN 'raw_pdf' WHEN l IS NOT NULL THEN 'raw_html' END AS artifact_kind, CASE WHEN p IS NOT NULL THEN 'pdf' WHEN l IS NOT NULL THEN 'html' ELSE 'bin' END AS extension FROM j""",
    "artifact_meta": """SELECT CAST(doc_id AS VARCHAR) AS slug, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::INT AS size_bytes,
      'raw/' || doc_id || '/' || sha256(coalesce(text, '')) || '.' || CASE WHEN doc_id % 2 = 0 THEN 'pdf' WHEN doc_id % 3 = 0 THEN 'docx' ELSE 'bin' END AS object_key, CASE WHEN doc_id % 2 = 0 THEN 'application/pdf' ELSE 'application/octet-stream' END AS content_type FROM documents""",
    "references": """SELECT doc_id, '21 CFR 314.50|' || (doc_id % 9 + 1) || ' CFR Part 11' AS cfr, CASE WHEN doc_id % 2 = 0 THEN 'QAB' ELSE 'XYZ' END AS codes FROM documents""",
    "catalog_fields": """SELECT CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS slug, CASE WHEN p_partkey % 17 <> 0 THEN p_name || ' & co' ELSE p_name END AS title, CASE WHEN p_partkey % 17 <> 0 THEN 'https://x.org/docs/' || p_partkey || '/' END AS landing_url,
      CASE WHEN p_partkey % 2 = 0 THEN 'https://x.org/base/media/' || p_partkey || '/download' END AS pdf_url, 'active' AS lifecycle_state, CASE WHEN p_partkey % 3 = 0 THEN 'Office & more' ELSE p_brand END AS center,
      CASE WHEN p_partkey % 5 <> 0 THEN replace(p_type, ' ', '|') ELSE 'a|b' END AS topics, CASE WHEN p_partkey % 7 = 0 THEN 'D-1' ELSE 'D-2' END AS docket_id, CASE WHEN p_partkey % 7 = 0 THEN 'http://r/x?d=1' END AS docket_url,
      CASE WHEN p_partkey % 19 <> 0 THEN '2021-' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '-07' END AS issue_date, CASE WHEN p_partkey % 2 = 0 THEN true END AS open_comment, 1614834360 + p_partkey % 10 AS changed_s,
      CASE WHEN p_partkey % 17 = 0 THEN 'no title link' WHEN p_partkey % 19 = 0 THEN 'issue date' END AS reject FROM part""",
    "daily_ingestion": """WITH n AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0), o AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN 'Draft' ELSE 'Final' END AS s FROM part WHERE p_partkey % 3 = 0),
      c AS (SELECT CAST(coalesce(n.k, o.k) AS VARCHAR) AS slug, CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'withdrawn' WHEN s <> 'Final' THEN 'updated' END AS change_type, s AS previous_status, CASE WHEN n.k IS NULL THEN s ELSE 'Final' END AS status FROM n FULL JOIN o ON n.k = o.k)
      SELECT * FROM c WHERE change_type IS NOT NULL""",
    "chunk_paragraphs": """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
      x AS (SELECT doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS raw FROM l),
      y AS (SELECT *, coalesce(sum(length(raw) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, trim(raw) AS t FROM x)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS paragraph_no, CAST(pos + length(raw) - length(ltrim(raw)) AS BIGINT) AS char_start,
        CAST(pos + length(rtrim(raw)) AS BIGINT) AS char_end, len(regexp_split_to_array(t, '\\s+'))::INT AS token_count FROM y WHERE t <> ''""",
    "page_slug": "SELECT page_id, nullif(list_last(string_split(rtrim(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/'), '/')), '') AS slug FROM pages",
    "page_links": """WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)
      SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INT) AS place, unnest(h) AS href FROM l""",
    "page_title": "SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title FROM pages",
    "catalog_normalize": """SELECT CAST(p_partkey AS VARCHAR) AS slug, trim(p_name) AS title, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS open_comment,
      replace(p_type, ' ', '|') AS topics, coalesce(p_brand, 'none') AS center FROM part""",
    "content_landing": """WITH r AS (SELECT doc_id, source AS slug, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::INT AS size_bytes FROM documents)
      SELECT DISTINCT slug, sha256, size_bytes, EXISTS (SELECT 1 FROM r o WHERE o.doc_id % 3 = 0 AND o.slug = r.slug AND o.sha256 = r.sha256) AS reused FROM r WHERE doc_id % 3 <> 0""",
}
