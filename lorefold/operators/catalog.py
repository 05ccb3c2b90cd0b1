"""Catalog rows: links, dates and fields of raw feed rows; source files of landing pages."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorefold.functions import csv_list, url_slug, yes_no

# The raw feed's field names
RAW = (
    "title field_associated_media_2 field_issue_datetime field_issuing_office_taxonomy field_health_topics term_node_tid field_topics"
    " topics-product field_final_guidance_1 open-comment field_comment_close_date field_docket_number field_communication_type field_center"
    " field_regulated_product_field changed"
).split()
RAW_SCHEMA = ", ".join(f"`{c}` string" for c in RAW)


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def _text(fragment: Column) -> Column:
    """Text of markup, its parts joined by one space; blank is null."""
    parts = F.filter(F.transform(F.split(fragment, "<[^>]*>"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    return F.nullif(F.array_join(parts, " "), F.lit(""))


def resolve_url(href: Column, base: str) -> Column:
    """href against a base address: absolute, by scheme, by root, or beside the base's last segment."""
    scheme, _, rest = base.partition("://")
    root = f"{scheme}://{rest.split('/', 1)[0]}"
    folder = base.rsplit("/", 1)[0] + "/" if "/" in rest else f"{base}/"
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(f"{scheme}:"), href))
        .when(href.startswith("/"), F.concat(F.lit(root), href))
        .when(href.startswith("?") | href.startswith("#"), F.concat(F.lit(base), href))
        .otherwise(F.concat(F.lit(folder), href))
    )


_ANCHOR = r"(?is)<a\b([^>]*)>(.*?)(?:</a\s*>|\z)"
_HREF = r"""(?i)(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _href(attributes: Column) -> Column:
    found = [F.nullif(F.regexp_extract(attributes, _HREF, k), F.lit("")) for k in (1, 2, 3)]
    return F.coalesce(*found)


def link(fragment: Column, base: str) -> Column:
    """struct(text, url) of an unescaped fragment's first anchor; without an anchor the text alone."""
    has = fragment.rlike(_ANCHOR)
    text = F.when(has, _text(F.regexp_extract(fragment, _ANCHOR, 2))).otherwise(_text(fragment))
    url = F.when(has, resolve_url(_href(F.regexp_extract(fragment, _ANCHOR, 1)), base))
    return F.struct(text.alias("text"), url.alias("url"))


def time_of(fragment: Column) -> Column:
    """The datetime attribute of the first time element, else the text."""
    stamp = F.regexp_extract(fragment, r"""(?is)<time\b[^>]*\bdatetime\s*=\s*["']([^"']*)["']""", 1)
    body = F.regexp_extract(fragment, r"(?is)<time\b[^>]*>(.*?)</time", 1)
    return F.coalesce(F.nullif(stamp, F.lit("")), _text(F.when(fragment.rlike(r"(?i)<time\b"), body).otherwise(fragment)))


def normalized(rows: DataFrame, base: str) -> DataFrame:
    """The 17 registry columns of raw rows (columns RAW), with raw_payload as JSON, and reject: why a row is refused, or null.

    A row is refused without a title's text or link, without a last path segment, or with a date or time of another form.
    """
    given = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c in rows.columns else F.lit(None).cast("string") for c in RAW]
    raw = rows.select(
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("raw_payload"),
        *[unescaped(g).alias(c) for g, c in zip(given, RAW, strict=True)],
    )
    c = {n: F.col(f"`{n}`") for n in RAW}
    clean = lambda n: _text(c[n])
    d = raw.select(
        "raw_payload",
        link(c["title"], base).alias("t"),
        link(c["field_associated_media_2"], base)["url"].alias("pdf_url"),
        link(c["field_docket_number"], base).alias("d"),
        clean("field_final_guidance_1").alias("status"),
        F.coalesce(clean("field_center"), clean("field_issuing_office_taxonomy")).alias("center"),
        clean("field_communication_type").alias("communication_type"),
        csv_list(_text(F.coalesce(c["topics-product"], c["term_node_tid"]))).alias("topics"),
        clean("field_regulated_product_field").alias("regulated_product"),
        yes_no(clean("open-comment")).alias("open_comment"),
        clean("field_issue_datetime").alias("issued"),
        clean("field_comment_close_date").alias("closes"),
        time_of(c["changed"]).alias("stamp"),
    )
    day = lambda n: F.try_to_date(n, "M/d/yyyy")
    moment = F.try_to_timestamp("stamp")
    slug = url_slug(F.col("t.url"))
    bad = (
        F.when(F.col("t.text").isNull() | F.col("t.url").isNull(), "no title link")
        .when(slug.isNull(), "no slug")
        .when(F.col("issued").isNotNull() & day("issued").isNull(), "issue date")
        .when(F.col("closes").isNotNull() & day("closes").isNull(), "comment date")
        .when(F.col("stamp").isNotNull() & moment.isNull(), "changed time")
    )
    return d.select(
        slug.alias("slug"), F.col("t.text").alias("title"), F.col("t.url").alias("landing_url"), "pdf_url", "status",
        F.lit("active").alias("lifecycle_state"), "center", "communication_type", "topics", "regulated_product",
        F.col("d.text").alias("docket_id"), F.col("d.url").alias("docket_url"), day("issued").alias("issue_date"),
        day("closes").alias("comment_close_date"), "open_comment", moment.alias("changed_at"), "raw_payload", bad.alias("reject"),
    )


def pdf_links(pages: DataFrame, base: str, page_id: str = "page_id", markup: str = "html") -> DataFrame:
    """(page id, pdf_url): the first anchor whose path ends in .pdf or /download, or whose text has pdf in it."""
    anchors = F.regexp_extract_all(F.col(markup), F.lit(r"(?is)(<a\b[^>]*>.*?)(?=</a\s*>|\z)"), F.lit(1))

    def wanted(a: Column) -> Column:
        path = F.lower(F.regexp_extract(_href(F.regexp_extract(a, r"(?is)<a\b([^>]*)>", 1)), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1))
        named = F.lower(F.coalesce(_text(a), F.lit(""))).contains("pdf")
        href = _href(F.regexp_extract(a, r"(?is)<a\b([^>]*)>", 1))
        return href.isNotNull() & (path.endswith(".pdf") | path.endswith("/download") | named)

    first = F.get(F.filter(anchors, wanted), F.lit(0))
    return pages.select(page_id, resolve_url(_href(F.regexp_extract(first, r"(?is)<a\b([^>]*)>", 1)), base).alias("pdf_url"))


def sources(registry: DataFrame, landing: DataFrame) -> DataFrame:
    """(slug, url, artifact_kind) of registry (slug, pdf_url, landing_url) with landing (landing_url, page_pdf_url) pages.

    The row's own PDF, else its page's, else the page; without either the row has no url.
    """
    j = registry.join(landing.hint("merge"), "landing_url", "left")
    pdf = F.coalesce("pdf_url", "page_pdf_url")
    kind = F.when(pdf.isNotNull(), "raw_pdf").when(F.col("landing_url").isNotNull(), "raw_html")
    return j.select("slug", F.coalesce(pdf, "landing_url").alias("url"), kind.alias("artifact_kind"))


def extension(content_type: Column, kind: Column, url: Column) -> Column:
    """pdf, html, or the address's own ending, or bin."""
    plain = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("application/octet-stream")), ";", 1)))
    ending = F.regexp_extract(F.lower(url), r"^[^?#]*/[^/?#]*[^/?#.]\.([a-z0-9]+)(?:[?#]|$)", 1)
    return (
        F.when((plain == "application/pdf") | kind.eqNullSafe("raw_pdf"), "pdf")
        .when(plain.isin("text/html", "application/xhtml+xml") | kind.eqNullSafe("raw_html"), "html")
        .otherwise(F.coalesce(F.nullif(ending, F.lit("")), F.lit("bin")))
    )


def seeds(registry: DataFrame, limit: int) -> DataFrame:
    """The first rows, by slug, that have a PDF: a top-k report; none at all is an error."""
    found = registry.where(F.trim("pdf_url") != "").orderBy("slug").limit(limit)
    if found.isEmpty():
        raise ValueError("no document has a PDF")
    return found


def by_titles(registry: DataFrame, titles: list[str]) -> DataFrame:
    """Rows whose raw payload has one of the titles."""
    return registry.where(F.get_json_object("raw_payload", "$.title").isin(*titles))
