"""Sources and sinks: catalog feeds, landed content, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefold.operators.catalog import extension


def salvage(text: str) -> Iterator[str]:
    """JSON objects of a text that is a list, a {"data": [...]} object, or objects one after another."""
    decoder, at = json.JSONDecoder(), 0
    stripped = text.strip()
    try:
        whole = json.loads(stripped)
    except ValueError:
        whole = None
    if isinstance(whole, dict) and isinstance(whole.get("data"), list):
        whole = whole["data"]
    if isinstance(whole, list):
        yield from (json.dumps(x) for x in whole if isinstance(x, dict))
        return
    stripped = stripped.lstrip("[")
    while at < len(stripped):
        if stripped[at] in " \t\r\n,":
            at += 1
        elif stripped[at] == "]":
            return
        else:
            value, at = decoder.raw_decode(stripped, at)
            if isinstance(value, dict):
                yield json.dumps(value)


def catalog_rows(feeds: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """Rows of catalog feeds, one feed text a row; objects become columns of schema."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"raw": pd.Series([x for t in b[text] if t for x in salvage(t)], dtype=object)})

    raw = feeds.select(text).mapInPandas(split, "raw string")
    return raw.select(F.from_json("raw", schema).alias("r"), "raw").select("r.*", "raw")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(object_key, sha256, size_bytes) of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("object_key"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def landed(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (slug, sha256) once each, with reused: whether the artifact is known already."""
    known = existing.select("slug", "sha256").distinct().withColumn("reused", F.lit(True))
    return incoming.dropDuplicates(["slug", "sha256"]).join(known.hint("merge"), ["slug", "sha256"], "left").fillna({"reused": False})


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object a row, keys in order."""
    report.select(F.to_json(F.struct(*sorted(report.columns))).alias("value")).write.mode("errorifexists").text(path)


def write_daily_report(report: DataFrame, root: str, date: str) -> str:
    """A day's report (date as yyyy-MM-dd) under its key; a report of that day is never overwritten."""
    target = f"{root}/reports/daily-updates/{date}.json"
    write_report(report, target)
    return target


def write_snapshot(feeds: DataFrame, path: str, stamp: str) -> str:
    """A raw feed kept as it came, by its UTC time (yyyyMMddTHHmmssZ); a snapshot of that time is never overwritten."""
    target = f"{path}/catalog/{stamp}.json"
    feeds.select("value").write.mode("errorifexists").text(target)
    return target


def artifact_lookup(artifacts: DataFrame, slug: str, version_hash: str) -> DataFrame:
    """The raw files of one version of a document."""
    kinds = F.col("artifact_kind").isin("raw_pdf", "raw_html")
    return artifacts.where((F.col("document_slug") == slug) & (F.col("version_hash") == version_hash) & kinds)


def artifact_rows(contents: DataFrame) -> DataFrame:
    """(slug, sha256, size_bytes, object_key, content_type) of contents (slug, content, content_type, artifact_kind, url)."""
    digest = F.sha2("content", 256)
    kind = F.coalesce("content_type", F.lit("application/octet-stream"))
    key = F.concat(F.lit("raw/"), "slug", F.lit("/"), digest, F.lit("."), extension(F.col("content_type"), F.col("artifact_kind"), F.col("url")))
    return contents.select("slug", digest.alias("sha256"), F.octet_length("content").alias("size_bytes"), key.alias("object_key"), kind.alias("content_type"))


def write_exports(exports: DataFrame, path: str) -> None:
    """Texts of exports (export_id, text) under path/exports, one folder an id."""
    rows = exports.where("text IS NOT NULL").select("export_id", F.col("text").alias("value"))
    rows.write.mode("errorifexists").partitionBy("export_id").text(f"{path}/exports")
