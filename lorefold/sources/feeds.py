"""Catalog feeds of any size: one JSON file is read by many tasks.

Spark's text reader cuts a file into byte ranges and into fragments behind each "}". What a fragment means depends on what comes before it:
whether it begins within a string, and how deep. Each task counts a fragment's quotes that are not escaped, and the change
of depth for either case. Running sums over the ranges of a file, carried from range to range, then tell every fragment's own
state: the parity of the quotes before it says which case holds, the sum of the depth changes how deep it ends. An object ends where the
depth comes back to that of the list; fragments are put together by the number of ends before them, so that a task
holds one object at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorefold.sources.tables import discard, written

_QUOTED = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z)', re.DOTALL)
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)


def _depth(text: str) -> int:
    """The change of depth by what is outside of strings; text begins outside."""
    bare = _QUOTED.sub("", text)
    return bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")


def fragment_facts(text: str) -> tuple[int, int, int, bool, bool]:
    """(quotes, depth if begun outside a string, depth if begun within, whether the last character is outside in either case)."""
    escaped = re.sub(r"\\.", "", text, flags=re.DOTALL)
    quotes = escaped.count('"')
    end = _REST.match(text)
    return quotes, _depth(text), _depth(text[end.end() :]) if end else 0, quotes % 2 == 0, quotes % 2 == 1


def _running(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """rows with out: the sum of value over the file's fragments before this one; a window a range, and what earlier ranges carry."""
    inside = Window.partitionBy("path", "start").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("path", "start").agg(F.sum(value).alias("t"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carry = totals.select(F.col("path").alias("_path"), F.col("start").alias("_start"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_carry"))
    local = rows.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    j = local.join(carry.hint("merge"), (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")))
    return j.select(*rows.columns, (F.col(out) + F.col("_carry")).alias(out))


def feed_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, value): the objects of JSON files in their order, as text: of a list, of the list under "data", or one after another.

    What is no object is left out; a file that is cut off gives the objects before its end. Objects within a list within the
    list are not told apart.
    """
    lines = spark.read.option("lineSep", "}").text(path)
    raw = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("no"), F.concat("value", F.lit("}")).alias("text"))

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [fragment_facts(t) for t in b["text"]]
            yield b.assign(**{c: [f[k] for f in found] for k, c in enumerate(("quotes", "d0", "d1", "out0", "out1"))})

    kinds = "path string, start long, no long, text string, quotes long, d0 long, d1 long, out0 boolean, out1 boolean"
    rows = written(raw.mapInPandas(facts, kinds), "feed-fragments")
    head = rows.groupBy("path").agg(F.min_by("text", F.struct("start", "no")).alias("head"))
    base = F.when(F.col("head").rlike(r"^\s*\["), 1).when(F.col("head").rlike(r'^\s*\{\s*"data"\s*:\s*\['), 2).otherwise(0)
    head = written(head.select("path", base.alias("base")), "feed-heads")
    rows_ = _running(rows, F.col("quotes"), "before")
    inside = F.col("before") % 2 == 1
    rows_ = written(rows_.withColumns({"delta": F.when(inside, F.col("d1")).otherwise(F.col("d0")), "ends": F.when(inside, F.col("out1")).otherwise(F.col("out0"))}).select("path", "start", "no", "text", "delta", "ends"), "feed-states")
    deep = _running(rows_, F.col("delta"), "depth").join(head.hint("merge"), "path")
    closed = F.col("ends") & (F.col("depth") + F.col("delta") == F.col("base")) & F.col("text").endswith("}")
    deep = written(deep.withColumn("closed", closed.cast("long")).select("path", "start", "no", "text", "closed"), "feed-ends")
    placed = _running(deep, F.col("closed"), "place")
    one = placed.groupBy("path", "place").agg(F.max("closed").alias("closed"), F.array_sort(F.collect_list(F.struct("start", "no", "text")))["text"].alias("parts"))
    text = F.array_join("parts", "")
    bare = F.regexp_replace(text, r'^(?:[^{"]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+', "")
    # the wrapper of a list under "data" stands before the first object
    bare = F.when(bare.rlike(r'^\{\s*"data"\s*:\s*\['), F.regexp_replace(F.regexp_replace(bare, r'^\{\s*"data"\s*:\s*\[', ""), r'^(?:[^{"]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+', "")).otherwise(bare)
    out = written(one.where("closed = 1").select("path", "place", bare.alias("value")).where("value LIKE '{%'"), "feed-objects")
    discard(rows, head, rows_, deep)
    return out


def catalog_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the feeds at a path: objects become columns of schema, beside path, place and raw (their text)."""
    rows = feed_objects(spark, path)
    return rows.select("path", "place", F.from_json("value", schema).alias("r"), F.col("value").alias("raw")).select("path", "place", "r.*", "raw")
