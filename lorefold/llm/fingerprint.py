"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

A text's set is its distinct runs of five words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased; a shorter text is one
run). Each run is hashed once; the top bits choose one of BINS bins and the bin keeps its least remainder. An
empty bin j takes the value of the first non-empty bin in a sequence of bins hashed from j and the attempt, the
same for all texts, so that filled bins still agree with the texts' likeness; after ATTEMPTS attempts it takes
the non-empty bin of the least hash with j. The low BITS bits of the bins are packed and written as base64.
The likeness of two fingerprints corrects the share of agreeing bins for chance agreements of 2**-BITS.

Edge cases: null counts as an empty text; a text without words has the empty fingerprint, whose likeness is 1
to another empty one and 0 to any other; equal texts have equal fingerprints; very long texts are read whole.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.llm.bytetext import (
    SLICE_BYTES,
    buffers,
    code_points,
    lowered,
    mix,
    shingle_hashes,
    slices,
    word_hashes,
    word_spans,
)
from lorefold.llm.shared import partitions

BINS, BITS, ATTEMPTS = 512, 4, 24
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_EMPTY = np.uint64(2**64 - 1)
_BIN = np.arange(BINS, dtype=np.uint64)
_NEXT = [(mix(_BIN * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)) >> _SHIFT).astype(np.int64) for t in range(1, ATTEMPTS + 1)]
_SALT = mix(_BIN + np.uint64(1 << 40))
_PAIR = mix((_BIN[:, None] << np.uint64(20)) | _BIN[None, :] | np.uint64(1 << 62))


def sketches(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x BINS array of BITS-bit values, whether the row has words) of texts as bytes and offsets."""
    rows = len(offs) - 1
    data = lowered(data)
    starts, ends, counts = word_spans(data, offs)
    hashes, counts = shingle_hashes(word_hashes(data, starts, ends), counts)
    bins = np.full(rows * BINS, _EMPTY)
    at = np.repeat(np.arange(rows) * BINS, counts) + (hashes >> _SHIFT).astype(np.int64)
    np.minimum.at(bins, at, mix(hashes) >> np.uint64(1))
    bins = bins.reshape(rows, BINS)
    some = counts > 0
    filled = bins.copy()
    r, j = np.nonzero((bins == _EMPTY) & some[:, None])
    for choice in _NEXT:
        value = bins[r, choice[j]]
        filled[r, j] = value
        left = value == _EMPTY
        r, j = r[left], j[left]
        if not len(r):
            break
    for row in np.unique(r).tolist():
        full, own = np.flatnonzero(bins[row] != _EMPTY), j[r == row]
        filled[row, own] = bins[row, full[_PAIR[own][:, full].argmin(1)]]
    filled = mix(filled ^ _SALT)  # so that one value copied to many bins agrees by chance in each bin anew
    return (filled & np.uint64((1 << BITS) - 1)).astype(np.uint8), some


def packed(values: np.ndarray, some: np.ndarray) -> list[str]:
    per = 8 // BITS
    parts = values.reshape(len(values), BINS // per, per)
    joined = np.zeros(parts.shape[:2], np.uint8)
    for k in range(per):
        joined |= parts[:, :, k] << np.uint8(BITS * k)
    return [base64.b64encode(row.tobytes()).decode() if ok else "" for row, ok in zip(joined, some, strict=True)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    chance = 2.0**-BITS
    value = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, value, np.where(some_a == some_b, 1.0, 0.0))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns with fingerprint string, for every row; no shuffle."""
    schema = docs.select(*keep, F.lit("").alias("fingerprint")).schema

    def make(batches):
        for batch in batches:
            data, offs = buffers(batch.column(text))
            out: list[str] = []
            for a, b in slices(offs):
                out += packed(*sketches(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(make, schema)


def in_runs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (run, tail, id, t) ordered within partitions: runs of ascending ids, each closed by its next run's first row.

    The runs' limits are quantiles of the ids, so that they hold about as many rows each; the closing row of the
    last run is the first of all. What the driver sees is one row a run.
    """
    spark = docs.sparkSession
    runs = 4 * partitions(spark)
    ids = docs.select(F.col(doc_id).cast("double").alias("_id"))
    cuts = ids.agg(F.percentile_approx("_id", [k / runs for k in range(1, runs)], 20 * runs)).first()[0] or []
    splits = [-float("inf"), *sorted({*cuts} or {0.0}), float("inf")]
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.coalesce(F.col(doc_id).cast("double"), F.lit(float("-inf"))).alias("_id"))
    dealt = Bucketizer(splits=splits, inputCol="_id", outputCol="run")
    rows = dealt.transform(rows).select(F.col("run").cast("int").alias("run"), "id", "t")
    heads = dealt.transform(ids.fillna(float("-inf"))).groupBy("run").agg(F.min("_id").alias("head")).collect()
    heads = sorted((int(h["run"]), h["head"]) for h in heads)
    if not heads:
        return rows.withColumn("tail", F.lit(False))
    before = {run: heads[k - 1][0] for k, (run, _) in enumerate(heads)}
    table = spark.createDataFrame([(r, h, before[r]) for r, h in heads], "run int, head double, to int")
    first = F.coalesce(F.col("id").cast("double"), F.lit(float("-inf"))) == F.col("head")
    to = F.when(first, F.array(F.struct("run", F.lit(False).alias("tail")), F.struct(F.col("to").alias("run"), F.lit(True).alias("tail"))))
    to = to.otherwise(F.array(F.struct("run", F.lit(False).alias("tail"))))
    rows = rows.join(F.broadcast(table), "run").select("id", "t", F.inline(to))
    rows = rows.repartition(partitions(spark), "run")
    return rows.sortWithinPartitions("run", "tail", F.col("id").asc_nulls_first(), F.col("t").asc_nulls_first())


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    The edited text is the text with its last floor(n/2) code points replaced by as many first ones (or all) of
    the next row by (id, text), nulls first; after the last row comes the first.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def block(run, tail, ids, data, offs):
        """Output of all rows but the last, each with the row after it; tails are no rows of their own."""
        points = np.flatnonzero(code_points(data))
        first = np.searchsorted(points, offs)
        size = np.diff(first)
        bounds = np.append(points, len(data))
        keep = first[:-1] + size - size // 2
        own_end = bounds[keep]
        take = first[1:-1] + np.minimum(size[:-1] // 2, size[1:])
        next_end = bounds[take]
        raw = data.tobytes()
        pick = np.flatnonzero(~tail[:-1])
        if not len(pick):
            return None
        edited = [
            raw[a:b] + raw[c:d]
            for a, b, c, d in zip(offs[pick].tolist(), own_end[pick].tolist(), offs[pick + 1].tolist(), next_end[pick].tolist(), strict=True)
        ]
        values, some = sketches(data, offs)
        joined = np.frombuffer(b"".join(edited), np.uint8)
        e_values, e_some = sketches(joined, np.concatenate(([0], np.cumsum([len(x) for x in edited]))))
        names = np.array(packed(values, some), object)
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(pick)).cast(pa.int64()),
                pa.array(size[pick]),
                pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                pa.array(names[pick], pa.string()),
                pa.array(packed(e_values, e_some), pa.string()),
                pa.array(likeness(values[pick], some[pick], e_values, e_some)),
                pa.array(likeness(values[pick], some[pick], values[pick + 1], some[pick + 1])),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def make(batches):
        last = None
        for batch in batches:
            batch = batch.select(["run", "tail", "id", "t"])
            if last is not None:
                table = pa.Table.from_batches([last, batch]).combine_chunks()
                batch = table.to_batches()[0] if table.num_rows else batch
            if not batch.num_rows:
                continue
            data, offs = buffers(batch.column("t"))
            run, tail = np.asarray(batch.column("run")), np.asarray(batch.column("tail").to_numpy(zero_copy_only=False))
            for a, b in slices(offs, SLICE_BYTES // 2):
                b = min(b + 1, batch.num_rows)
                out = block(run[a:b], tail[a:b], batch.column("id").slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                if out is not None:
                    yield out
            last = batch.slice(batch.num_rows - 1)

    return in_runs(docs, doc_id, text).mapInArrow(make, schema)


def op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
