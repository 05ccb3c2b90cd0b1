"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased code points with every non-letter read as a space; the n-grams of orders 1 to 3 are
hashed to buckets. Fitting counts buckets by language over a bounded sample of labelled rows (max_train rows
in expectation, chosen by a hash of the id; all rows when there are fewer). Prediction broadcasts the
log-probability matrix (languages x buckets, a fixed size) and sums its rows over whole texts with numpy.

Edge cases: a null text or a text without a letter gives `und` with score 0.0; rows with a null label or text
are not learned from; with no labelled row at all every prediction is `und`; ties go to the first language by
code point; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.llm.bytetext import buffers, code_points, mix, slices
from lorefold.llm.shared import free_names, id_remainder

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_TRAIN = 30_000
UNKNOWN = "und"
_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    prior: np.ndarray


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _features(data: np.ndarray, offs: np.ndarray):
    """Yields (buckets, valid) for each order, by code point, after (letters, first code point of each row)."""
    first = np.concatenate(([0], np.cumsum(code_points(data))))[offs]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    letters = _letters()[np.minimum(points, 0x10FFFF)]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))

    def grams():
        hashed, valid = np.zeros(len(letters), np.uint64), np.ones(len(letters), bool)
        for n in range(max(ORDERS)):
            moved = letters[n:].astype(np.uint64) * _KEYS[n]
            hashed = hashed[: len(moved)] + moved
            valid = valid[: len(moved)] & (row[n:] == row[: len(moved)])
            if n + 1 in ORDERS:
                yield (mix(hashed + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32), valid

    return letters, first, grams


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_train: int = MAX_TRAIN
) -> Model:
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(doc_id).alias("i"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    total = rows.count()
    if total > max_train:
        rows = rows.where(F.pmod(F.xxhash64("i", F.lit(8)), F.lit(1 << 20)) < int(max_train / total * (1 << 20)))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for batch in batches:
            data, offs = buffers(batch.column("t"))
            labels = batch.column("l").to_pylist()
            for a, b in slices(offs):
                part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                letters, first, grams = _features(part, o)
                label_of = {x: k for k, x in enumerate(dict.fromkeys(labels[a:b]))}
                codes = np.repeat(np.array([label_of[x] for x in labels[a:b]], np.int64), np.diff(first))
                for bucket, valid in grams():
                    flat = np.bincount(
                        (codes[: len(bucket)] * BUCKETS + bucket)[valid], minlength=len(label_of) * BUCKETS
                    ).reshape(-1, BUCKETS)
                    for x, k in label_of.items():
                        sums[x] = sums.get(x, 0) + flat[k]
                for x in labels[a:b]:
                    n_docs[x] = n_docs.get(x, 0) + 1
        for x, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1).astype(np.int32)),
                 pa.array(np.append(counts[at], n_docs[x]).astype(np.int64))], ["l", "b", "n"])

    table = rows.select("l", "t").mapInArrow(count, "l string, b int, n long")
    got = table.groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    languages = sorted(got["l"].unique())
    counts, prior = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    for k, x in enumerate(languages):
        own = got[got["l"] == x]
        real = own["b"] >= 0
        counts[own["b"][real], k] = own["n"][real]
        prior[k] = own["n"][~real].sum()
    log_prob = np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * BUCKETS)
    prior = np.log(prior / prior.sum()) if len(languages) else prior
    return Model(languages, log_prob.astype(np.float32), prior)


def predict(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """The keep columns with, under names, the prediction (string) and its posterior (double, 0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prob, model.prior))
    kept = docs.select(*dict.fromkeys([*keep, text]))
    schema = docs.select(*keep).withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema

    def score(batches):
        languages, log_prob, prior = sent.value
        for batch in batches:
            data, offs = buffers(batch.column(text))
            pred, conf = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for a, b in slices(offs) if languages else ():
                part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                letters, first, grams = _features(part, o)
                full = np.flatnonzero(np.diff(first))
                if not len(full):
                    continue
                total = np.tile(prior, (len(full), 1))
                for bucket, valid in grams():
                    value = log_prob[bucket]
                    value[~valid] = 0
                    value = np.concatenate((value, np.zeros((len(letters) - len(value), len(prior)), np.float32)))
                    total += np.add.reduceat(value, first[full], axis=0, dtype=np.float64)
                some = np.add.reduceat((letters > 0).astype(np.int64), first[full]) > 0
                best = total.argmax(1)
                odds = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for r, k, p, ok in zip(full + a, best, odds, some, strict=True):
                    if ok:
                        pred[r], conf[r] = languages[k], p
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(pred, pa.string()), pa.array(conf)], [*keep, *names]
            )

    return kept.mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 3) == 1


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=("doc_id", "held_out"))


def identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """documents without those whose language cannot be told: no text, no letter, or a posterior under least_score."""
    columns = docs.columns
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    names = tuple(free_names(docs, "language", "posterior"))
    told = predict(docs, model, keep=tuple(columns), names=names)
    return told.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least_score)).select(*columns)
