"""Ranked lexical search by hashed max-sketches: exact top documents of many queries by upper bounds and descending rescoring.

Terms are the maximal runs of letters, digits and non-ASCII code points, A-Z lower-cased. N documents have terms, L is the number of all their
terms, n a document's, df the documents holding a term, tf its occurrences in one. w = floor(1000 ln((2N+2)/(2df+1))),
m = 50 + (50 n N) div L, and a document's score sums w * ((10^9 tf) div (1000 tf + 20 m)) over the query's distinct terms.

Index, made in one pass over whole texts: for each document an array of cells, about 8 to 16 a distinct term, into which each term
folds its tf at two hashed places by maximum (over 200 as a code, rounded up); and each term's df, in buckets of hashes. A term's
share of the score grows with tf, so the lesser of its two cells gives an upper bound of it, and cells that other terms have raised
only loosen the bound. Nothing of the corpus statistics is in the sketches: they hold however N, L and df are.

Search, in blocks of items, which alone are sent to all tasks: each task looks the block's terms up in its sketches, many
documents at once, and sums the bounds by item. Each item's candidates of highest bound are rescored exactly from their whole
texts; the k-th exact score is the threshold. Then the pairs whose bound reaches the threshold are written, and rescored in
batches of descending bound, each raising the threshold, until no bound reaches it. So no document is left out that could enter.

Edge cases: null and empty texts, and texts without terms, are not counted in N and found by no item; an item without terms, or
whose terms no document holds, has no rows; rows that repeat an id are documents of their own, and equal rows are each
returned; equal scores come by ascending doc_id, a null id first; items that repeat an id are ranked each for itself; empty
tables give an empty result; other columns are ignored. Terms are identified by 64-bit hashes.
"""

from __future__ import annotations

from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorefold.llm.bytetext import buffers, lowered, slices, word_hashes, word_spans
from lorefold.llm.katz import bucket_of, packed, unpacked
from lorefold.llm.shared import discard, partitions, written

TOP, BLOCK = 50, 256  # documents an item; items a block
CELLS = 8  # cells a distinct term, at least
HELD = 1_500_000  # term occurrences by document whose documents a task counts at once
BUCKET_CHARS = 48 << 20  # of texts, about, whose terms share a bucket
FEW = 300_000  # rows of (row, items) that are sent to all tasks
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: The greatest tf that a cell's code stands for.
DECODED = np.array([*range(201), *(int(np.ceil(200 * 2 ** (k / 4))) for k in range(1, 55)), 10**9], np.int64)


def terms_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, tf) of each row's distinct terms, rows one after another, and each row's number of them and of its terms."""
    part = lowered(data)
    starts, ends, n = word_spans(part, offs, _TERM[part])
    hashes = word_hashes(part, starts, ends)
    last = np.cumsum(n)
    for a, b in zip((last - n).tolist(), last.tolist(), strict=True):
        hashes[a:b].sort()
    row = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    return hashes[head], np.diff(np.append(head, len(hashes))), np.bincount(row[head], minlength=len(n)), n


def places(hashes: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each term in a sketch of size cells, a power of two."""
    size = np.asarray(size, np.uint64) - np.uint64(1)
    return (hashes & size).astype(np.int64), ((hashes >> np.uint64(32)) & size).astype(np.int64)


def sketched(hashes: np.ndarray, tf: np.ndarray, distinct: np.ndarray) -> list[bytes]:
    """Each row's cells: the greatest code of tf of the terms that fall there."""
    code = np.searchsorted(DECODED, tf).astype(np.uint8)
    size = 1 << np.ceil(np.log2(np.maximum(CELLS * distinct, 64))).astype(np.int64)
    base = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.uint8)
    at = np.repeat(base, distinct)
    for place in places(hashes, np.repeat(size, distinct)):
        np.maximum.at(flat, at + place, code)
    return [flat[b : b + s].tobytes() for b, s in zip(base.tolist(), size.tolist(), strict=True)]


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index: sketches (row, n, sketch) of the texts that have terms, and frequencies (bucket, h, c)."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(4, partitions(spark), chars // BUCKET_CHARS)
    schema = "kind int, row long, n long, sketch binary, bucket int, h binary, c binary"
    names = ["kind", "row", "n", "sketch", "bucket", "h", "c"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def rows(count: int, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns.get(n, [None] * count), t) for n, t in zip(names, types, strict=True)], names)

    def make(batches):
        held, size = [], 0

        def counted():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            bucket = bucket_of(h, buckets)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            parts = [(k, order[edge[k] : edge[k + 1]]) for k in range(buckets) if edge[k] < edge[k + 1]]
            return rows(len(parts), kind=[1] * len(parts), bucket=[k for k, _ in parts], h=[packed(h[o]) for _, o in parts], c=[packed(c[o].astype(np.uint32)) for _, o in parts])

        for batch in batches:
            data, offs = buffers(batch.column("t"))
            for a, b in slices(offs):
                hashes, tf, distinct, n = terms_of(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                some = np.flatnonzero(n)
                yield rows(len(some), kind=[0] * len(some), row=batch.column("row").slice(a, b - a).take(pa.array(some)), n=n[some], sketch=sketched(hashes, tf, distinct[some]))
                held.append(hashes)
                size += len(hashes)
                if size > HELD:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    def add(table: pa.Table) -> pa.Table:
        h = np.concatenate([unpacked(x, np.uint64) for x in table.column("h")])
        h, back = np.unique(h, return_inverse=True)
        c = np.bincount(back, np.concatenate([unpacked(x, np.uint32) for x in table.column("c")])).astype(np.int64)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "h": pa.array([packed(h)], pa.binary()), "c": pa.array([packed(c)], pa.binary())})

    texts = docs.select(F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("t")).where("t IS NOT NULL")
    made = written(texts.mapInArrow(make, schema), "sketches", ["kind"])
    counts = made.where("kind = 1").select("bucket", "h", "c").groupBy("bucket").applyInArrow(add, "bucket int, h binary, c binary")
    return made.where("kind = 0").select("row", "n", "sketch"), written(counts, "frequencies")


class Block:
    """A block of items with the weights of their terms: what is sent to all tasks."""

    def __init__(self, terms: list[np.ndarray], frequencies: DataFrame, n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms, self.items = n_docs, n_terms, len(terms)
        wanted = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]))

        def find(batches):
            for batch in batches:
                for h, c in zip(batch.column("h"), batch.column("c"), strict=True):
                    h = unpacked(h, np.uint64)
                    at = np.minimum(np.searchsorted(h, wanted), len(h) - 1)
                    hit = np.flatnonzero(h[at] == wanted)
                    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(unpacked(c, np.int64)[at[hit]])], ["at", "df"])

        weight = np.zeros(len(wanted), np.int64)
        for r in frequencies.mapInArrow(find, "at long, df long").collect():  # a row a term of the block
            weight[r["at"]] = floor(1000 * log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        keep = np.flatnonzero(weight)
        self.hash, self.weight = wanted[keep], weight[keep]
        pairs = [(np.searchsorted(self.hash, t[np.isin(t, self.hash)]), k) for k, t in enumerate(terms)]
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in pairs)])
        item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(t), k) for t, k in pairs)])
        order = np.argsort(term, kind="stable")
        self.item = item[order]  # the items of each term, one term after another
        self.number = np.bincount(term, minlength=len(self.hash))
        self.first = np.cumsum(self.number) - self.number
        self.of = [t for t, _ in pairs]

    def shares(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n * self.n_docs) // self.n_terms
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))

    def bounds(self, matrix: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Upper bounds (documents x items) of documents whose sketches are the rows of matrix."""
        one, two = places(self.hash, matrix.shape[1])
        code = np.minimum(matrix[:, one], matrix[:, two])
        doc, term = np.nonzero(code)
        share = self.shares(term, DECODED[code[doc, term]], n[doc])
        number = self.number[term]
        at = np.repeat(self.first[term] - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
        cell = np.repeat(doc, number) * self.items + self.item[at]
        return np.bincount(cell, np.repeat(share, number), len(matrix) * self.items).reshape(len(matrix), self.items)  # sums below 2^53

    def bounded(self, batches):
        """Yields (rows, bounds) of a task's sketches, a few million lookups at a time."""
        step = max(1, 3_000_000 // max(1, len(self.hash), self.items))
        for batch in batches:
            rows, n = batch.column("row").to_numpy(), batch.column("n").to_numpy()
            sketches = batch.column("sketch")
            size = np.diff(np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset :][: len(rows) + 1])
            for s in np.unique(size).tolist():
                own = np.flatnonzero(size == s)
                for a in range(0, len(own), min(step, max(1, (64 << 20) // s))):
                    some = own[a : a + min(step, max(1, (64 << 20) // s))]
                    matrix = np.frombuffer(b"".join(sketches[k].as_py() for k in some.tolist()), np.uint8).reshape(len(some), s)
                    yield rows[some], self.bounds(matrix, n[some])


PAIR = "item int, row long, bound long"


def _pairs(item: np.ndarray, row: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(row), pa.array(bound.astype(np.int64))], ["item", "row", "bound"])


def highest(sketches: DataFrame, sent, k: int) -> DataFrame:
    """Each task's k pairs of highest bound by item."""

    def search(batches):
        block = sent.value
        best = np.zeros((0, block.items)), np.zeros((0, block.items), np.int64)
        for rows, bounds in block.bounded(batches):
            bounds = np.concatenate([best[0], bounds])
            row = np.concatenate([best[1], np.broadcast_to(rows[:, None], (len(rows), block.items))])
            if len(bounds) > k:
                top = np.argpartition(bounds, len(bounds) - k, axis=0)[-k:]
                bounds, row = np.take_along_axis(bounds, top, 0), np.take_along_axis(row, top, 0)
            best = bounds, row
        at, item = np.nonzero(best[0])
        yield _pairs(item, best[1][at, item], best[0][at, item])

    return sketches.mapInArrow(search, PAIR)


def reaching(sketches: DataFrame, sent, least: np.ndarray) -> DataFrame:
    """The pairs whose bound is at least the item's threshold."""

    def search(batches):
        for rows, bounds in sent.value.bounded(batches):
            at, item = np.nonzero(bounds >= least)
            yield _pairs(item, rows[at], bounds[at, item])

    return sketches.mapInArrow(search, PAIR)


def rescored(pairs: DataFrame, docs: DataFrame, sent, doc_id: str, text: str) -> DataFrame:
    """(item, doc_id, score) of pairs (item, row) from the whole texts of docs, scores above 0."""
    kind = docs.schema[doc_id].dataType.simpleString()
    asked = written(pairs.groupBy("row").agg(F.collect_list("item").alias("items")), "asked")  # items of one block
    texts = docs.select(F.xxhash64(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    found = texts.join(F.broadcast(asked) if asked.count() <= FEW else asked.hint("merge"), "row")

    def score(batches):
        block = sent.value
        for batch in batches:
            data, offs = buffers(batch.column("t"))
            asked = batch.column("items")
            item, doc, total = [], [], []
            for a, b in slices(offs):
                hashes, tf, distinct, n = terms_of(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                last = np.cumsum(distinct)
                for k in range(b - a):
                    own = slice(int(last[k] - distinct[k]), int(last[k]))
                    at = np.minimum(np.searchsorted(block.hash, hashes[own]), len(block.hash) - 1)
                    hit = block.hash[at] == hashes[own]
                    share = np.zeros(len(block.hash), np.int64)
                    share[at[hit]] = block.shares(at[hit], tf[own][hit], np.full(int(hit.sum()), n[k]))
                    for i in asked[a + k].as_py():
                        item.append(i)
                        doc.append(a + k)
                        total.append(int(share[block.of[i]].sum()))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(total, pa.int64())], ["item", "doc_id", "score"])

    return found.select("doc_id", "t", "items").mapInArrow(score, f"item int, doc_id {kind}, score long").where("score > 0")


def best_of(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def search(docs: DataFrame, index: tuple[DataFrame, DataFrame], items: DataFrame, k: int = TOP, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item; index: build(docs)."""
    spark = docs.sparkSession
    sketches, frequencies = index
    facts = sketches.agg(F.count("*"), F.sum("n")).first()
    kind = docs.schema[doc_id].dataType.simpleString()
    blocks = max(1, -(-2 * items.count() // BLOCK)) if facts[0] else 0
    id_kind = items.schema[item_id].dataType
    found = []
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == b)
        asked = own.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).collect()  # about BLOCK / 2 items
        if not asked:
            continue
        texts = pa.array([r["t"] for r in asked], pa.string())
        hashes, _, distinct, _ = terms_of(*buffers(texts))
        block = Block(np.split(hashes, np.cumsum(distinct)[:-1]), frequencies, facts[0], facts[1])
        if not len(block.hash):
            continue
        sent = spark.sparkContext.broadcast(block)
        top = Window.partitionBy("item").orderBy(F.col("bound").desc(), "row")
        size, done, rest, best = 2 * k, None, None, None
        while True:
            source = highest(sketches, sent, size).distinct() if rest is None else rest
            batch = written(source.withColumn("place", F.row_number().over(top)).where(F.col("place") <= size).drop("place"), "batch")
            scored = rescored(batch, docs, sent, doc_id, text)
            better = written(best_of(scored if best is None else best.drop("rank").union(scored), k), "best")
            best = better
            least = np.ones(block.items, np.int64)
            for r in best.where(F.col("rank") == k).collect():  # a row an item
                least[r["item"]] = r["score"]
            if rest is None:
                rest = reaching(sketches, sent, least).distinct()
            else:
                limits = F.array(*[F.lit(int(x)) for x in least])
                rest = rest.where(F.col("bound") >= limits[F.col("item")])
            done = batch
            rest = written(rest.join(done.hint("merge"), ["item", "row"], "left_anti"), "rest")
            size *= 8
            if rest.isEmpty():
                break
        names = spark.createDataFrame([(k, r["i"]) for k, r in enumerate(asked)], f"item int, {item_id} {id_kind.simpleString()}")
        found.append(best.join(F.broadcast(names), "item").select(item_id, "rank", F.col("doc_id").alias(doc_id), "score"))  # names: a block
    if not found:
        return spark.createDataFrame([], f"{item_id} {id_kind.simpleString()}, rank int, {doc_id} {kind}, score long")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def op12_lexical_rank(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, build(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents),
  d AS (SELECT doc_id, len(t)::BIGINT AS n FROM w WHERE len(t) > 0),
  g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM d),
  q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
  tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w) SEMI JOIN q USING (term) GROUP BY ALL),
  df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
  x AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, g),
  s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l))))::BIGINT AS score
    FROM q JOIN x USING (term) JOIN tf USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id)
  SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""
