"""A vector index by cells, and exact cosine search that visits cells in the order of a bound until the rest is ruled out.

Vectors are taken at unit length, where the cosine is 1 - d^2 / 2 of the distance d. build() fits coarse centres with Spark's k-means on
a bounded sample and writes every vector into its nearest centre's cell, with its distance to it; the cells table has each one's
centre, size and least and greatest distance. By the triangle inequality no vector of a cell is nearer to a query than
max(D - far, near - D, 0) for the query's distance D to the centre. search() visits each query's cells of best bound first, a few in
the first round, four times as many in each later one, and stops once the k-th score found rules out all cells not visited.
A vector of a visited cell is only compared if its own distance to the centre does not rule it out. With probes, a fixed number of
cells is visited instead (approximate).

The centres (at most CELLS) and a block of queries are all that is sent to the tasks; a cell that very many vectors share has
several files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.operators.retrieval import check_k, top
from lorefold.sources.tables import discard, written

CELLS, SAMPLE, MAX_QUERIES = 1024, 200_000, 2_000
FILE_ROWS = 500_000
EDGE = 1.5e-6  # scores are shown with six decimals


@dataclass
class VectorIndex:
    cells: DataFrame  # cell, n, near, far
    vectors: DataFrame  # vec_id, unit, distance, cell
    centres: np.ndarray


def _unit(df: DataFrame) -> DataFrame:
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = df.where("embedding IS NOT NULL").withColumn("_size", size).where("_size > 0")
    return rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double") / F.col("_size")).alias("unit"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if len(column) and (np.diff(column.offsets.to_numpy()) != dim).any():
        raise ValueError(f"vectors must have {dim} values")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _distances(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((m * m).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * m @ centres.T, 0))


def build(vectors: DataFrame, cells: int | None = None, seed: int = 7) -> VectorIndex:
    """The index of vectors (vec_id, embedding), written; vectors without length are left out. cells: about the root of the rows."""
    unit = written(_unit(vectors), "unit-vectors")
    n = unit.count()
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    wanted = max(1, min(CELLS, cells or round(n**0.5)))
    share = max(1, -(-n // SAMPLE))
    sample = unit.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(share)) == 0) if share > 1 else unit
    centres = np.zeros((0, 0))
    if n:
        model = KMeans(k=wanted, maxIter=12, seed=seed, initSteps=2).fit(sample.select(array_to_vector("unit").alias("features")))
        centres = np.array(model.clusterCenters())
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column("unit"), sent.value.shape[1]), sent.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("unit"), pa.array(d[np.arange(len(d)), cell]), pa.array(cell.astype(np.int32))], ["vec_id", "unit", "distance", "cell"])

    placed = written(unit.mapInArrow(assign, f"vec_id {kind}, unit array<double>, distance double, cell int"), "placed-vectors")
    facts = written(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("near"), F.max("distance").alias("far")), "cells")
    shard = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / FILE_ROWS))
    dealt = placed.join(F.broadcast(facts.select("cell", "n")), "cell").repartition(F.col("cell"), shard)  # facts: a row a cell
    stored = written(dealt.select("vec_id", "unit", "distance", "cell").sortWithinPartitions("cell", "distance"), "vector-cells", ["cell"])
    discard(unit, placed)
    return VectorIndex(facts, stored, centres)


def remove(index: VectorIndex) -> None:
    discard(index.cells, index.vectors)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, allowed: DataFrame | None = None, max_queries: int = MAX_QUERIES) -> tuple[DataFrame, DataFrame]:
    """((query_id, vec_id, score, rank), visits): the k nearest of each query (query_id, embedding) by cosine, ties by vec_id.

    allowed: rows (vec_id) that may be found. visits: (query_id, cells, visited, compared), what the search has looked at.
    """
    check_k(k, *([] if probes is None else [probes]))
    spark, kind = queries.sparkSession, queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {index.vectors.schema['vec_id'].dataType.simpleString()}, score double"
    shape = f"query_id {kind}, cells int, visited int, compared long"
    facts = {r["cell"]: r for r in index.cells.collect()}  # CELLS at most
    number = np.array(sorted(facts), np.int64)
    if allowed is not None:
        allowed = written(allowed.select("vec_id").distinct(), "allowed")
        allowed = F.broadcast(allowed) if allowed.count() <= 300_000 else allowed.hint("merge")
    total = queries.count()
    blocks = 1 if total <= max_queries else -(-2 * total // max_queries)
    found, visits = [], []
    for b in range(blocks if len(number) else 0):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        block = _unit(own.select(F.col("query_id").alias("vec_id"), "embedding")).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        ids = block.column("vec_id").combine_chunks()
        q = _matrix(block.column("unit").combine_chunks(), index.centres.shape[1])
        away = _distances(q, index.centres[number])
        near, far, size = (np.array([facts[c][x] for c in number]) for x in ("near", "far", "n"))
        bound = 1 - np.maximum(np.maximum(away - far, near - away), 0) ** 2 / 2 + 1e-9
        order = np.lexsort((away, -bound))  # of each query's cells
        done = np.zeros(bound.shape, bool)
        least = np.full(len(q), -2.0)
        parts, step, best = [], probes or 4, None
        compared = np.zeros(len(q), np.int64)
        while True:
            open_ = ~done & (bound >= least[:, None] - EDGE)
            rank = np.cumsum(np.take_along_axis(open_, order, 1), 1)
            chosen = np.zeros_like(open_)
            np.put_along_axis(chosen, order, (rank <= step) & np.take_along_axis(open_, order, 1), 1)
            if not chosen.any():
                break
            done |= chosen
            compared += chosen @ size
            sent = spark.sparkContext.broadcast(({int(c): np.flatnonzero(chosen[:, j]) for j, c in enumerate(number) if chosen[:, j].any()}, {int(c): away[:, j] for j, c in enumerate(number) if chosen[:, j].any()}, q, least, ids))

            def look(batches, sent=sent):
                at, away, q, least, ids = sent.value
                for batch in batches:
                    cells = batch.column("cell").to_numpy()
                    for c in np.unique(cells).tolist():
                        part = batch.filter(pa.array(cells == c))
                        asked = at[c]
                        scores = _matrix(part.column("unit"), q.shape[1]) @ q[asked].T
                        gap = np.abs(part.column("distance").to_numpy()[:, None] - away[c][asked][None])
                        out = gap > np.sqrt(np.maximum(2 - 2 * (least[asked] - EDGE), 0))[None] + 1e-9
                        scores[out | (scores < least[asked][None] - EDGE)] = -2
                        n = min(k, len(scores))
                        kth = np.partition(scores, len(scores) - n, axis=0)[len(scores) - n] - EDGE
                        row, of = np.nonzero((scores >= kth) & (scores > -2))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked[of])), part.column("vec_id").take(pa.array(row)), pa.array(scores[row, of])], ["query_id", "vec_id", "score"])

            rows = index.vectors.where(F.col("cell").isin(sorted(sent.value[0])))
            if allowed is not None:
                rows = rows.join(allowed, "vec_id", "left_semi")
            got = rows.select("vec_id", "unit", "distance", "cell").mapInArrow(look, schema).withColumn("score", F.round("score", 6))
            best = written(top(got if best is None else best.drop("rank").union(got), "score", "vec_id", k), "nearest")
            if probes:
                break
            place = {v: j for j, v in enumerate(ids.to_pylist())}
            for r in best.where(F.col("rank") == k).collect():  # a row a query of the block
                least[place[r["query_id"]]] = r["score"]
            step *= 4
        if best is not None:
            found.append(best)
        parts = [(i, len(number), int(v), int(c)) for i, v, c in zip(ids.to_pylist(), done.sum(1), compared, strict=True)]
        visits.append(spark.createDataFrame(parts, shape))
    empty = lambda s: spark.createDataFrame([], s)
    both = lambda dfs, s: reduce(DataFrame.union, dfs) if dfs else empty(s)
    return both(found, f"{schema}, rank int"), both(visits, shape)
