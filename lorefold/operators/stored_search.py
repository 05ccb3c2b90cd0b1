"""Hybrid search over the stored indexes, under the registry's filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.operators import lexical_index, vector_index
from lorefold.operators.filters import clauses
from lorefold.operators.retrieval import fallback, fuse, hash_vector, rerank


def allowed(chunks: DataFrame, registry: DataFrame, filters: dict | None, topics_mode: str) -> DataFrame:
    """(doc_id) of chunks (doc_id, slug) whose document the registry has and the filters let through."""
    known = registry.where(clauses(filters, topics_mode)).select("slug").distinct()
    return chunks.select("doc_id", "slug").join(known.hint("merge"), "slug", "left_semi").select("doc_id")


def filtered_search(
    queries: DataFrame, chunks: DataFrame, registry: DataFrame, lexical: lexical_index.LexicalIndex, vectors: vector_index.VectorIndex,
    filters: dict | None = None, candidates: int = 20, top_k: int = 10, rerank_k: int = 5, dim: int = 64, reranker=rerank,
) -> tuple[DataFrame, DataFrame]:
    """(results, fused): both sides of the search under the filters, fused, then reranked.

    queries: query_id, text; chunks: doc_id, slug, text; registry: slug and the columns of the filters. Lists must hold all that is asked on the
    dense side, any of it on the keyword side. Rows are met with the filters before they are scored; the statistics of words
    are of the whole index. reranker None keeps the fused order.
    """
    q = queries.select("query_id", "text")
    asked = q.select("query_id", hash_vector(F.col("text"), dim).alias("embedding"))
    dense, _ = vector_index.search(vectors, asked, candidates, allowed=allowed(chunks, registry, filters, "all").withColumnRenamed("doc_id", "vec_id"))
    keyword, _ = lexical_index.search(lexical, q, candidates, allowed=allowed(chunks, registry, filters, "any"))
    fused = fuse(dense.withColumnRenamed("vec_id", "doc_id"), keyword, top_k)
    results = fallback(fused, rerank_k) if reranker is None else reranker(fused, q, chunks, rerank_k)
    return results, fused
