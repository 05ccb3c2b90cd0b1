"""Stored indexes: block maxima, vector cells, filtered search, tables that change together."""

import random
import re
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorefold.operators import index as I
from lorefold.operators import lexical_index as X
from lorefold.operators import retrieval as R
from lorefold.operators import vector_index as V
from lorefold.sources.tables import ConflictError, TableSet, bucket_of


def texts(n, seed=3):
    """Texts of a long-tailed vocabulary: a few words in nearly all of them."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(k, " ".join(rnd.choices(words, weights, k=rnd.choice([3, 20, 60])))) for k in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "..."), (n + 3, rows[0][1])]


def scored(docs, query):
    """Brute force BM25: {doc_id: score}."""
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    all_ = {i: tok(t) for i, t in docs if tok(t)}
    avg = sum(map(len, all_.values())) / len(all_)
    df = lambda w: sum(w in t for t in all_.values())
    out = {}
    for w in tok(query):
        idf = log(1 + (len(all_) - df(w) + 0.5) / (df(w) + 0.5))
        for i, t in all_.items():
            if n := t.count(w):
                out[i] = out.get(i, 0) + idf * n / (n + 1.2 * (1 - 0.75 + 0.75 * len(t) / avg))
    return out


def close(got, want):
    return [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 3e-6 for (_, a), (_, b) in zip(got, want, strict=True))


@pytest.mark.parametrize("few", [True, False])
def test_stored_postings_rank_as_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(X, "FEW_POSTINGS", 20)
    monkeypatch.setattr(X, "SHARD", 100)
    if not few:
        monkeypatch.setattr(X, "FEW_PAIRS", 0)
    docs = texts(600)
    queries = [(k, q) for k, q in enumerate(["w0 w1 w250", "w0", "w0 w0 w90 w120", "w1 w2 w3", "nothing", "", "w299 w5"])]
    index = X.build(spark.createDataFrame(docs, "doc_id long, text string"))
    found, reads = X.search(index, spark.createDataFrame(queries, "query_id long, text string"), 5)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for k, q in queries:
        want = sorted(((i, round(s, 6)) for i, s in scored(docs, q).items()), key=lambda x: (-x[1], x[0]))[:5]
        assert close(got.get(k, []), want), q
    total = reads.where("frequent").agg(F.sum("df"), F.sum("read")).first()
    assert total[1] < total[0]
    assert index.blocks.groupBy("term").agg(F.sum("size").alias("n")).join(index.terms, "term").where("n <> df").count() == 0
    X.remove(index)


def test_stored_postings_under_a_filter(spark):
    docs = texts(300)
    index = X.build(spark.createDataFrame(docs, "doc_id long, text string"))
    q = spark.createDataFrame([(1, "w0 w3 w40 w77")], "query_id long, text string")
    allowed = spark.createDataFrame([(i,) for i, _ in docs if i % 7 == 1] * 2, "doc_id long")
    got = [(r.doc_id, r.score) for r in X.search(index, q, 9, allowed=allowed)[0].orderBy("rank").collect()]
    want = sorted(((i, round(s, 6)) for i, s in scored(docs, "w0 w3 w40 w77").items() if i % 7 == 1), key=lambda x: (-x[1], x[0]))[:9]
    assert close(got, want)
    assert X.search(index, q, 9, allowed=allowed.where("false"))[0].count() == 0
    with pytest.raises(ValueError):
        X.search(index, q, 0)


def clusters(n, seed=5, dim=16):
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(12, dim)) * 3
    rows = [(k, (heart[k % 12] + rng.normal(size=dim) * 0.2).tolist()) for k in range(n)]
    return [*rows, (n, [0.0] * dim), (n + 1, None), (n + 2, rows[0][1]), (n + 3, [2 * x for x in rows[0][1]])]


def test_vector_cells_are_exact_and_leave_cells_out(spark):
    rows = clusters(900)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 50 = 0 AND vec_id < 900").select(F.col("vec_id").alias("query_id"), "embedding")
    index = V.build(table, cells=24)
    found, visits = V.search(index, queries, 7)
    want = R.dense_search(queries, table, 7)
    key = lambda r: (r.query_id, r.rank)
    assert [tuple(r) for r in sorted(found.collect(), key=key)] == [tuple(r) for r in sorted(want.select(*found.columns).collect(), key=key)]
    assert visits.where("visited < cells").count() == visits.count() == queries.where("embedding IS NOT NULL").count()
    few, _ = V.search(index, queries, 7, probes=1)
    both = few.join(want, ["query_id", "vec_id"]).count() / want.count()
    assert both > 0.5
    blocks, _ = V.search(index, queries, 7, max_queries=4)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, found.collect()))
    odd = table.where("vec_id % 3 = 1").select("vec_id")
    narrowed, _ = V.search(index, queries, 4, allowed=odd)
    want = R.dense_search(queries, table.where("vec_id % 3 = 1"), 4)
    assert sorted(map(tuple, narrowed.collect())) == sorted(map(tuple, want.select(*narrowed.columns).collect()))
    V.remove(index)
    empty = V.build(table.where("false"))
    assert V.search(empty, queries, 3)[0].count() == 0


SCHEMAS = {"a": "slug string, n long", "b": "slug string, t string"}


def test_tables_change_together(spark, tmp_path):
    t = TableSet(spark, str(tmp_path), SCHEMAS, buckets=4)
    a = lambda *rows: spark.createDataFrame(list(rows), SCHEMAS["a"])
    b = lambda *rows: spark.createDataFrame(list(rows), SCHEMAS["b"])
    assert t.read("a").count() == 0 and t.manifest()["version"] == 0
    assert t.commit("run-1", {"a": a(*[(f"s{k}", k) for k in range(20)]), "b": b(("s1", "x"))}, range(4))
    one = t.touched(spark.createDataFrame([("s3",)], "slug string"))
    assert one == [spark.range(1).select(bucket_of(F.lit("s3"), 4)).first()[0]]
    rest = [tuple(r) for r in t.read("a").collect() if r.slug not in {x.slug for x in t.read("a", one).collect()}]
    assert t.commit("run-2", {"a": a(("s3", 300))}, one)
    assert sorted(map(tuple, t.read("a").collect())) == sorted([*rest, ("s3", 300)])
    assert t.read("b").count() == 1 and t.read("a", version=1).count() == 20
    assert not t.commit("run-2", {"a": a(("s3", 1))}, one)  # again: no change
    assert t.read("a", one).collect()[0].n == 300 and t.manifest()["version"] == 2
    assert t.unnamed() == []


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    t = TableSet(spark, str(tmp_path), SCHEMAS, buckets=2)
    rows = spark.createDataFrame([("s1", 1), ("s2", 2)], SCHEMAS["a"])
    t.commit("run-1", {"a": rows}, range(2))
    with monkeypatch.context() as m:
        m.setattr(t, "_put", lambda manifest: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.commit("run-2", {"a": rows.where("n = 1"), "b": spark.createDataFrame([], SCHEMAS["b"])}, range(2))
    assert t.read("a").count() == 2 and len(t.unnamed()) == 2
    assert t.commit("run-2", {"a": rows.where("n = 1")}, range(2)) and t.read("a").count() == 1
    stale = t.manifest(1)
    with monkeypatch.context() as m:  # two runs from one version: the second fails
        m.setattr(t, "manifest", lambda version=None: stale)
        with pytest.raises(ConflictError):
            t.commit("run-3", {"a": rows}, range(2))
    assert t.read("a").count() == 1
    with pytest.raises(ValueError, match="does not replace"):
        t.commit("run-4", {"a": rows}, [])
    with pytest.raises(ValueError):
        t.commit("a/b", {}, [])


def test_rows_that_cannot_be_indexed_are_shown(spark):
    rows = spark.createDataFrame([("c1", "s", "v"), ("c2", " ", "v"), ("c3", "s", None)], "chunk_id string, slug string, version_hash string")
    assert [tuple(r) for r in I.rejects(rows).orderBy("chunk_id").collect()] == [("c2", " ", "v", "document_slug"), ("c3", "s", None, "version_hash")]
