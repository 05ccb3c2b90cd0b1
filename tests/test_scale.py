"""What must not grow faster than the input, each with the results of brute force."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_stored import close, scored, texts

from lorefold.operators import jobs as J
from lorefold.operators import lexical_index as X
from lorefold.operators import pieces
from lorefold.operators import retrieval as R


def brute(docs, query, k, among=None):
    rows = ((i, round(s, 6)) for i, s in scored(docs, query).items() if among is None or i in among)
    return sorted(rows, key=lambda x: (-x[1], x[0]))[:k]


def by_query(found):
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return got


@pytest.mark.parametrize("small", [True, False])
def test_bm25_shuffles_only_what_can_be_among_the_best(spark, monkeypatch, small):
    if small:  # many slices and blocks of queries
        monkeypatch.setattr(R, "CELLS", 40)
        monkeypatch.setattr(R, "TEXT_BYTES", 50)
    docs = [*texts(400), (900, "ÉTÉ w0_w1 ǅ İx"), (901, "été, w250")]
    queries = [(k, q) for k, q in enumerate(["w0 w1 w250", "w0", "w0 w0 w90 w120", "Été w3", "nothing", "", "w299 w5", None])]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    found = R._best(asked, table, {"text": 1.0}, 5, max_queries=3) if small else R.bm25(asked, table, 5)
    assert found.columns == ["query_id", "doc_id", "score", "rank"]
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()  # no row of query word and document is dealt by word
    got = by_query(found)
    for k, q in queries:
        assert close(got.get(k, []), brute(docs, q, 5)), q


def test_bm25_fields_and_own_rows(spark):
    rnd = random.Random(1)
    rows = [(k, t, f"w{rnd.randrange(4)} head" if k % 3 else None, "a" if k % 2 else "b") for k, t in texts(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, head string, own string")
    asked = spark.createDataFrame([(1, "w0 w3 w40", "a"), (2, "head w1", "b"), (3, "w0", None), (4, "w0", "c")], "query_id long, text string, own string")
    got = by_query(R.bm25_fields(asked, table, 7, {"text": 1.0, "head": 2.0}, F.col("own") == "a"))
    among = {r[0] for r in rows if r[3] == "a"}
    for k, q in ((1, "w0 w3 w40"), (2, "head w1"), (3, "w0")):
        a, b = scored([r[:2] for r in rows], q), scored([(r[0], r[2]) for r in rows], q)
        best = {i: round(max(a.get(i, 0), 2 * b.get(i, 0)), 6) for i in {*a, *b} & among}
        assert close(got[k], sorted(best.items(), key=lambda x: (-x[1], x[0]))[:7]), q
    got = by_query(R.bm25(asked, table, 7, own=F.col("own")))
    assert sorted(got) == [1, 2]
    assert close(got[1], brute([r[:2] for r in rows], "w0 w3 w40", 7, among))
    chunks = table.select("doc_id", "text", F.lit("s").alias("slug"), F.col("own").alias("version_hash"))
    picked = J.version_evidence(asked.select("query_id", "text", F.lit("s").alias("slug"), F.col("own").alias("version_hash")), chunks, 7, 7)
    assert {r.doc_id for r in picked.where("query_id = 1").collect()} == {i for i, _ in got[1]}


def test_index_shards_hold_whole_rows_and_score_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(X, "SHARD", 60)
    monkeypatch.setattr(X, "FEW_POSTINGS", 5)
    monkeypatch.setattr(X, "MAX_QUERIES", 2)
    docs = [*texts(250), (900, "É w0")]
    named = [(f"d{i:04}", t) for i, t in docs]
    index = X.build(spark.createDataFrame(named, "doc_id string, text string"))
    placed = index.blocks.select("shard", F.explode("postings").alias("p")).groupBy("p.doc_id").agg(F.countDistinct("shard").alias("n"))
    assert index.shards > 3 and placed.where("n > 1").count() == 0  # a word's rows were dealt by the word's own number before
    queries = [(k, q) for k, q in enumerate(["w0 w1 w250", "w0", "é w90", "w1 w2 w3", "nothing", "w299 w5"])]
    allowed = {i for i, _ in docs if i % 3}
    for some in (None, allowed):
        ok = None if some is None else spark.createDataFrame([(f"d{i:04}",) for i in some], "doc_id string")
        got = by_query(X.search(index, spark.createDataFrame(queries, "query_id long, text string"), 5, allowed=ok)[0])
        for k, q in queries:
            assert close(got.get(k, []), [(f"d{i:04}", s) for i, s in brute(docs, q, 5, some)]), q
    X.remove(index)


def test_row_functions_hand_on_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(pieces, "PIECE", 1_000)

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    def make(k, text):
        for _ in range(k % 4):
            yield k, text or ""

    run = pieces.rows_to_rows(Rows(), make, "k long, text string")
    rows = [(k, None if k % 5 == 0 else "é" * (k * 7)) for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["k", "text"])
    out = list(run(iter([batch, batch.slice(0, 0)])))
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(k, t or "") for k, t in rows for _ in range(k % 4)]
    assert max(sum(len(t) for t in b.column("text").to_pylist()) for b in out) < 1_000 + 60 * 7  # one batch in, one batch out before
