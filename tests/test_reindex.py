"""Deletion in one join, and vectors of many texts at once."""

import hashlib
import re

import numpy as np
import pandas as pd

from lorefold.operators import index as I
from lorefold.operators import retrieval as R


def test_rows_go_in_one_join(spark):
    rows = [("a", "v1", 1), ("a", "v2", 2), ("b", "v1", 3), ("c", None, 4), ("d", "v1", 5), (None, "v1", 6), ("e", None, 7), ("e", "v3", 8)]
    table = spark.createDataFrame(rows, "slug string, version_hash string, n long")
    changed = spark.createDataFrame([("a", "v1"), ("a", "v1"), ("c", None), (None, "v1"), ("d", "v9")], "slug string, version_hash string")
    withdrawn = spark.createDataFrame([("b",), ("e",), ("x",), (None,)], "slug string")
    got = I.without(table, changed, withdrawn, "slug")
    want = I.without_documents(I.without_versions(table, changed, "slug"), withdrawn, "slug")
    assert sorted(r.n for r in got.collect()) == sorted(r.n for r in want.collect()) == [2, 4, 5, 6]
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_many_texts_are_those_of_each(monkeypatch):
    def one(text, dim):
        v = np.zeros(dim)
        for w in re.findall("[a-z0-9]+", (text or "").lower()):
            h = hashlib.sha256(w.encode()).digest()
            v[int.from_bytes(h[:4], "big") % dim] += 1 if h[4] & 1 == 0 else -1
        length = np.sqrt((v * v).sum())
        return np.round(v / length, 6) if length else v

    texts, dims = ["one two two", None, "", "?!", "Three one 3", "one two two " * 50], [64, 64, 8, 64, 16, 64]
    for held in (1, 100, 1_000_000):
        monkeypatch.setattr(R, "HELD", held)
        got = R._hash_vectors.func(pd.Series(texts), pd.Series(dims))
        assert [v.tolist() for v in got] == [one(t, d).tolist() for t, d in zip(texts, dims, strict=True)]
