"""The last rounds of line dedup and of the n-gram join: a pair comes once, however many bands or groups it shares."""

import random

import numpy as np

from lorefold.llm import line_dedup, ngram_join
from lorefold.llm.shared import components, joined_up, relabelled


def test_line_pairs_come_once_and_none_is_lost(spark, monkeypatch):
    r = random.Random(5)
    make = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    start = make(150)
    odd = line_dedup.parities(spark.createDataFrame([(k, start + make(20)) for k in range(30)], "node long, t string"))
    # eight keys hold all lines, three more some lines each
    keys = [(key, node, node) for key in range(8) for node in range(30)] + [(20 + k, n, n) for k in range(3) for n in range(k, 30, 4)]
    at = spark.createDataFrame(keys, "key long, node long, c long")
    want = {(a, b) for a in range(30) for b in range(a + 1, 30)}
    monkeypatch.setattr(type(at), "distinct", lambda df: df)
    got = [(x["u"], x["v"]) for x in line_dedup._apart(at, odd, 0.75).collect()]
    assert set(got) == want and len(got) == len(want)


def test_set_pairs_come_about_once_and_none_is_lost(spark, monkeypatch):
    r = np.random.default_rng(3)
    sets, rows, schema = [], [], ", ".join(f"{p} long" for p in ngram_join.PARITY)
    for k in range(24):
        tokens = np.unique(np.concatenate((np.arange(300, dtype=np.uint64), r.integers(1 << 40, 1 << 41, 5 + k, dtype=np.uint64))))
        sets.append((k, *(int(x) for x in ngram_join.parities(tokens, np.array([len(tokens)])).view(np.int64)[0])))
        # forty groups hold all sets; what a set may do there differs: 1 probes, 2 is indexed
        rows += [(g, k, len(tokens), int(r.choice([1, 2, 3])), k) for g in range(40)]
    at = spark.createDataFrame(rows, "gid long, node long, n long, flags int, c long")
    flags = {(g, k): (n, f) for g, k, n, f, _ in rows}
    meets = lambda g, a, b: (flags[g, a][0] >= flags[g, b][0] and flags[g, a][1] & 1 and flags[g, b][1] & 2) or (flags[g, b][0] >= flags[g, a][0] and flags[g, b][1] & 1 and flags[g, a][1] & 2)
    want = {(a, b) for a in range(24) for b in range(a + 1, 24) if any(meets(g, a, b) for g in range(40))}
    monkeypatch.setattr(type(at), "distinct", lambda df: df)
    got = [(x["u"], x["v"]) for x in ngram_join._apart(at, spark.createDataFrame(sets, f"node long, {schema}"))[0].collect()]
    assert set(got) == want and len(got) < 2 * len(want)


def test_labels_of_a_part_of_the_links_are_joined_up(spark):
    r = random.Random(9)
    links = [(a, b) for a, b in ((r.randrange(300), r.randrange(300)) for _ in range(260)) if a < b]
    links += [(1000 + k, 1001 + k) for k in range(40)]  # a chain of which nothing has a label
    every = spark.createDataFrame(links, "u long, v long")
    label = relabelled(None, spark.createDataFrame(links[:50], "u long, v long"))
    got = {x["node"]: x["c"] for x in joined_up(label, every).collect()}
    want = {x["node"]: x["component"] for x in components(every).collect()}
    assert got.keys() == want.keys() and len({(got[k], want[k]) for k in want}) == len(set(want.values())) == len(set(got.values()))
