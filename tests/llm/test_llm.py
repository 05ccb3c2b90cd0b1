import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorefold.llm import decontaminate, fingerprint, html_text, katz, language_id, line_dedup, mixing, ngram_join, substring_dedup, token_count
from lorefold.llm.shared import components

R = random.Random(4)
VOCAB = ["".join(R.choice("aeioubdklmnrst") for _ in range(R.randint(2, 8))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, r=R):
    return " ".join(r.choice(VOCAB) + ("." if r.random() < 0.1 else "") + ("\n" if r.random() < 0.03 else "") for _ in range(n))


def edited(text, share, r=R):
    return " ".join(r.choice(VOCAB) if r.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty and blank texts, ties, repeats, near copies, a long text."""
    base = [prose(R.randint(1, 120)) for _ in range(60)]
    near = [edited(t, 0.02) for t in base[:15]] + [edited(t, 0.08) for t in base[15:30]]
    return [None, "", "   \n\t ", "one", "One", "a b c d", "!!! ... ???", "é😀 ñandú", *base, *base[:10], *near, prose(6000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en" if k % 2 else "de", f"s{k % 5}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def joined(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (9, 9), *[(100 + k, 101 + k) for k in range(40)]]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert [got[k] for k in (1, 2, 3, 4, 5, 6)] == [1, 1, 1, 4, 4, 4] and 9 not in got
    assert all(got[100 + k] == 100 for k in range(41))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ngram_join_is_exact(docs, texts, none):
    got = {r["doc_id"]: r for r in ngram_join.near_components(docs).collect()}
    sets = [shingles(t) for t in texts]
    want = joined(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])])
    assert [got[k]["component_id"] for k in range(len(sets))] == want
    assert [got[k]["n_shingles"] for k in range(len(sets))] == [len(s) for s in sets]
    assert ngram_join.near_components(none).count() == 0
    assert {r["doc_id"] for r in ngram_join.one_of_each(docs).collect()} == set(want)


def test_ngram_signatures_meet_for_every_linked_pair():
    r = np.random.default_rng(1)
    nothing = np.zeros(0, np.uint64), np.zeros(0)
    for _ in range(3000):
        n = int(r.integers(1, 60)) if r.random() < 0.8 else int(r.integers(60, 400))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        drop, add = r.integers(0, n // 4 + 1), r.integers(0, n // 4 + 1)
        b = np.unique(np.concatenate((r.permutation(a)[drop:], r.integers(0, 2**63, add, dtype=np.uint64))))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 75 * (len(a) + len(b) - common):
            (sa, fa), (sb, fb) = (ngram_join.signatures(x, *nothing) for x in (a, b))
            big, small = ((sa, fa), (sb, fb)) if len(a) >= len(b) else ((sb, fb), (sa, fa))
            assert np.intersect1d(big[0][big[1] & 1 > 0], small[0][small[1] & 2 > 0]).size


def test_fingerprints(docs, texts, none):
    got = {r["doc_id"]: r for r in fingerprint.compare_edited(docs).collect()}
    assert len(got) == len(texts)
    bias = []
    for k, t in enumerate(texts):
        t, n = t or "", texts[(k + 1) % len(texts)] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        assert got[k]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[k]["n_chars"] == len(t)
        for value, x, y in ((got[k]["near_edited"], t, e), (got[k]["near_next"], t, n)):
            a, b = shingles(x), shingles(y)
            off = value - (len(a & b) / len(a | b) if a | b else 1)
            assert abs(off) < (0.1 if min(len(a), len(b)) >= 60 else 0.2)
            bias.append(off)
    assert abs(np.mean(bias)) < 0.015
    same = defaultdict(set)
    for k, t in enumerate(texts):
        same[t or ""].add(got[k]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert fingerprint.compare_edited(none).count() == 0


def test_token_counts_are_the_library_s(docs, texts, none):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["x" * 9000, " " * 5000, "ab" * 7000 + " c", "<s>▁▁a a▁b", "日本語 한국어\u0000", "http://a.b/c?d=1\r\n\t"]
    machine, table = token_count.load(path)
    data, offs = token_count.buffers(pa.array(odd))
    assert token_count.counted(data, offs, machine, table).tolist() == [len(x) for x in sp.encode(odd)]
    got = {r["doc_id"]: r for r in token_count.count_tokens(docs, path).collect()}
    assert [got[k]["n_tokens"] for k in range(len(texts))] == [len(sp.encode(t or "")) for t in texts]
    assert [got[k]["n_bytes"] for k in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert token_count.count_tokens(none, path).count() == 0


def test_katz_against_brute_force(docs, texts, none):
    train = F.col("doc_id") % 3 != 1
    got = {r["doc_id"]: r for r in katz.score(docs, train).collect()}
    tokens = [[*words(t), None] for t in texts]
    learned = [t for k, t in enumerate(tokens) if k % 3 != 1]
    c1, c2 = Counter(w for t in learned for w in t), Counter(p for t in learned for p in zip([0, *t], t))
    n, v, ch = sum(c1.values()), len(c1), Counter()
    for (h, _), c in c2.items():
        ch[h] += c
    d1, d2 = (katz.discounts(np.bincount([x for x in c.values() if x <= katz.K + 1], minlength=katz.K + 2)) for c in (c1, c2))
    cut = lambda c, d: c * d[min(c, katz.K + 1)]
    unknown = 1 - sum(cut(c, d1) for c in c1.values()) / n
    p1 = lambda w: cut(c1[w], d1) / n if w in c1 else unknown
    mass, seen = defaultdict(float), defaultdict(float)
    for (h, w), c in c2.items():
        mass[h] += c - cut(c, d2)
        seen[h] += p1(w)
    back = lambda h: (mass[h] + katz.EPS) / (ch[h] + katz.EPS) / (1 - seen[h]) if h in ch else 1
    p = lambda h, w: cut(c2[h, w], d2) / (ch[h] + katz.EPS) if (h, w) in c2 else back(h) * p1(w)
    h = next(w for w in c1 if w)
    assert abs(sum(p(h, w) for w in c1) + back(h) * unknown - 1) < 1e-9
    for k, t in enumerate(tokens):
        assert got[k]["score"] == pytest.approx(sum(math.log10(p(*x)) for x in zip([0, *t], t)), rel=1e-5)
        assert got[k]["base_score"] == pytest.approx(sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t), rel=1e-5)
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (len(t), sum(w in c1 for w in t), n)
    assert katz.score(none, train).count() == 0


def test_language_id(docs, spark, none):
    r = random.Random(2)
    make = lambda a, n: " ".join("".join(r.choice(a) for _ in range(r.randint(2, 7))) for _ in range(n))
    rows = [(k, make("aeimnost" if k % 2 else "ouzkwprt", 30), "x" if k % 2 else "y") for k in range(200)]
    model = language_id.fit(spark.createDataFrame(rows[:100], "doc_id long, text string, lang string"))
    got = language_id.predict(spark.createDataFrame(rows[100:], "doc_id long, text string, lang string"), model).collect()
    assert all(g["lang_pred"] == ("x" if g["doc_id"] % 2 else "y") and 0 <= g["score"] <= 1 for g in got)
    got = {g["doc_id"]: g for g in language_id.predict(docs, model).collect()}
    assert [got[k]["lang_pred"] for k in (0, 1, 2, 6)] == ["und"] * 4
    blank = language_id.fit(none)
    assert {g["lang_pred"] for g in language_id.predict(docs, blank).collect()} == {"und"}
    clash = docs.withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit(2))
    assert language_id.identified(clash).columns == clash.columns and language_id.identified(none).count() == 0


def test_mixing(docs, texts, none):
    got = mixing.mix_sources(docs, keep=("doc_id", "source")).toPandas()
    again = mixing.mix_sources(docs.repartition(7), keep=("doc_id", "source")).toPandas()
    key = lambda x: dict(zip(x["doc_id"], x["taken"], strict=True))
    assert key(got) == key(again)
    assert (got["taken"] <= 2 * got["size"]).all() and dict(zip(got["doc_id"], got["size"], strict=True)) == {k: len(words(t)) for k, t in enumerate(texts)}
    by = got.fillna({"source": "~"}).groupby("source").agg({"target": "first", "taken": "sum", "source_size": "first", "size": "max"})
    assert abs(by["target"].sum() - 1.5 * got["size"].sum()) < 1e-6 and (by["target"] <= 2 * by["source_size"]).all()
    assert ((by["taken"] - by["target"]).abs() <= by["size"]).all()
    weighted = mixing.mix_sources(docs, doc_weight=F.when(F.col("doc_id") % 2 == 0, 0.5).otherwise(1.0))
    assert weighted.count() == len(texts) and mixing.mix_sources(none).count() == 0


def test_mixing_never_cuts_the_class_of_full_rows(spark):
    rows = [(k, " ".join(["w"] * n), "s") for k, n in enumerate((60, 20, 20))]
    weight = F.when(F.col("doc_id") == 0, 0.1).otherwise(5.0)
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), doc_weight=weight)
    assert {r["doc_id"]: r["copies"] for r in got.collect()} == {0: 1, 1: 2, 2: 2}


def test_substring_dedup(spark, none):
    passage = "A passage of several words that many texts share. It has a second sentence that is long."
    rows = [(1, f"Own words of one. {passage}"), (2, f"Other words.\n{passage}\nThe end of two"), (3, None), (4, ""), (5, passage), (6, "Yes. No. Yes.")]
    got = {r["doc_id"]: r for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["clean_text"] == rows[0][1] and got[2]["clean_text"] == "Other words.\nThe end of two" and got[5]["clean_text"] == ""
    assert got[3]["clean_text"] is None and got[4]["clean_text"] == "" and got[6]["clean_text"] == rows[5][1]
    assert "".join(rows[1][1][s["start"] : s["end"]] for s in got[2]["removed"]) == passage + "\n"
    assert substring_dedup.without_repeats(none).count() == 0


def test_line_dedup(spark, none):
    line = "this line of some length is found again with hardly any change in other documents"
    rows = [(1, f"{line}\nalone in the first text"), (2, f"quite another beginning here\n{line.upper()}\nshort"), (3, line.replace("hardly", "harldy") + "\nshort"), (4, None), (5, ""), (6, f"{line}\n{line}")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "quite another beginning here\nshort", 3: "", 4: None, 5: "", 6: ""}
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_finds_what_brute_force_finds(docs, texts):
    rows = line_dedup.lines(docs, "doc_id", "text")
    t = {r["node"]: r["t"] for r in rows.select("node", "t").distinct().collect()}
    sets = {k: {x[i : i + 8] for i in range(max(1, len(x) - 7))} for k, x in t.items()}
    want = {(a, b) for a in t for b in t if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    order = {k: i for i, k in enumerate(sorted(t))}
    got = {(min(r["u"], r["v"]), max(r["u"], r["v"])) for r in line_dedup.links(rows).collect()}
    assert got <= want
    full, found = (len(set(joined(len(t), [(order[a], order[b]) for a, b in x]))) for x in (want, got))
    assert found - full <= 0.1 * (len(t) - full) + 1


def test_line_bands_recall_on_unequal_lengths(spark):
    r = random.Random(11)
    make = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    # one line a part of the other: the Jaccard of their sets is the ratio of their numbers of runs
    pairs = []
    for k in range(240):
        n = r.randint(290, 330) if k % 2 else r.randint(150, 470)
        t = make(n)
        pairs.append((t, t + make(min(600, int(n / r.uniform(0.77, 0.82))) - n)))
    table = spark.createDataFrame([(k, "\n".join(p)) for k, p in enumerate(pairs)], "doc_id long, text string")
    rows = line_dedup.lines(table, "doc_id", "text")
    node = {(x["id"], x["no"]): x["node"] for x in rows.collect()}
    sets = [[{t[i : i + 8] for i in range(len(t) - 7)} for t in p] for p in pairs]
    want = {frozenset((node[k, 0], node[k, 1])): k % 2 for k, (a, b) in enumerate(sets) if len(a & b) >= 0.75 * len(a | b)}
    got = {frozenset((x["u"], x["v"])) for x in line_dedup.links(rows).collect()}
    assert len(want) > 200 and got <= set(want)
    for half in (0, 1):
        own = [p for p, h in want.items() if h == half]
        assert sum(p in got for p in own) >= 0.9 * len(own)


def test_line_dedup_compares_all_members_of_a_band(spark):
    r = random.Random(12)
    make = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    # bands of hundreds of lines: one long beginning, a middle that only two lines share, an end of each line's own
    start, middle = make(162), [make(20) for _ in range(150)]
    text = [start + middle[k % 150] + make(25) for k in range(300)]
    rows = line_dedup.lines(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"), "doc_id", "text")
    node = {x["node"]: x["id"] for x in rows.collect()}
    got = [{node[x["u"]], node[x["v"]]} for x in line_dedup.links(rows).collect()]
    assert all(max(p) - min(p) == 150 for p in got) and len({min(p) for p in got}) >= 0.95 * 150


def test_decontamination(spark, none):
    r = random.Random(8)
    items = [(k, prose(r.randint(12, 45), r)) for k in range(12)]
    bench = spark.createDataFrame([*items, (50, None), (51, "?!")], "item_id long, text string")
    clean = [prose(r.randint(30, 200), r) for _ in range(40)]
    dirty = [f"{prose(50, r)} {t} {prose(30, r)}" for _, t in items] + [f"{prose(20, r)} {edited(t, 0.1, r)} {prose(60, r)}" for _, t in items]
    table = spark.createDataFrame(list(enumerate([*clean, *dirty, None, "", "..."])), "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_items(table, bench).collect()}
    planted = {(40 + k, k % 12) for k in range(24)}
    assert len(got & planted) >= 0.9 * len(planted) and not {d for d, _ in got} & set(range(40))
    assert {x["doc_id"] for x in decontaminate.decontaminated(table, bench).collect()} >= {*range(40), 64, 65, 66}
    assert decontaminate.find_items(none, bench).count() == 0 and decontaminate.find_items(table, bench.limit(0)).count() == 0


def test_common_subsequence():
    def slow(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    r = np.random.default_rng(0)
    for _ in range(200):
        a, b = r.integers(0, 6, r.integers(1, 20)), r.integers(0, 6, r.integers(0, 30))
        assert decontaminate.common(decontaminate.masks_of(a), len(a), b.tolist()) == slow(a.tolist(), b.tolist())


def test_html(spark):
    page = '<html><head><title>T</title></head><body><nav><a href="/x">Menu</a></nav><article><h1>Head &amp; line</h1><p>First  one<br>more text here, and more.<p>Second&nbsp;block of words, long enough.</article><form>Search</form><footer>&copy; x</footer></body></html>'
    many = [(k, f"http://h/{k}", page.replace("First", prose(12)).replace("Second", prose(9))) for k in range(60)]
    rows = [*many, (100, None, None), (101, "u", ""), (102, "u", "no markup"), (103, "u", "<div><p>unclosed")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Head & line\n" + " ".join(f"{many[7][2].split('<p>')[1]}".replace("<br>", " ").split()) + "\n"
    assert got[7]["text"].startswith(want) and "Menu" not in got[7]["text"] and "©" not in got[7]["text"] and "Search" not in got[7]["text"]
    assert got[100]["text"] == got[101]["text"] == "" and got[7]["n_chars"] == len(got[7]["text"])


def test_pipeline_stages(spark, docs, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, prose(20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, none):
        table.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        columns = table.columns
        kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, kept, str(tmp_path))
            assert after.columns == columns and after.count() <= kept.count(), name
            kept = after
        assert set(columns) < set(corpus_pipeline.run(spark, str(tmp_path)).columns)
