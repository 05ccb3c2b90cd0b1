"""Prefix tree, ranked lexical search and spelling variants against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log

import pytest

from lorefold.llm import lexical_rank as LR
from lorefold.llm import prefix_tree as PT
from lorefold.llm import spelling as SP

# ---- prefix tree ----

TEXTS = ["a", "bb\\", "c<s>", "</s>", "[INST]\n", "é😀", "", "\\n", "<<SYS>><", "</", "<|im_end|>", "<<s>"]
ROLES = ["user", "assistant", None, "a\nb", "x\\n", "</s>"]


def escape(s):
    s = s.replace("\\", "\\\\")
    return "".join(c + ("\\" if c in "<[" and any(s[k + 1 :].startswith(x[1:]) for x in PT.CONTROL) else "") for k, c in enumerate(s))


def segment(role, text):
    return "<s>" + escape(role or "").replace("\n", "\\n") + "\n" + escape(text or "") + "</s>"


def in_order(rows):
    """Turns by conversation: a null number first, equal numbers by the digest of the formatted turn."""
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(segment(r, x).encode()).hexdigest(), r or "", x or ""))
    return {c: [v[3:] for v in sorted(rows)] for c, rows in out.items()}


def made_up(seed, n):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.choice([1, 2, 3, 4, 9])):
            role = rnd.choice(ROLES) if rnd.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((c if c != 5 else None, None if (c, t) == (7, 0) else t, role, rnd.choice(TEXTS[: 2 if t < 2 else 12]) if rnd.random() < 0.95 else None))
    return rows + rows[3:5] + [(n + 1, 0, "user", "a")] * 4  # repeated rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_tree_against_brute_force(spark, seed):
    rows = made_up(seed, 90)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", node string, depth int")  # clashing names
    nodes, members = PT.prefix_tree(PT.turns_of(df))
    node = {r.node: r for r in nodes.collect()}
    paths = {}
    for r in members.collect():
        paths.setdefault(r.conv, []).append((r.depth, r.node))
    full, ends = "", {}
    for r in sorted(node.values(), key=lambda r: r.start):
        assert (r.start, r.size) == (len(full), len(r.segment))
        full += r.segment
    want, seen, below = in_order(rows), {}, {}
    for c, turns in want.items():
        segments = [segment(*t) for t in turns]
        mine = [n for _, n in sorted(paths[c])]
        assert [node[n].segment for n in mine] == segments
        for k, n in enumerate(mine):
            assert seen.setdefault(tuple(segments[: k + 1]), n) == n
            for m in mine[k:]:
                below.setdefault(n, set()).add(m)
            spans = node[n].ancestors
            assert "".join(full[x.start : x.end] for x in spans) == "".join(segments[:k])
            assert node[n].position == sum(map(len, segments[:k])) and node[n].tree == node[mine[0]].tree
            assert all(x.end < y.start for x, y in zip(spans, spans[1:], strict=False))
    assert len(seen) == len(node)
    for n, under in below.items():  # depth-first: a subtree is one interval
        ends = sorted((node[m].start, node[m].start + node[m].size) for m in under)
        assert ends[0][0] == node[n].start and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    for n in node:
        assert node[n].conversations == sum(n in [m for _, m in p] for p in paths.values())


def test_op11_reads_back_every_turn(spark, tmp_path):
    rows = [r for r in made_up(4, 40) if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    odd = "</s>[INST] ok [/INST]"
    want = in_order([*rows, (-1, 0, "user", odd), (-1, 1, "assistant", odd)])
    got = {r.conv_id: r for r in PT.op11_chat(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in want.items():
        learned = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))
        assert r.formatted_chars == sum(len(segment(*t)) for t in turns)


def test_long_conversation_and_its_beginnings(spark):
    """A conversation of 300 turns of which others are beginnings: one chain, attended to as one interval."""
    rows = [(c, t, "user", f"t{t}") for c, n in ((1, 300), (2, 120), (3, 299)) for t in range(n)]
    nodes, members = PT.prefix_tree(PT.turns_of(spark.createDataFrame(rows, SCHEMA)))
    got = nodes.collect()
    assert len(got) == 300 and members.count() == 719
    assert all(len(r.ancestors) == (r.depth > 1) for r in got)
    assert PT.prefix_tree(PT.turns_of(spark.createDataFrame([], SCHEMA)))[0].count() == 0


# ---- ranked lexical search ----

WORDS = ["the", "a", "Ähre", "ähre", "x1", "é", "ZEBRA", "zebra", "lamp", "of", "und", "q" * 40, *(f"w{k}" for k in range(60))]


def ranked(docs, items, k):
    """Brute force: [(item_id, rank, doc_id, score)]."""
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    docs = [(k, " ".join(rnd.choices(WORDS, weights=[9, 9] + [1] * (len(WORDS) - 2), k=rnd.choice([1, 5, 30, 200])))) for k in range(n)]
    docs += [(n + k, docs[3][1]) for k in range(40)]  # equal texts: ties
    docs += [(None, "zebra lamp"), (2, "zebra lamp"), (2, "zebra lamp"), (n + 50, None), (n + 51, ""), (n + 52, " .,- "), (n + 53, "zebra " * 3000 + "lamp")]
    return docs


@pytest.mark.parametrize("k", [3, 50])
def test_lexical_rank_against_brute_force(spark, k):
    docs, rnd = corpus(5, 150), random.Random(8)
    items = [(k, " ".join(rnd.choices(WORDS, k=6))) for k in range(12)] + [(3, "zebra, LAMP!"), (90, None), (91, "!!"), (92, "unheardof"), (93, "zebra zebra lamp")]
    d = spark.createDataFrame([(*x, "en", 1) for x in docs], "doc_id long, text string, item string, rank int")
    got = LR.search(d, LR.build(d), spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda x: (x[0], x[1], x[3], str(x[2]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(ranked(docs, items, k), key=key)


def test_lexical_rank_in_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(LR, "BLOCK", 8)
    docs, rnd = corpus(6, 60), random.Random(9)
    items = [(k, " ".join(rnd.choices(WORDS, k=4))) for k in range(25)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda x: (x[0], x[1], x[3], str(x[2]))
    assert sorted(map(tuple, LR.search(d, LR.build(d), q, 5).collect()), key=key) == sorted(ranked(docs, items, 5), key=key)
    none = d.where("false")
    assert LR.search(none, LR.build(none), q, 5).count() == 0
    assert LR.search(d, LR.build(d), q.where("false"), 5).count() == 0


def test_sketches_bound_from_above():
    """No cell is below its terms' tf, whatever else falls there."""
    import numpy as np

    rng = np.random.default_rng(1)
    distinct = np.array([1, 7, 300, 5000])
    hashes = rng.integers(0, 2**63, int(distinct.sum()), dtype=np.uint64)
    tf = np.minimum(rng.zipf(1.3, len(hashes)), 2_000_000)
    at = 0
    for blob, n in zip(LR.sketched(hashes, tf, distinct), distinct.tolist(), strict=True):
        cells = LR.DECODED[np.frombuffer(blob, np.uint8)]
        assert len(cells) >= max(64, LR.CELLS * n)
        for place in LR.places(hashes[at : at + n], len(cells)):
            assert (cells[place] >= tf[at : at + n]).all()
        at += n


# ---- spelling variants ----


def variants(counts, min_length, min_count, ratio):
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in words if v != w and one(v, w)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= ratio * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def found(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_against_brute_force(spark, seed):
    """Few letters, so that words are near each other; repeated letters; common beginnings longer than several blocks."""
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choices("abÿé", k=n))
    words = {word(rnd.choice([6, 6, 7, 8, 13])) for _ in range(150)}
    long = word(47)
    for base in [long, long[:30], *list(words)[:40]]:
        for _ in range(6):
            k = rnd.randrange(len(base) + 1)
            words.add(rnd.choice([base[:k] + rnd.choice("abz") + base[k:], base[:k] + base[k + 1 :], base[:k] + "z" + base[k + 1 :]]))
    counts = {w: rnd.choice([4, 5, 6, 30, 31, 160, 900]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(SP.variants(df)) == variants(counts, 6, 5, 5)


def test_spelling_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(11)
    base = ["Straßenlampe", "straßenlampe", "zebrastreifen", "zebrastreifem", "Über×÷ÿx", "kurz", "ZEBRASTREIFEN", "straßenlampen"]
    docs = [(k, " ".join(rnd.choices(base, weights=[3, 9, 9, 1, 2, 2, 1, 2], k=60)) + ".zebrastreifen9") for k in range(200)] + [(None, "straßenlampe 1 x"), (3, None), (4, ""), (5, "zebrastreifen " * 5000)]
    spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n long").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = found(SP.op13_spelling(spark, str(tmp_path)))
    assert got == variants(counts, 6, 5, 5) and len(got) > 6
    assert SP.variants(spark.createDataFrame([], "word string, n long")).count() == 0


# ---- page text: nothing is lost behind what is not closed ----


def shown(source):
    from lorefold.llm import html_text

    return [t for _, t in html_text.blocks_of(html_text.parse(source))]


def test_pages_lose_nothing_behind_unclosed_elements():
    want = ["Long body of the page.", "More of it."]
    body = "<body><article><p>Long body of the page.<p>More of it.</article></body></html>"
    assert shown(f"<html><head><title>t</title>{body}") == want
    assert shown(f"<html><head><meta charset=x><title>t</title></head>{body}") == want
    for odd in ("svg", "noscript", "template", "iframe", "textarea", "SVG"):
        assert shown(f"<html><{odd} class='a>b'>{body}") == want
        assert shown(f"<html><{odd}/>{body}") == want
        assert shown(f"<html><{odd}>gone<p>too</{odd.lower()} >{body}") == want
    assert shown(f"<html><script>if (a<b) x('<p>')</script>{body}") == want
    assert shown("<p>before<script>code <p>never ends") == ["before"]
    assert shown("<p>" + "<svg>" * 20000 + "end") == ["end"]


def test_attribute_words_are_read_to_their_end():
    from lorefold.llm import html_text

    long = html_text.parse(f'<div class="{"x " * 2000}navbar"><p>a')
    assert long.names[1] & (1 << html_text._GROUP_OF["navbar"])


# ---- queries over tables with null and repeated ids and clashing columns ----


def test_queries_bear_odd_tables(spark, tmp_path):
    from lorefold.llm.queries import QUERIES

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    texts = [" ".join(word() for _ in range(rnd.choice([1, 8, 60]))) for _ in range(24)] + [None, "", "  \n\t", "same words in both rows here", "same words in both rows here", "x" * 30_000]
    rows = [(k if k % 7 else None, t, "ab"[k % 2] if k % 5 else None, "s", 1, "v", 2.0) for k, t in enumerate(texts)]
    rows += [(3, "another text of a repeated id", "a", "s", 1, "v", 2.0), rows[3], rows[3]]
    extra = ("fingerprint", "component_id", "score", "n_tokens", "target", "rank", "word", "h", "node", "row")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, size double")
    df = df.selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(extra)])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op3_fingerprint", "op4_mixing", "op5_katz_scores", "op6_ngram_join", "op8_language_id", "op9_token_count"):
        out = QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows), name
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("op3_fingerprint", "op4_mixing", "op5_katz_scores", "op6_ngram_join", "op8_language_id", "op9_token_count", "op13_spelling"):
        assert QUERIES[name](spark, f"{tmp_path}/none").count() == 0, name
