"""LM scoring: Katz backoff of order two over words, with Good-Turing discounts.

Tokens are the words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) and one end of text; a text's first context is its beginning.
Counts up to K are discounted by Good-Turing, for bigrams and for words; the words' missing mass is the probability of
any unknown word. p(w | h) = d c(hw) / (c(h) + EPS) if hw was seen, else backoff(h) p(w), where backoff(h) is exactly what
makes the sum over all words and the unknown one 1; EPS keeps it positive where no count of h is discounted.

Nothing is sent to all executors but the discounts and words so frequent that there are few of them. Words are 48-bit
hashes. Word counts are gathered in buckets of words. Bigram occurrences are dealt by their second word (frequent ones also
by the first), as packed sorted arrays; such a bucket knows c(w), p(w) and c(hw) of its bigrams and gives each document
its sum. Only unseen bigrams need the backoff weight of their first word: they go on, with each context's numbers of bigrams
by count and the mass of its seen words, to buckets of contexts. The bigrams' discounts are known only when all buckets
are done, so sums leave them out and numbers of bigrams by count travel beside: occurrences are dealt once and never
written. Word counts, bigram counts and backoff weights are written to tables partitioned by bucket or kind.

Edge cases: null counts as an empty text, which has one token (its end); a null id is learned from by the remainder of
the empty string; with no training text every token has probability 1; rows that repeat an id, or have none, are scored each by
its own text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.llm.bytetext import buffers, lowered, mix, slices, word_hashes, word_spans
from lorefold.llm.shared import id_remainder, partitions, written

K, EPS = 5, 0.01
FLUSH = 900_000  # tokens a block
BUCKET_CHARS = 24 << 20  # of texts, about, whose bigrams one task counts at once
END, BEGIN = np.uint64(1), np.uint64(2)
_BITS = np.uint64(16)


def packed(x: np.ndarray, width: int = 0) -> bytes:
    """An array as compressed bytes; with width, integers of so many bytes."""
    raw = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() if width else x.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(blob, dtype, width: int = 0) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob.as_py() if hasattr(blob, "as_py") else blob)
    if not width:
        return np.frombuffer(raw, dtype)
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def tokens_of(batches):
    """Yields (row numbers, tokens, contexts, row of each token, table) of blocks of rows; ends and beginnings set in."""
    for batch in batches:
        data, offs = buffers(batch.column("t"))
        for a, b in slices(offs):
            part, o = lowered(data[offs[a] : offs[b]]), offs[a : b + 1] - offs[a]
            starts, ends, counts = word_spans(part, o)
            words = (word_hashes(part, starts, ends) >> _BITS) | np.uint64(4)
            n = counts + 1
            last = np.cumsum(n)
            token = np.empty(int(last[-1]), np.uint64)
            inner = np.ones(len(token), bool)
            inner[last - 1] = False
            token[last - 1], token[inner] = END, words
            context = np.concatenate((np.zeros(1, np.uint64), token[:-1]))
            context[last - n] = BEGIN
            yield batch.slice(a, b - a), token, context, np.repeat(np.arange(b - a), n)


def blocks_of(batches, limit: int = FLUSH):
    """tokens_of in larger blocks: (ids, train, tokens, contexts, row)."""
    held, n = [], 0

    def join():
        ids = np.concatenate([h[0].column("row").to_numpy() for h in held])
        train = np.concatenate([h[0].column("train").to_numpy(zero_copy_only=False) for h in held])
        base = np.cumsum([0, *[h[0].num_rows for h in held[:-1]]])
        return ids, train, *(np.concatenate([h[k] for h in held]) for k in (1, 2)), np.concatenate([h[3] + b for h, b in zip(held, base, strict=True)])

    for x in tokens_of(batches):
        held.append(x)
        n += len(x[1])
        if n >= limit:
            yield join()
            held, n = [], 0
    if held:
        yield join()


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(x) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def word_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket of training words: words, counts, number of tokens and types, counts of counts, the largest."""

    def make(batches):
        for _, train, token, _, row in blocks_of(batches):
            word, n = np.unique(token[train[row]], return_counts=True)
            bucket = bucket_of(word, buckets)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            parts = [(k, order[edge[k] : edge[k + 1]]) for k in range(buckets) if edge[k] < edge[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in parts], pa.int32()), pa.array([packed(word[o], 6) for _, o in parts], pa.binary()), pa.array([packed(n[o].astype(np.uint32)) for _, o in parts], pa.binary())],
                ["bucket", "w", "n"],
            )

    def add(table: pa.Table) -> pa.Table:
        word = np.concatenate([unpacked(x, np.uint64, 6) for x in table.column("w")])
        n = np.concatenate([unpacked(x, np.uint32) for x in table.column("n")])
        word, back = np.unique(word, return_inverse=True)
        n = np.bincount(back, n).astype(np.int64)
        top = np.argsort(-n)[:256]
        return pa.table(
            {
                "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
                "w": pa.array([packed(word, 6)], pa.binary()),
                "c": pa.array([packed(n)], pa.binary()),
                "tokens": [int(n.sum())],
                "types": [len(n)],
                "cc": [np.bincount(n[n <= K + 1], minlength=K + 2).tolist()],
                "top_w": [word[top].astype(np.int64).tolist()],
                "top_n": [n[top].tolist()],
            }
        )

    blobs = rows.select("row", "train", "t").mapInArrow(make, "bucket int, w binary, n binary")
    return blobs.groupBy("bucket").applyInArrow(
        add, "bucket int, w binary, c binary, tokens long, types long, cc array<long>, top_w array<long>, top_n array<long>"
    )


def discounts(cc: np.ndarray) -> np.ndarray:
    """d[r] for counts 0..K+1 from counts of counts; 1 above K. Half a count where Good-Turing gives no proper discount."""
    d = np.ones(K + 2)
    n = cc.astype(float)
    if n[1] > 0:
        tail = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            ok = n[r] > 0 and tail < 1
            v = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if ok else 0
            d[r] = v if 0 < v < 1 else 1 - 0.5 / r
    else:
        d[1 : K + 1] = [1 - 0.5 / r for r in range(1, K + 1)]
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * d[np.minimum(c, K + 1)]


def dealt(rows: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Bigram occurrences by bucket: sorted second words with run lengths, first words, rows."""

    def make(batches):
        for ids, train, token, context, row in blocks_of(batches):
            key = token.copy()
            if len(hot):
                at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                salted = hot[at] == token
                key[salted] ^= mix(context[salted])
            bucket = bucket_of(key, buckets)
            order = np.lexsort((context, token, bucket))
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [[] for _ in range(7)]
            for k in range(buckets):
                o = order[edge[k] : edge[k + 1]]
                if not len(o):
                    continue
                t = token[o]
                head = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                docs, back = np.unique(row[o], return_inverse=True)
                values = (k, packed(t[head], 6), packed(np.diff(np.append(head, len(t))).astype(np.uint32)), packed(context[o], 6), packed(back.astype(np.uint16 if len(docs) <= 65535 else np.uint32)), packed(np.diff(ids[docs], prepend=0)), packed(train[docs].astype(np.uint8)))
                for c, v in zip(out, values, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "w", "len", "h", "at", "docs", "train"]
            )

    return rows.select("row", "train", "t").mapInArrow(
        make, "bucket int, w binary, len binary, h binary, at binary, docs binary, train binary"
    )


def opened(table: pa.Table):
    """(second words, first words, document index, document ids, in training) of a bucket's blobs."""
    w, h, at, docs, train, base = [], [], [], [], [], 0
    for k in range(table.num_rows):
        get = lambda c, *a: unpacked(table.column(c)[k], *a)  # noqa: B023, E731
        ids, flags = np.cumsum(get("docs", np.int64)), get("train", np.uint8)
        w.append(np.repeat(get("w", np.uint64, 6), get("len", np.uint32)))
        h.append(get("h", np.uint64, 6))
        at.append(get("at", np.uint16 if len(ids) <= 65535 else np.uint32).astype(np.int64) + base)
        docs.append(ids)
        train.append(flags)
        base += len(ids)
    return *(np.concatenate(x) for x in (w, h, at, docs)), np.concatenate(train) > 0


LOW = [f"c{r}" for r in range(1, K + 1)]  # columns of numbers of bigrams of count r


def by_document(docs: np.ndarray, at: np.ndarray, groups: int, low: np.ndarray | None = None, **sums: np.ndarray) -> dict:
    """Sums by document, as one blob a document group; low: counts up to K (else 0), whose numbers are returned too."""
    ids, back = np.unique(docs, return_inverse=True)
    of = back[at]
    values = {k: np.bincount(of, v, len(ids)) for k, v in sums.items()}
    if low is not None:
        of *= K + 1
        of += low
        values |= zip(LOW, np.bincount(of, minlength=len(ids) * (K + 1)).reshape(-1, K + 1).T[1:], strict=True)
    group = bucket_of(ids.astype(np.uint64), groups)
    order = np.argsort(group, kind="stable")
    edge = np.searchsorted(group[order], np.arange(groups + 1))
    parts = [(k, order[edge[k] : edge[k + 1]]) for k in range(groups) if edge[k] < edge[k + 1]]
    out = {"g": [k for k, _ in parts], "docs": [packed(np.diff(ids[o], prepend=0)) for _, o in parts]}
    return out | {k: [packed(v[o].astype(float if k in ("base", "score") else np.uint32)) for _, o in parts] for k, v in values.items()}


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(4, partitions(spark), chars // BUCKET_CHARS)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), train.alias("train"), F.col(text).alias("t"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "train", "t"))  # rows of one number are equal
    words = written(word_counts(rows, buckets), "katz-words", ["bucket"])
    facts = words.agg(
        F.sum("tokens"), F.sum("types"), *[F.sum(F.col("cc")[r]) for r in range(K + 2)]
    ).first()
    N, V = facts[0] or 0, facts[1] or 0
    d1 = discounts(np.array([x or 0 for x in facts[2:]]))
    cc1 = np.array([x or 0 for x in facts[2:]], float)
    unknown = (sum(r * cc1[r] * (1 - d1[r]) for r in range(1, K + 1)) / N) if N else 1.0
    unknown = max(unknown, 0.5 / (N + 1))
    scale = 1.0 if not N else (1 - unknown) / (1 - sum(r * cc1[r] * (1 - d1[r]) for r in range(1, K + 1)) / N)
    top = words.select(F.explode(F.arrays_zip("top_w", "top_n")).alias("x")).select("x.*").where(F.col("top_n") * (4 * buckets) > N)
    hot_rows = sorted((r["top_w"], r["top_n"]) for r in top.collect())  # at most 4 * buckets words
    hot, hot_n = np.array([r[0] for r in hot_rows], np.uint64), np.array([r[1] for r in hot_rows], np.int64)

    def counts_in(table: pa.Table):
        w, h, at, ids, flags = opened(table)
        order = np.lexsort((h, w))
        w, h, at = w[order], h[order], at[order]
        new_w = np.concatenate(([True], w[1:] != w[:-1]))
        new = new_w | np.concatenate(([True], h[1:] != h[:-1]))
        head_w, head = np.flatnonzero(new_w), np.flatnonzero(new)
        learned = flags[at].astype(np.int64)
        cw = np.add.reduceat(learned, head_w)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, w[head_w]), len(hot) - 1)
            cw = np.where(hot[place] == w[head_w], hot_n[place], cw)
        c2 = np.add.reduceat(learned, head)
        return w, h, at, ids, head_w, head, cw, c2

    blank = ["docs", "known", "base", "score", "h", "s", "c", *LOW]
    names = ["kind", "g", "cc", *blank]
    kinds = "kind int, g int, cc array<long>, " + ", ".join(f"{c} binary" for c in blank)

    def parts(table: pa.Table) -> pa.Table:
        w, h, at, ids, head_w, head, cw, c2 = counts_in(table)
        run_w, run = np.diff(np.append(head_w, len(w))), np.diff(np.append(head, len(w)))
        p1 = np.where(cw > 0, discounted(cw, d1) * scale / max(N, 1), unknown)
        log_p1, cw_all = np.repeat(np.log10(p1), run_w), np.repeat(cw, run_w)
        c_all = np.repeat(c2, run)
        seen = c_all > 0
        value = np.where(seen, np.log10(np.maximum(c_all, 1)), log_p1)
        value -= np.where((w != END) & (cw_all > 0), np.log10(cw_all + EPS), 0)  # the word as the next one's context
        base = np.log10((cw_all + 1) / (N + V + 1))
        low = np.where(c_all <= K, c_all, 0).astype(np.uint8)
        out = by_document(ids, at, buckets, low, known=cw_all > 0, base=base, score=value)
        size = len(out["g"])
        rows_ = {k: out.get(k, [None] * size) for k in names} | {"kind": [0] * size}
        # contexts: mass of seen words, count, numbers of bigrams by count
        typed = c2 > 0
        hs, s, c = h[head][typed], p1[np.searchsorted(head_w, head[typed], side="right") - 1], c2[typed]
        u, back = np.unique(hs, return_inverse=True)
        sums = {k: np.bincount(back, x, len(u)) for k, x in (("s", s), ("c", c), *((k, c == r) for r, k in enumerate(LOW, 1)))}
        lost, lost_doc = h[~seen], ids[at[~seen]]
        for kind, key in ((1, u), (2, lost)):
            bucket = bucket_of(key, buckets)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in range(buckets):
                o = order[edge[k] : edge[k + 1]]
                if not len(o):
                    continue
                row = dict.fromkeys(names) | {"kind": kind, "g": k, "h": packed(key[o], 6)}
                if kind == 1:
                    row |= {n: packed(x[o].astype(float if n == "s" else np.uint32)) for n, x in sums.items()}
                else:
                    row |= {"docs": packed(lost_doc[o])}
                for n in names:
                    rows_[n].append(row[n])
        counted = {"kind": 4, "g": 0, "s": packed(w[head][typed], 6), "h": packed(hs, 6), "c": packed(c.astype(np.uint32))}
        for n in names:
            rows_[n].append(counted.get(n))
        cc = np.bincount(c2[(c2 > 0) & (c2 <= K + 1)], minlength=K + 2).tolist()
        for n in names:
            rows_[n].append({"kind": 3, "g": 0, "cc": cc}.get(n))
        types = {"kind": pa.int32(), "g": pa.int32(), "cc": pa.list_(pa.int64())}
        return pa.table(rows_, schema=pa.schema([(n, types.get(n, pa.binary())) for n in names]))

    made = written(dealt(rows, buckets, hot).groupBy("bucket").applyInArrow(parts, kinds), "katz-bigrams", ["kind"])
    cc2 = made.where("kind = 3").agg(*[F.sum(F.col("cc")[r]) for r in range(K + 2)]).first()
    d2 = discounts(np.array([x or 0 for x in cc2]))

    col = lambda t, c, *a: np.concatenate([np.zeros(0, a[0]), *[unpacked(x, *a) for x in t.column(c)]])

    def weigh(table: pa.Table) -> pa.Table:
        u, back = np.unique(col(table, "h", np.uint64, 6), return_inverse=True)
        s, c, *by_count = (np.bincount(back, col(table, x, float if x == "s" else np.uint32), len(u)) for x in ("s", "c", *LOW))
        m = sum(r * (1 - d2[r]) * n for r, n in enumerate(by_count, 1))  # discounted mass
        # what the context adds where it backs off: its count's logarithm, taken off before, and its weight
        weight = np.log10((m + EPS) / (c + EPS) / np.maximum(1 - s, 1e-9)) + np.log10(c + EPS)
        return pa.table({"g": table.column("g").slice(0, 1), "u": pa.array([packed(u, 6)], pa.binary()), "weight": pa.array([packed(weight)], pa.binary())})

    contexts = made.where("kind = 1").select("g", "h", "s", "c", *LOW).groupBy("g")
    weights = written(contexts.applyInArrow(weigh, "g int, u binary, weight binary"), "katz-weights", ["g"])

    def backed(known: pa.Table, asked: pa.Table) -> pa.Table:
        u, weight = col(known, "u", np.uint64, 6), col(known, "weight", float)
        q, docs = col(asked, "h", np.uint64, 6), col(asked, "docs", np.int64)
        if not len(q):
            return pa.table({"g": pa.array([], pa.int32()), "docs": pa.array([], pa.binary()), "score": pa.array([], pa.binary())})
        place = np.minimum(np.searchsorted(u, q), max(len(u) - 1, 0))
        value = np.where(u[place] == q, weight[place], 0) if len(u) else np.zeros(len(q))
        out = by_document(docs, np.arange(len(docs)), buckets, score=value)
        return pa.table({"g": pa.array(out["g"], pa.int32()), "docs": pa.array(out["docs"], pa.binary()), "score": pa.array(out["score"], pa.binary())})

    asked = made.where("kind = 2").select("g", "h", "docs").groupBy("g")
    later = weights.select("g", "u", "weight").groupBy("g").cogroup(asked).applyInArrow(backed, "g int, docs binary, score binary")
    nothing = F.lit(None).cast("binary")
    all_parts = made.where("kind = 0").select("g", "docs", "known", "base", "score", *LOW).union(
        later.select("g", "docs", nothing.alias("known"), nothing.alias("base"), "score", *[nothing.alias(c) for c in LOW])
    )

    def summed(table: pa.Table) -> pa.Table:
        ids, known, base, value = [], [], [], []
        for k in range(table.num_rows):
            i = np.cumsum(unpacked(table.column("docs")[k], np.int64))
            ids.append(i)
            some = table.column("known")[k].is_valid
            cut = sum(unpacked(table.column(c)[k], np.uint32) * np.log10(d2[r]) for r, c in enumerate(LOW, 1)) if some else 0
            value.append(unpacked(table.column("score")[k], float) + cut)
            known.append(unpacked(table.column("known")[k], np.uint32) if some else np.zeros(len(i)))
            base.append(unpacked(table.column("base")[k], float) if some else np.zeros(len(i)))
        u, back = np.unique(np.concatenate(ids), return_inverse=True)
        known, base, value = (np.bincount(back, np.concatenate(x), len(u)) for x in (known, base, value))
        return pa.table({"row": u, "n_known": known.astype(np.int64), "base_score": base, "score": value})

    sums = all_parts.groupBy("g").applyInArrow(summed, "row long, n_known long, base_score double, score double")
    begins = rows.where("train").count()
    first = float(-np.log10(begins + EPS)) if begins else 0.0

    def lengths(batches):
        for batch in batches:
            data, offs = buffers(batch.column("t"))
            n = [word_spans(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])[2] + 1 for a, b in slices(offs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("train"), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))],
                ["row", "doc_id", "train", "n_tokens"],
            )

    sized = rows.select("row", "doc_id", "train", "t").mapInArrow(lengths, "row long, doc_id long, train boolean, n_tokens long")
    same = sized.groupBy("row").agg(F.count("*").alias("same"))  # equal rows, whose sums are of all of them
    return sized.join(sums.join(same.hint("merge"), "row").hint("merge"), "row").select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") / F.col("same")).cast("long").alias("n_known"),
        F.lit(int(N)).cast("long").alias("train_tokens"),
        (F.col("base_score") / F.col("same")).alias("base_score"),
        (F.col("score") / F.col("same") + first).alias("score"),
    )


def op5_katz_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, id_remainder(F.col("doc_id"), 7) != 2)
