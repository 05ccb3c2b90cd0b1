"""N-gram Jaccard join: universe partition with pigeonhole, exact for every pair at the threshold 0.75.

A text's set is its distinct runs of five words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased; a shorter text is one run).
Two sets link when 100 * intersection >= 75 * union; their symmetric difference is then at most (|A| + |B|) / 7.

Sizes fall into bands, each upper limit 4/3 of the one before, so that partners lie in neighbouring bands. A band's
universe is cut into about 0.42 segments a token by the top bits of the token hash. A set indexes each segment's subset in
its own band and, in bands of small sets, the subset's one-deletion neighbours. It probes in its own band (for partners
that are no larger) and in the band below: with d the greatest difference, segments are allotted 1 (equal subsets) or 2
(at most one token apart, by the neighbourhoods of either side) until the allotments exceed d, so that some segment
must match. Allotments are by cost: what a bounded sample tells of frequent tokens makes subsets of such tokens dear,
and long subsets cheap. The sample changes the cost only, never the result.

Signatures travel as packed arrays by hash bucket; a bucket yields the groups of sets that share one, each once. In each of
a few rounds a group meets one of its members, another one each time, and groups that are joined up are left out; what then still
is apart meets the group's other sets, but for those joined up with it. Pairs are kept out by a lossless bound first: a bit for each of
512 classes of tokens tells whether a set has an odd number of them, so sets differ in at least as many tokens as
bits. The rest is compared exactly, with the sets side by side.

Edge cases: null, empty and blank texts have an empty set, link with nothing and are components of their own; equal sets
are one node and hence linked; ids that repeat share a row's fate (the component is that of its least set);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorefold.llm.bytetext import buffers, distinct_per_row, lowered, mix, shingle_hashes, slices, word_hashes, word_spans
from lorefold.llm.shared import discard, free_names, joined_up, partitions, relabelled, written

SEGMENTS = 0.42  # a token
DELETIONS_TO = 256  # greatest set size of the bands that index one-deletion neighbours
SAMPLE_ROWS = 8_000  # for the cost of frequent tokens
SAMPLE_SHARE = 0.004
FLUSH = 600_000
BUCKET_BYTES = 96 << 20  # of signatures, about, that one task matches at once
ROUNDS = 4
BEFORE = 20  # groups before one in the order of gid of which a set brings some
PARITY = [f"p{k}" for k in range(8)]
PROBE, INDEX = 1, 2
_limits = [1]
while _limits[-1] < 1 << 40:
    _limits.append(-(-_limits[-1] * 4 // 3))
LIMITS = np.array(_limits)
_MINUS = np.uint64(0xD6E8FEB86659FD93)


def token_sets(column: pa.Array):
    """Yields (first row, last row, tokens, number by row): the rows' sets, ascending within a row."""
    data, offs = buffers(column)
    for a, b in slices(offs):
        part, o = lowered(data[offs[a] : offs[b]]), offs[a : b + 1] - offs[a]
        starts, ends, counts = word_spans(part, o)
        yield a, b, *distinct_per_row(*shingle_hashes(word_hashes(part, starts, ends), counts))


def nodes_of(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row's set (0 for the empty one)."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(77)), dtype=np.uint64)))
    ends = np.cumsum(counts)
    digest = mix((sums[ends] - sums[ends - counts]) ^ (counts.astype(np.uint64) << np.uint64(32)))
    digest[counts == 0] = 0
    return digest


def parities(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """512 bits a set that isn't empty: each token flips one, so two sets differ in at least as many tokens as bits."""
    place = mix(tokens ^ np.uint64(191)) >> np.uint64(55)
    bits = np.zeros((len(tokens), len(PARITY)), np.uint64)
    bits[np.arange(len(tokens)), (place >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (place & np.uint64(63))
    some = counts[counts > 0]
    return np.bitwise_xor.reduceat(bits, np.cumsum(some) - some, axis=0) if len(some) else bits


def signatures(tokens: np.ndarray, hot: np.ndarray, dear: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, flags) of one set; hot: frequent tokens, ascending, with their shares dear."""
    n = len(tokens)
    band = int(np.searchsorted(LIMITS, n))
    salted = mix(tokens)
    cost_of = np.full(n, 1e-6)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        cost_of = np.where(hot[at] == tokens, dear[at], cost_of)
    top = tokens >> np.uint64(32)
    sigs, flags = [], []
    for scheme in (band, band - 1):
        if scheme < 0:
            continue
        limit = int(LIMITS[scheme])
        own = scheme == band
        if not own and 3 * n > 4 * limit:
            continue
        apart = 2 * n // 7 if own else (n + limit) // 7
        m = int(SEGMENTS * limit) + 2
        segment = ((top * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        length = np.diff(np.append(heads, n))
        sums = np.add.reduceat(salted, heads)
        name = mix((segment[heads].astype(np.uint64) << np.uint64(8)) | np.uint64(scheme))
        full = mix(sums ^ name)
        cost = np.minimum.reduceat(cost_of, heads)
        order = np.lexsort((-length, cost))
        probing = np.zeros(len(heads), bool)
        probing[order[: apart + 1]] = True
        short = apart + 1 - len(heads)
        rest = np.repeat(sums, length) - salted
        names = np.repeat(name, length)
        small = limit <= DELETIONS_TO
        if own:
            sigs.append(full)
            flags.append(np.where(probing, PROBE | INDEX, INDEX))
            if small:
                sigs.append(mix(rest ^ names ^ _MINUS))
                flags.append(np.full(n, INDEX))
        else:
            sigs.append(full[probing])
            flags.append(np.full(int(probing.sum()), PROBE))
        empty = mix((np.setdiff1d(np.arange(m), segment[heads]).astype(np.uint64) << np.uint64(8)) | np.uint64(scheme))
        if short > 0:
            twice = order[:short] if small else order[:0]
            inside = np.isin(np.repeat(np.arange(len(heads)), length), twice)
            none = short - len(twice)
            for s in (mix(sums[twice] ^ name[twice] ^ _MINUS), mix(rest[inside] ^ names[inside]), mix(empty[:none])):
                sigs.append(s)
                flags.append(np.full(len(s), PROBE))
        if own:
            sigs.append(mix(empty))
            flags.append(np.full(len(empty), INDEX))
    return np.concatenate(sigs), np.concatenate(flags).astype(np.uint8)


def frequent_tokens(docs: DataFrame, total: int, doc_id: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in at least SAMPLE_SHARE of a sample of about SAMPLE_ROWS rows, ascending, with their shares."""
    take = F.pmod(F.xxhash64(F.col(doc_id), F.lit(6)), F.lit(1 << 20)) < int(min(1, SAMPLE_ROWS / max(total, 1)) * (1 << 20))
    sample = docs.where(take).select(F.col(text).alias("t"))

    def count(batches):
        for batch in batches:
            for _, _, tokens, _ in token_sets(batch.column("t")):
                value, n = np.unique(tokens, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int32))], ["v", "n"])

    least = max(3, int(SAMPLE_SHARE * min(total, SAMPLE_ROWS)))
    table = sample.mapInArrow(count, "v long, n int").groupBy("v").agg(F.sum("n").alias("n")).where(f"n >= {least}")
    got = table.toPandas()  # no more rows than the sample's tokens / least
    value = got["v"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], got["n"].to_numpy(float)[order] / min(total, SAMPLE_ROWS) if len(got) else np.zeros(0)


def set_sizes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, n, node)."""

    def make(batches):
        for batch in batches:
            for a, b, tokens, counts in token_sets(batch.column("t")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(nodes_of(tokens, counts).view(np.int64))],
                    ["doc_id", "n", "node"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(make, "doc_id long, n long, node long")


def shared_groups(docs: DataFrame, text: str, hot: np.ndarray, dear: np.ndarray, tokens: int = 0) -> DataFrame:
    """Rows (gid, node, n, flags): groups of sets that share a signature which one of them probes; tokens: of all sets."""
    spark = docs.sparkSession
    buckets = max(2 * partitions(spark), 40 * tokens // BUCKET_BYTES)
    sent = spark.sparkContext.broadcast((hot, dear))

    def pack(sig, at, flag, nodes, sizes):
        bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = [[], [], [], [], [], []]
        for k in range(buckets):
            own = order[edges[k] : edges[k + 1]]
            if len(own):
                local, back = np.unique(at[own], return_inverse=True)
                for c, x in zip(out, (k, sig[own], nodes[local], sizes[local], back.astype(np.uint32), flag[own]), strict=True):
                    c.append(x if c is out[0] else x.tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "sig", "nodes", "sizes", "at", "flag"]
        )

    def make(batches):
        hot, dear = sent.value
        held, nodes, sizes, n = [], [], [], 0

        def flush():
            sig, flag, count = (np.concatenate(x) for x in zip(*held, strict=True))
            return pack(sig, np.repeat(np.arange(len(count)), count), flag, np.concatenate(nodes), np.concatenate(sizes))

        for batch in batches:
            for _, _, tokens, counts in token_sets(batch.column("t")):
                full = np.flatnonzero(counts)
                if not len(full):
                    continue
                ends = np.cumsum(counts)
                parts = [signatures(tokens[ends[r] - counts[r] : ends[r]], hot, dear) for r in full.tolist()]
                held.append((np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array([len(p[0]) for p in parts])))
                nodes.append(nodes_of(tokens, counts)[full])
                sizes.append(counts[full].astype(np.uint32))
                n += len(held[-1][0])
                if n >= FLUSH:
                    yield flush()
                    held, nodes, sizes, n = [], [], [], 0
        if held:
            yield flush()

    def match(table: pa.Table) -> pa.Table:
        sig, node, size, flag = [], [], [], []
        for row in table.to_batches():
            for s, ns, zs, at, f in zip(*(row.column(c) for c in ("sig", "nodes", "sizes", "at", "flag")), strict=True):
                at = np.frombuffer(at.as_buffer(), np.uint32)
                sig.append(np.frombuffer(s.as_buffer(), np.uint64))
                node.append(np.frombuffer(ns.as_buffer(), np.uint64)[at])
                size.append(np.frombuffer(zs.as_buffer(), np.uint32)[at])
                flag.append(np.frombuffer(f.as_buffer(), np.uint8))
        sig, node, size, flag = (np.concatenate(x) for x in (sig, node, size, flag))
        order = np.argsort(sig)
        sig = sig[order]
        head = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        count = np.diff(np.append(head, len(sig)))
        probed = np.maximum.reduceat(flag[order] & PROBE, head) > 0
        some = np.repeat((count > 1) & probed, count)
        order, group = order[some], np.repeat(np.arange(len(head)), count)[some]
        node, size, flag = node[order], size[order], flag[order]
        order = np.lexsort((node, group))
        node, size, flag, group = node[order], size[order], flag[order], group[order]
        if len(node):  # equal sets are one member
            first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (node[1:] != node[:-1]))))
            flag = np.bitwise_or.reduceat(flag, first)
            node, size, group = node[first], size[first], group[first]
        if len(node):
            head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            count = np.diff(np.append(head, len(node)))
            gid = mix(np.add.reduceat(mix(node ^ (flag.astype(np.uint64) << np.uint64(61))), head))
            _, one = np.unique(gid, return_index=True)
            wanted = np.zeros(len(head), bool)
            wanted[one] = count[one] > 1
            keep = np.repeat(wanted, count)
            gid = np.repeat(gid, count)[keep]
            node, size, flag = node[keep], size[keep], flag[keep]
        else:
            gid = np.zeros(0, np.uint64)
        return pa.table(
            {"gid": gid.view(np.int64), "node": node.view(np.int64), "n": size.astype(np.int64), "flags": flag.astype(np.int32)}
        )

    packed = docs.select(F.col(text).alias("t")).mapInArrow(
        make, "bucket int, sig binary, nodes binary, sizes binary, at binary, flag binary"
    )
    found = packed.groupBy("bucket").applyInArrow(match, "gid long, node long, n long, flags int")
    return found.dropDuplicates(["gid", "node"])


_APART = " + ".join(f"bit_count(a{c} ^ b{c})" for c in PARITY)  # no more than the tokens in which two sets differ


def near_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (u, v) those whose sets link, written; sets: (node, n, parities, tokens binary). Tokens are sent for pairs only that may link."""
    small = sets.select("node", "n", *PARITY)
    a = small.select(F.col("node").alias("u"), F.col("n").alias("nu"), *[F.col(c).alias(f"a{c}") for c in PARITY])
    b = small.select(F.col("node").alias("v"), F.col("n").alias("nv"), *[F.col(c).alias(f"b{c}") for c in PARITY])
    pairs = pairs.select("u", "v").join(a.hint("merge"), "u").join(b.hint("merge"), "v").where(f"{_APART} <= (nu + nv) div 7")
    pairs = written(pairs.select("u", "v"), "pairs")
    a = sets.select(F.col("node").alias("u"), F.col("tokens").alias("x"))
    b = sets.select(F.col("node").alias("v"), F.col("tokens").alias("y"))
    both = pairs.join(b.hint("merge"), "v").join(a.hint("merge"), "u")

    def check(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                ok[k] = 100 * common >= 75 * (len(x) + len(y) - common)
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    links = written(both.select("u", "v", "x", "y").mapInArrow(check, "u long, v long"), "links")
    discard(pairs)
    return links


def group_labels(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (node, c), written: sets of groups (gid, node, n, flags) that link, directly or over others, have one c; sets that link with none may be missing.

    In each round every group that isn't joined up yet meets one of its members, drawn by a hash that all groups share. What is
    then still apart in a group meets all of its sets but those that are joined up with it; parities keep out most that don't link.
    """
    left, label, found, held = groups, None, [], None  # held: the table that left is of, once it isn't groups
    for r in range(ROUNDS):
        if label is None:
            at = left.withColumn("c", F.col("node"))
        else:
            at = left.join(label.hint("merge"), "node", "left").select("gid", "node", "n", "flags", F.coalesce("c", "node").alias("c"))
            apart = at.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("gid")
            at = written(at.join(apart.hint("merge"), "gid", "left_semi"), "groups-left")
            discard(*([held] if held is not None else []))
            held, left = at, at.select("gid", "node", "n", "flags")
            if not at.limit(1).count():
                break
        if r + 1 < ROUNDS:
            order = F.col("node") if r == 0 else F.xxhash64("node", F.lit(r))
            hub = at.groupBy("gid").agg(F.min(F.struct(order.alias("o"), "node", "n", "c")).alias("h"))
            pairs = at.join(hub.hint("merge"), "gid").where("c <> h.c AND 4 * least(n, h.n) >= 3 * greatest(n, h.n)")
            pairs = pairs.select(F.least("node", "h.node").alias("u"), F.greatest("node", "h.node").alias("v")).distinct()
            found.append(near_links(pairs, sets))
            before, label = label, relabelled(label, found[-1])
            discard(*([before] if before is not None else []))
        else:
            pairs, tables = _apart(at, sets)
            found.append(near_links(pairs, sets))
            discard(*tables)
    out = joined_up(label, reduce(DataFrame.union, found))
    discard(*[t for t in (held, label) if t is not None], *found)
    return out


def _apart(at: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (u, v) of one group and different labels that may link: one probes what the other indexes, and parities allow it; and the tables they are read from.

    Sets that nearly link share some hundred groups. Each set brings the groups just before, in the order of gid, and a pair that
    meets in one of those both brought is left to that one; in the first of its groups nothing comes before, so none is lost.
    """
    parts = at.groupBy("gid", "c").agg(F.count("*").alias("k"))
    main = parts.groupBy("gid").agg(F.max(F.struct("k", "c")).alias("m")).select("gid", F.col("m.c").alias("main"))
    nodes = written(at.select("node").distinct(), "left-nodes")
    small = sets.select("node", *PARITY).join(nodes.hint("merge"), "node", "left_semi")
    before = Window.partitionBy("node").orderBy("gid").rowsBetween(-BEFORE, -1)
    had = lambda flag, most: F.slice(F.reverse(F.collect_list(F.when(F.col("flags").bitwiseAND(flag) > 0, F.col("gid"))).over(before)), 1, most)
    at = at.withColumns({"probed": had(PROBE, BEFORE // 4), "indexed": had(INDEX, BEFORE // 2)})
    some = at.join(small.hint("merge"), "node").join(main.hint("merge"), "gid")
    side = lambda df, x, y: df.select("gid", "main", *[F.col(c).alias(n) for c, n in (("node", x), ("n", f"n{x}"), ("flags", f"f{x}"), ("c", f"c{x}"), ("probed", f"{x}probed"), ("indexed", f"{x}indexed"), *((p, f"{y}{p}") for p in PARITY))])
    some = written(some, "groups-apart")
    a, b = side(some.where("c <> main"), "u", "a"), side(some, "v", "b").drop("main")
    meets = "((nu >= nv AND fu & 1 = 1 AND fv & 2 = 2) OR (nv >= nu AND fv & 1 = 1 AND fu & 2 = 2))"
    may = f"cu <> cv AND (cv = main OR u < v) AND 4 * least(nu, nv) >= 3 * greatest(nu, nv) AND {meets} AND {_APART} <= (nu + nv) div 7"
    may += " AND NOT IF(nu >= nv, arrays_overlap(uprobed, vindexed), arrays_overlap(vprobed, uindexed))"
    pairs = a.join(b.hint("merge"), (a["gid"] == b["gid"]) & F.expr(may))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), [nodes, some]


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id)."""
    sizes = written(set_sizes(docs, doc_id, text), "set-sizes")
    total, tokens = sizes.agg(F.count("*"), F.sum("n")).first()
    groups = written(shared_groups(docs, text, *frequent_tokens(docs, total, doc_id, text), tokens or 0), "set-groups")
    shared = groups.select("node").distinct()
    of = sizes.where("n > 0").join(shared.hint("merge"), "node").groupBy("node").agg(F.min("doc_id").alias("_id"))
    of = written(of, "set-ids")
    few = of.count() <= 100_000  # 16 bytes each; more are joined by a shuffle
    wanted = F.broadcast(of) if few else of.hint("merge")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("t"))
    rows = rows.join(wanted.withColumnRenamed("_id", "_of"), F.col("_id").eqNullSafe(F.col("_of")))

    def make(batches):
        for batch in batches:
            for a, b, tokens, counts in token_sets(batch.column("t")):
                ends = np.cumsum(counts)
                node = batch.column("node").slice(a, b - a)
                full = counts > 0
                own = nodes_of(tokens, counts).view(np.int64) == node.to_numpy(zero_copy_only=False)  # ids may repeat
                out = [tokens[e - c : e].tobytes() for e, c in zip(ends[full], counts[full], strict=True)]
                bits = parities(tokens, counts).view(np.int64)
                columns = [node.filter(pa.array(full)), pa.array(counts[full].astype(np.int64)), *(pa.array(bits[:, k].copy()) for k in range(len(PARITY))), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", *PARITY, "tokens"]).filter(pa.array(own[full]))

    schema = "node long, n long, " + ", ".join(f"{c} long" for c in PARITY) + ", tokens binary"
    sets = written(rows.select("node", "t").mapInArrow(make, schema).dropDuplicates(["node"]), "sets")
    label = group_labels(groups, sets)
    discard(groups, of, sets)
    placed = sizes.join(label.hint("merge"), "node", "left").select("doc_id", "n", "node", F.coalesce("c", "node").alias("c"))
    least = placed.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    full = placed.where("n > 0").join(least.hint("merge"), "c")
    full = full.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(placed.where("n = 0").select("doc_id", "n", "doc_id"))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the document of least id of each component; rows that repeat an id stay together."""
    (name,) = free_names(docs, "keep")
    keep = near_components(docs, doc_id, text).where("doc_id = component_id OR component_id IS NULL").select(F.col("doc_id").alias(name))
    return docs.join(keep.distinct().hint("merge"), F.col(doc_id).eqNullSafe(F.col(name)), "left_semi")
