"""Line dedup: near-equal lines by MinHash, one line kept of each component. DataFrame functions only.

A line is normalised (trimmed, white space to one space, lower-cased); its set is its distinct runs of WIDTH
characters. Each run is hashed once, and a line keeps about its KEPT least hashes (bottom-k MinHash, one permutation): those
below KEPT by its number of runs, or KEPT of all its runs where it repeats itself so much that fewer than LEAST are left. ROWS
neighbours in the order of hashes make a band; of the bands that begin at every hash those count whose first hash is a multiple
of EVERY, or all where a line has fewer than SHORT hashes: some 12 a line. Lines of up to TINY runs have bands of PAIR neighbours, and from
MIXED + 1 runs on both kinds, so that near lines always have one kind in common. By simulation a pair at 0.76 shares no band with a
probability of 1 to 4 %, at 0.8 of 1 %, at 0.85 of less than 1 %.

Candidates are lines that share a band's key. Of each line's runs a bit for each of 1,024 classes tells whether the line has an odd number of
them; two sets differ in at least as many runs as bits, and near ones in a seventh of their sizes at most, so pairs whose bits differ more are
left out without loss. The others are compared exactly, by the hashes of all their runs. First every line meets the least line of all its
bands; then every band that holds lines not linked yet meets one of its lines, and after that two lines of its largest component; what is apart then meets
all of its band, but for the members of the band's largest component among each other. Links join up to components (large-star, small-star), and of a component's
occurrences the one of least (id, text, line number) stays. Short lines are lines as others: one of fewer than WIDTH characters is a single
run, so it is near nothing but its own repeats.

Scale: equal lines are one node, so a line that a third of all rows hold is summed up before anything else; near copies of one
line cost one comparison each; runs are hashed as small rows, of which all but the least are dropped before they are grouped;
the joins can be split by Spark where a key is frequent. Nodes are 64-bit hashes of lines: at 10**11 distinct lines a few
hundred may be confused with another.

Edge cases: null texts have no lines and stay null; lines that are empty or blank stay; rows that repeat an id are texts of their own unless their
texts are equal too (then they are one, and keep the same lines); null ids come last; a line however long is one
line; an empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorefold.llm.shared import discard, free_names, joined_up, relabelled, written

WIDTH, ROWS = 8, 4
TINY, MIXED, PAIR = 12, 8, 2
KEPT, EVERY, SHORT, LEAST = 40, 3, 30, 12
ROUNDS = 3
BEFORE = 16  # keys before one that a line brings, in the last round
FEW = 500_000
THRESHOLD = 0.75
PARITY = [f"p{k}" for k in range(16)]


def lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (id, h, no, t, node) of the lines that aren't blank; h: hash of the whole text."""
    # whole texts are lower-cased and searched for blanks to be joined: nearly none has any
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.explode(F.array(F.lower(F.col(text)))).alias("t"))
    odd = F.lit(False)
    for blank in ("\t", "\x0b", "\f", "\r", "  "):
        odd = odd | F.contains("t", F.lit(blank))
    single = F.when(odd, F.regexp_replace("t", "[ \\t\\x0b\\f\\r]+", " ")).otherwise(F.col("t"))
    rows = rows.select("id", "h", F.posexplode(F.split(single, "\n")).alias("no", "t"))
    # a generated row of one keeps Spark from trimming again for each use
    rows = rows.select("id", "h", "no", F.explode(F.array(F.trim("t"))).alias("t")).where("t <> ''")
    return rows.withColumn("node", F.xxhash64("t"))


def _last(bytes_: str) -> str:
    """SQL: number of the last run of a UTF-16 binary column."""
    return f"greatest(length({bytes_}) div 2 - {WIDTH}, 0)"


def _run(bytes_: str, at: str) -> str:
    """SQL: hash of the run that begins at a byte, counted from 1, of a UTF-16 binary column."""
    return f"xxhash64(substring({bytes_}, {at}, {2 * WIDTH}))"


def _texts(rows: DataFrame) -> DataFrame:
    """Rows (node, t): each distinct line once."""
    return rows.groupBy("node").agg(F.first("t").alias("t"))


def _coded(texts: DataFrame) -> DataFrame:
    """Rows (node, b): lines as UTF-16."""
    return texts.select("node", F.encode("t", "UTF-16BE").alias("b"))


def sketches(texts: DataFrame) -> DataFrame:
    """Rows (node, n, s): number of runs and the least hashes, ascending, of distinct lines (node, t): about KEPT, or all of them.

    A run is kept by its hash alone, below a limit that is KEPT by the line's number of runs: so nearly no row of a run is
    grouped. Lines that repeat themselves keep too few that way; sketches_of_few looks at these again.
    """
    b = _coded(texts).select("node", "b", F.expr(f"{_last('b')} + 1").alias("n"))
    b = b.select("node", "b", "n", F.explode(F.expr("sequence(1, 2 * n - 1, 2)")).alias("i"))
    h = b.select("node", "n", "i", F.expr(_run("b", "i")).alias("h"))
    kept = f"shiftrightunsigned(h, 32) * n <= {KEPT}L << 32"
    h = h.where(f"i = 1 OR {kept}").select("node", "n", F.expr(f"IF({kept}, shiftrightunsigned(h, 1), NULL)").alias("h"))
    return h.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("h")).alias("s"))


def sketches_of_few(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node, n, s) of lines that repeat themselves, from all their distinct runs."""
    b = _coded(_texts(_of_nodes(rows.select("node", "t"), nodes))).select("node", "b", F.explode(F.expr(f"sequence(1, 2 * {_last('b')} + 1, 2)")).alias("i"))
    h = b.select("node", F.expr(f"shiftrightunsigned({_run('b', 'i')}, 1)").alias("h")).distinct()
    h = h.groupBy("node").agg(F.sort_array(F.collect_list("h")).alias("s"))
    return h.select("node", F.size("s").alias("n"), F.slice("s", 1, KEPT).alias("s"))


def bands(sketched: DataFrame) -> DataFrame:
    """Rows (node, key): keys of runs of ROWS neighbours in the sketches; key is null, once, where a sketch holds too little."""
    few = f"size(s) < {LEAST} AND n > size(s)"
    sizes = F.expr(f"CASE WHEN {few} OR n > {TINY} THEN array({ROWS}) WHEN n > {MIXED} THEN array({PAIR}, {ROWS}) ELSE array({PAIR}) END")
    sized = sketched.select("node", "n", "s", F.explode(sizes).alias("w"))
    at = F.expr(f"sequence(1, IF({few}, 1, greatest(size(s) - w + 1, 1)))")
    w = sized.select("node", "n", "s", "w", F.explode(at).alias("p")).where(f"size(s) < {SHORT} OR element_at(s, p) % {EVERY} = 0")
    return w.select("node", F.expr(f"IF({few}, NULL, xxhash64(slice(s, p, w)))").alias("key"))


def _of_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of rows those of the nodes, a written table."""
    nodes = F.broadcast(nodes) if nodes.count() <= FEW else nodes.hint("merge")  # 8 bytes each; more meet in a shuffle
    return rows.join(nodes, "node", "left_semi")


def _hashed(bytes_: str) -> str:
    """SQL: the hashes of all runs of a UTF-16 binary column."""
    return f"transform(sequence(1, 2 * {_last(bytes_)} + 1, 2), i -> {_run(bytes_, 'i')})"


def parities(texts: DataFrame) -> DataFrame:
    """Rows (node, n, p0, ...) of lines (node, t): the size of each set, and a bit for each class of runs that tells whether it has an odd number of them."""
    sets = _coded(texts).select("node", F.explode(F.array(F.expr(f"array_distinct({_hashed('b')})"))).alias("a"))
    runs = sets.select("node", F.size("a").alias("n"), F.explode("a").alias("h"))
    bit = lambda k: F.expr(f"bit_xor(IF(shiftrightunsigned(h, 56) % {len(PARITY)} = {k}, shiftleft(1L, CAST(h & 63 AS INT)), 0L))")
    return runs.groupBy("node").agg(F.first("n").alias("n"), *[bit(k).alias(p) for k, p in enumerate(PARITY)])


def _side(odd: DataFrame, end: str) -> DataFrame:
    """Parities (node, n, p0, ...) with columns named after one end of pairs: u, nu, up0, ..."""
    return odd.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), *[F.col(p).alias(f"{end}{p}") for p in PARITY])


def _may(threshold: float) -> str:
    """SQL: whether the sets of u and v can be near by their sizes and parities: near sets differ in few runs, and in at least as many as bits differ."""
    bits = " + ".join(f"bit_count(u{p} ^ v{p})" for p in PARITY)
    return f"least(nu, nv) >= {threshold} * greatest(nu, nv) - 1e-6 AND {1 + threshold} * ({bits}) <= {1 - threshold} * (nu + nv) + 1e-6"


def near(pairs: DataFrame, odd: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (u, v) those whose lines are near, by all their runs; odd: parities, texts: (node, t)."""
    may = pairs.join(_side(odd, "u").hint("merge"), "u").join(_side(odd, "v").hint("merge"), "v").where(_may(threshold)).select("u", "v", "nu", "nv")
    x = texts.select(F.col("node").alias("u"), F.col("t").alias("x"))
    y = texts.select(F.col("node").alias("v"), F.col("t").alias("y"))
    both = may.join(y.hint("merge"), "v").join(x.hint("merge"), "u")
    # a generated row of one keeps Spark from coding the lines again for each run
    ends = F.struct("u", "v", (F.col("nu") + F.col("nv")).alias("n"), *[F.encode(c, "UTF-16BE").alias(c) for c in ("x", "y")])
    common = F.expr(f"size(array_intersect({_hashed('x')}, {_hashed('y')}))")
    return both.select(F.inline(F.array(ends))).where((1 + threshold) * common >= threshold * F.col("n") - 1e-6).select("u", "v")


def _apart(at: DataFrame, odd: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) of rows (key, node, c) of one key and different components that may be near.

    Lines bring the keys before, in their order, and a pair that shares one of these is left to it: it comes once, of the first key it shares.
    """
    # members of the key's largest component need no comparison with each other
    parts = at.groupBy("key", "c").agg(F.count("*").alias("k"))
    main = parts.groupBy("key").agg(F.max(F.struct("k", "c")).alias("m")).select("key", F.col("m.c").alias("main"))
    before = F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(-BEFORE, -1))
    some = at.withColumn("before", before).join(main.hint("merge"), "key")
    a = some.where("c <> main").select("key", F.col("node").alias("u"), F.col("c").alias("cu"), F.col("before").alias("ubefore")).join(_side(odd, "u").hint("merge"), "u")
    b = some.select("key", "main", F.col("node").alias("v"), F.col("c").alias("cv"), F.col("before").alias("vbefore")).join(_side(odd, "v").hint("merge"), "v")
    meet = F.expr(f"cu <> cv AND (cv = main OR u < v) AND {_may(threshold)} AND NOT arrays_overlap(ubefore, vbefore)")
    pairs = a.join(b.hint("merge"), (a["key"] == b["key"]) & meet)
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def links(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (u, v), written: nodes whose lines were compared and are near. rows is read several times: best a written table."""
    return _linked(rows, threshold)[0]


def _linked(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """links, and what relabelled gave for a part of them."""
    keys = written(bands(sketches(_texts(rows))), "line-bands")
    few = written(keys.where("key IS NULL").select("node"), "line-few")
    every = keys
    if few.limit(1).count():
        every = keys.where("key IS NOT NULL").union(bands(sketches_of_few(rows, few)))
    hubs = every.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("v"), F.count("*").alias("n"))
    hubs = written(hubs.where("n > 1"), "line-hubs")
    more = hubs.where("n > 2").select("key", "u")
    more = F.broadcast(more) if more.count() <= FEW else more.hint("merge")  # 16 bytes each
    two = hubs.where("n = 2").select("key", F.explode(F.array("u", "v")).alias("node"), "u")
    members = written(every.join(more, "key").select("key", "node", "u").union(two), "line-members")
    discard(keys, few, hubs)

    nodes = written(members.select("node").distinct(), "line-ends")
    texts = written(_texts(_of_nodes(rows.select("node", "t"), nodes)), "line-texts")
    odd = written(parities(texts), "line-parities")
    discard(nodes)
    # first every line meets the least line of all its bands
    pairs = members.groupBy("node").agg(F.min("u").alias("u")).where("u < node").select("u", F.col("node").alias("v"))
    found = [written(near(pairs, odd, texts, threshold), "line-links")]
    label, left = relabelled(None, found[0]), members
    for r in range(ROUNDS):  # each band that is still apart meets one of its lines, another one each time; at last all that may be near
        at = written(_still_apart(left, label), "line-left")
        discard(left)
        left = at
        if not at.limit(1).count():
            break
        if r + 1 == ROUNDS:
            pairs = _apart(at, odd, threshold)
        else:
            pairs = at.join((_hubs if r else _hub)(at).hint("merge"), "key").where("c <> hc").select("node", F.explode("hubs").alias("hub"))
            pairs = pairs.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
        found.append(written(near(pairs, odd, texts, threshold), "line-links"))
        if r + 1 < ROUNDS:
            before, label = label, relabelled(label, found[-1])
            discard(before)
    discard(left, texts, odd)
    return reduce(DataFrame.union, found), label


def _hub(at: DataFrame) -> DataFrame:
    """Rows (key, hc, hubs): a line of each key and its component, the same of keys that share many lines."""
    h = at.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(0)), "node", "c")).alias("h"))
    return h.select("key", F.col("h.c").alias("hc"), F.array("h.node").alias("hubs"))


def _hubs(at: DataFrame) -> DataFrame:
    """Rows (key, hc, hubs): each key's largest component and two of its lines, others of every key, as what is left is near some of them only."""
    one = F.struct(F.xxhash64("node", "key"), "node")
    parts = at.groupBy("key", "c").agg(F.count("*").alias("k"), F.min(one).alias("a"), F.max(one).alias("b"))
    h = parts.groupBy("key").agg(F.max(F.struct("k", "c", F.col("a.node").alias("a"), F.col("b.node").alias("b"))).alias("h"))
    return h.select("key", F.col("h.c").alias("hc"), F.array_distinct(F.array("h.a", "h.b")).alias("hubs"))


def _still_apart(members: DataFrame, label: DataFrame) -> DataFrame:
    """Rows (key, node, c) of members of the bands that hold more than one label."""
    at = members.select("key", "node").join(label.hint("merge"), "node", "left").select("key", "node", F.coalesce("c", "node").alias("c"))
    apart = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    return at.join(apart.hint("merge"), "key", "left_semi")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, h, gone): the numbers of the lines that go, ascending, of each text (id and hash)."""
    rows = written(lines(docs, doc_id, text), "lines")
    found, label = _linked(rows, threshold)
    group = joined_up(label, found)
    discard(label)
    placed = rows.select("id", "h", "no", "node").join(group.hint("merge"), "node", "left")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "no")
    placed = written(placed.select(place.alias("at"), F.coalesce("c", "node").alias("g")), "line-groups")
    discard(rows)
    first = placed.groupBy("g").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1").drop("n")
    gone = placed.join(first.hint("merge"), "g").where("at <> first").select("at.id", "at.h", "at.no")
    return gone.groupBy("id", "h").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the text's repeated lines removed; documents that lose all their lines keep an empty text."""
    i, h, g = free_names(docs, "id", "hash", "gone")
    gone = repeated(docs, doc_id, text, threshold).select(F.col("id").alias(i), F.col("h").alias(h), F.col("gone").alias(g))
    d = docs.join(gone.hint("merge"), F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text)) == F.col(h)), "left")
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda u, k: ~F.array_contains(F.col(g), k)), "\n")
    clean = F.when(F.col(g).isNull(), F.col(text)).otherwise(left)
    return d.select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = repeated(docs).withColumnRenamed("id", "doc_id")
    n = docs.select("doc_id", F.xxhash64("text").alias("h"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"))
    same = n["doc_id"].eqNullSafe(gone["doc_id"]) & (n["h"] == gone["h"])
    return n.join(gone.hint("merge"), same, "left").select(
        n["doc_id"],
        "n_lines",
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    )
