"""Chat formatting as a prefix tree: conversations that share initial turns share their tokens, emitted once, depth-first.

A turn is formatted as <s>role, a line break, text</s>. Inside roles and texts a backslash is doubled and every control string of
CONTROL gets a backslash behind its first character; a line break in a role is written as backslash and n. So control strings
occur only where the template puts them, and reading back is exact. Tokens are code points.

Nodes are turns by their whole prefix: conversations whose first turns are equal, word for word, share nodes. A node's identity is its
depth with sums of hashes over the prefix's turns, each hashed with its place. Running sums over a conversation's turns are made
in pieces of a range partitioning by (conversation, turn) with what the pieces before carry, so that no conversation is gathered.

Each node belongs to the longest conversation through it (ties: the least conv_id), so that nodes fall into chains: a chain
is the part of a conversation that is not an earlier chain's. In depth-first order a chain's nodes come one after another, then
what hangs off them, the deepest first. A chain's place is the list of its ancestors' (depth of the branch, conversation), made by
pointer doubling; one distributed running sum over the chains in this order gives every token's place. Each node has
the position of its first token (the number of tokens before it in any of its conversations) and the intervals of the sequence that its
tokens attend to besides their own node's beginning; adjacent intervals are joined, so that a chain has one for each branch.

Edge cases: null texts and roles count as empty; rows with a null conv_id form one conversation; turns of one number, a null
number first, come in the order of the MD5 of their formatted turn; repeated rows are repeated turns; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefold.llm.shared import discard, partitions, written

OPEN, BREAK, CLOSE = "<s>", "\n", "</s>"
#: Control strings of common chat templates: fixed values. OPEN and CLOSE are among them.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNED = "assistant"
_INNER = "([<\\[])(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _INNER, r"$1\\")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, segment, loss_start, loss_length): each row as a formatted turn; the loss is on an assistant's escaped text."""
    role_, text_ = F.coalesce(role, F.lit("")), escaped(F.coalesce(text, F.lit("")))
    head = F.concat(F.lit(OPEN), F.replace(escaped(role_), F.lit("\n"), F.lit("\\n")), F.lit(BREAK))
    learned = role_ == LEARNED
    return conversations.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.concat(head, text_, F.lit(CLOSE)).alias("segment"),
        F.when(learned, F.length(head)).alias("loss_start"), F.when(learned, F.length(text_)).alias("loss_length"),
    )


def _carried(rows: DataFrame, sums: dict[str, Column], order: list[str]) -> DataFrame:
    """rows (conv, piece, order columns, ...) with running sums over the conversation's rows: a window in each piece, and what pieces before carry."""
    inside = Window.partitionBy("conv", "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("conv", "piece").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    carry = totals.select(F.col("conv").alias("_conv"), F.col("piece").alias("_piece"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    local = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    both = local.join(carry.hint("merge"), F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece")))
    return both.select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, key, size, depth, a, b, c, position): each turn with its prefix's identity (depth, a, b, c) and the tokens before it."""
    n = partitions(turns.sparkSession)
    rows = turns.select("conv", "turn", F.md5("segment").alias("key"), F.length("segment").cast("long").alias("size"))
    rows = rows.repartitionByRange(n, "conv", "turn", "key").withColumns({"piece": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    rows = written(rows, "turn-keys")
    order = ["turn", "key", "row"]
    placed = written(_carried(rows, {"depth": F.lit(1).cast("long"), "end": F.col("size")}, order), "turn-places")
    # parts of hashes of 40 bits, so that sums over millions of turns fit
    parts = {k: F.shiftright(F.xxhash64(F.lit(k), "key", "depth"), 24) for k in ("a", "b", "c")}
    summed = _carried(placed, parts, order)
    out = written(summed.select("conv", "key", "size", "depth", *parts, (F.col("end") - F.col("size")).alias("position")), "prefixes")
    discard(rows, placed)
    return out


NODE = ["depth", "a", "b", "c"]


def chains(prefix: DataFrame, long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, chains) of prefixes and the turns of each conversation (c_, turns): nodes (depth, a, b, c, key, size, position, owner, conversations) and chains (owner, at, up, begin, first, tokens).

    owner: the conversation, as struct (conv), that the node belongs to; at: the depth that a chain hangs off, up: the owner of that node.
    """
    each = prefix.join(long.hint("merge"), F.col("conv").eqNullSafe(F.col("c_"))).drop("c_")
    owner = F.min(F.struct((-F.col("turns")).alias("l"), "conv"))
    nodes = each.groupBy(*NODE).agg(
        F.first("key").alias("key"), F.first("size").alias("size"), F.first("position").alias("position"), owner.alias("o"), F.count("*").alias("conversations")
    )  # equal prefixes have equal keys, sizes and positions
    nodes = written(nodes.withColumn("owner", F.struct("o.conv")).drop("o"), "nodes")
    heads = nodes.groupBy("owner").agg(F.min("depth").alias("begin"), F.min("position").alias("first"), F.sum("size").alias("tokens"))
    above = nodes.select((F.col("depth") + 1).alias("begin"), F.col("owner").alias("up"), *[F.col(x).alias(f"u{x}") for x in "abc"])
    # the node above a chain's first one: the owner's own prefix one turn shorter
    mine = prefix.select(F.struct("conv").alias("owner"), (F.col("depth") + 1).alias("begin"), *[F.col(x).alias(f"u{x}") for x in "abc"])
    hung = heads.where("begin > 1").join(mine.hint("merge"), ["owner", "begin"]).join(above.hint("merge"), ["begin", "ua", "ub", "uc"])
    roots = heads.where("begin = 1").withColumn("up", F.lit(None).cast(heads.schema["owner"].dataType))
    columns = ["owner", "up", "begin", "first", "tokens"]
    return nodes, written(hung.select(columns).union(roots.select(columns)), "chains")


def ordered(chain: DataFrame) -> DataFrame:
    """chains with path: the (-depth of the branch, conversation) of each chain from the root down, by pointer doubling."""
    step = F.array(F.struct((-F.col("begin")).alias("d"), F.col("owner").alias("o")))
    at = written(chain.select("owner", F.col("up").alias("next"), step.alias("path")), "paths")
    while not at.where("next IS NOT NULL").isEmpty():
        ahead = at.select(F.col("owner").alias("next"), F.col("next").alias("far"), F.col("path").alias("front"))
        joined = at.where("next IS NOT NULL").join(ahead.hint("merge"), "next")
        moved = joined.select("owner", F.col("far").alias("next"), F.concat("front", "path").alias("path"))
        after = written(moved.union(at.where("next IS NULL")), "paths")
        discard(at)
        at = after
    return chain.join(at.drop("next").hint("merge"), "owner")


def running(rows: DataFrame, by: str, size: str, out: str) -> DataFrame:
    """rows with out: the sum of size over all rows before it in the order of by, in pieces of a range partitioning."""
    n = partitions(rows.sparkSession)
    rows = written(rows.repartitionByRange(n, by).withColumn("piece", F.spark_partition_id()), "pieces")
    totals = rows.groupBy("piece").agg(F.sum(size).alias("t"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    carry = totals.select("piece", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("carry"))
    inside = Window.partitionBy("piece").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(size).over(inside), F.lit(0))).join(carry.hint("merge"), "piece").withColumn(out, F.col(out) + F.col("carry")).drop("piece", "carry")


def prefix_tree(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of turns_of(...).

    nodes, in depth-first order: node (its identity), tree (its root's conversation), depth, start (place of its first token in the
    sequence of all trees), size, position (id of its first token; the others count on), ancestors (intervals (start, end) of
    the sequence before it that it attends to), conversations (how many pass through it), segment, loss_start, loss_length.
    members: (conv, depth, node, last): the nodes of each conversation by depth; last marks its last one.
    """
    prefix = prefixes(turns)
    long = written(prefix.groupBy(F.col("conv").alias("c_")).agg(F.max("depth").alias("turns")), "turns")
    nodes, chain = chains(prefix, long)
    placed = written(running(ordered(chain), "path", "tokens", "begins"), "placed-chains")
    # each chain's ancestors: for every step of its path but the last, the part of that chain before the next one's branch
    steps = placed.select("owner", F.posexplode("path").alias("k", "s"), "path", "first").where(F.col("k") < F.size("path") - 1)
    steps = steps.select("owner", "k", F.col("s.o").alias("of"), F.get("path", F.col("k") + 1)["o"].alias("below"))
    spot = placed.select(F.col("owner").alias("of"), F.col("begins"), F.col("first").alias("of_first"))
    fork = placed.select(F.col("owner").alias("below"), F.col("first").alias("fork"))
    steps = steps.join(spot.hint("merge"), "of").join(fork.hint("merge"), "below")
    span = F.struct("k", F.col("begins").alias("start"), (F.col("begins") + F.col("fork") - F.col("of_first")).alias("end"))
    above = steps.groupBy("owner").agg(F.transform(F.sort_array(F.collect_list(span)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("above"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    chain = placed.join(above.hint("merge"), "owner", "left").select("owner", "begins", "first", F.get("path", F.lit(0))["o"].alias("root"), F.coalesce("above", none).alias("above"))
    chain = written(chain, "chain-places")
    start = F.col("begins") + F.col("position") - F.col("first")
    own = F.array(F.struct(F.col("begins").alias("start"), start.alias("end")))
    spans = F.filter(F.concat("above", own), lambda x: x["end"] > x["start"])
    merged = F.reduce(
        spans,
        none,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] == x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), x["end"].alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in NODE]).alias("node")
    made = nodes.join(chain.hint("merge"), "owner").select(
        name, F.col("root.conv").alias("tree"), "depth", start.alias("start"), "size", "position", F.when(F.size("above") == 0, spans).otherwise(merged).alias("ancestors"), "conversations", "key"
    )
    texts = turns.select(F.md5("segment").alias("key"), "segment", "loss_start", "loss_length").groupBy("key").agg(*[F.first(c).alias(c) for c in ("segment", "loss_start", "loss_length")])
    made = made.join(written(texts, "segments").hint("merge"), "key").drop("key")
    n = partitions(turns.sparkSession)
    made = written(made.repartitionByRange(n, "start").sortWithinPartitions("start"), "prefix-tree")
    members = prefix.join(long.hint("merge"), F.col("conv").eqNullSafe(F.col("c_"))).select("conv", "depth", name, (F.col("depth") == F.col("turns")).alias("last"))
    members = written(members, "members")
    discard(nodes, prefix, placed, long, chain)
    return made, members


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(rows: DataFrame) -> DataFrame:
    """Rows (leaf, depth, segment, loss_start, loss_length) as one row a leaf: its turns read from the formatted text, digested.

    Rows are dealt by leaf and streamed in order, so that a conversation is never held whole.
    """

    def digest(batches):
        leaf, state = None, None

        def closed():
            return [leaf, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["leaf"] != leaf:
                    if state:
                        out.append(closed())
                    leaf, state = r["leaf"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                segment, at = r["segment"], 0
                state[4] += len(segment)
                while at < len(segment):
                    if not segment.startswith(OPEN, at):
                        raise ValueError("a turn must begin with its mark")
                    line, end = segment.index(BREAK, at), segment.index(CLOSE, at)
                    role = unescaped_role(segment[at + len(OPEN) : line])
                    text = unescaped(segment[line + 1 : end])
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    at = end + len(CLOSE)
                if r["loss_start"] is not None:
                    learned = unescaped(segment[r["loss_start"] : r["loss_start"] + r["loss_length"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(["leaf", *names], x, strict=True)) for x in out], schema)
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip(["leaf", *names], closed(), strict=True))], schema)

    names = [x.split()[0] for x in DIGEST.split(", ")]
    schema = pa.schema([("leaf", pa.string()), *((x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in DIGEST.split(", "))])
    return rows.repartition(partitions(rows.sparkSession), "leaf").sortWithinPartitions("leaf", "depth").select("leaf", "segment", "loss_start", "loss_length").mapInArrow(digest, f"leaf string, {DIGEST}")


def unescaped_role(text: str) -> str:
    """A role as it was: its line breaks are written as backslash and n, and a backslash of its own is doubled."""
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def op11_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, as a prefix tree, and each conversation read back from it."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    mine = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = turns_of(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(mine))
    nodes, members = prefix_tree(turns)
    leaves = members.where("last").select("conv", F.col("node").alias("leaf"))
    one = leaves.groupBy("leaf").agg(F.min(F.struct("conv")).alias("one"))  # equal conversations are read once
    path = members.join(one.hint("merge"), F.col("conv").eqNullSafe(F.col("one.conv"))).select("leaf", "depth", "node")
    read = read_back(path.join(nodes.select("node", "segment", "loss_start", "loss_length").hint("merge"), "node").drop("node"))
    digests = written(read, "digests")
    return leaves.join(digests.hint("merge"), "leaf").select(F.col("conv").alias("conv_id"), *[x.split()[0] for x in DIGEST.split(", ")])
