"""Spelling variants: a relational trie frontier over the words of all texts, one-edit neighbours, and each word's usual form.

Words are the maximal runs [A-Za-z\\u00C0-\\u00FF]+ with A-Z lower-cased. For op13 a run whose unsigned crc32 of
"<doc_id>:<run>" is divisible by 199 first loses its code point crc32 % length. Words of at least 6 code points that occur at
least 5 times are compared.

The trie's edges are labelled with blocks of code points (6 at first, later longer ones, so that long common beginnings take
few levels); a node is the 64-bit hash of its parent and its block. Level by level, states (word, position, node, edits)
meet the distributed edge table of that level. A state without an edit stands on its word's own path: it looks
for its block with one place masked (a replacement) and for its block with one code point left out (the word is the longer one
of the two); inserted code points are the same pairs seen from the longer word. A state with an edit looks for its next
block. A state that reaches a node with a single word below it is terminal: the word is compared exactly, so that hashes never
decide. States without an edit end where no other word shares their path. A state has at most one successor for each letter of the
alphabet, so nothing grows with the square of a group; blocks that many words share are split by the skew join.

Counting is done by document in the tasks and added up in them before the shuffle. The form of a word is its near word of largest
n (ties: the least in code-point order), if that n is at least 5 times its own; roots follow forms by pointer doubling, and
n grows at least fivefold with each step, so that a few rounds do.

Edge cases: null and empty texts have no words; a null id counts as empty text; rows that repeat count again;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.llm.shared import discard, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, RATIO, DELETED_OF = 6, 5, 5, 199
END, MASK = "\x01", "?"  # neither is a letter
HELD = 300_000  # words a task adds up before it hands them on


def widths() -> Iterator[int]:
    """Code points of the edges' blocks, level by level."""
    yield 6
    width = 4
    while True:
        yield width
        yield width
        width *= 2


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", deleted_of: int | None = DELETED_OF) -> DataFrame:
    """(word, n): occurrences of each word; with deleted_of, a code point goes from runs whose checksum it divides."""

    def count(batches):
        held: Counter[str] = Counter()

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for k, t in zip(batch.column("k"), batch.column("t"), strict=True):
                if not t.is_valid:
                    continue
                runs = Counter(RUN.findall(t.as_py().encode().lower().decode()))  # bytes lower A-Z only
                if deleted_of:
                    begun = crc32(((k.as_py() or "") + ":").encode())
                    for run, n in runs.items():
                        h = crc32(run.encode(), begun)
                        if h % deleted_of == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                        held[run] += n
                else:
                    held.update(runs)
                if len(held) > HELD:
                    yield handed()
                    held.clear()
        yield handed()

    rows = docs.select(F.col(doc_id).cast("string").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _without(text: Column, at: Column, put: str = "") -> Column:
    return F.concat(F.substring(text, F.lit(1), at - 1), F.lit(put), F.substring(text, at + 1, F.lit(2**30)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near) of the distinct values of words.word that differ by exactly one inserted, deleted or replaced code point, both ways."""
    alive = written(words.select("word", F.lit(0).cast("long").alias("node")).distinct(), "trie-words")
    states: DataFrame | None = None
    pairs, depth = [], 0
    for width in widths():
        ended, left = F.concat("word", F.lit(END)), F.length("word") - depth  # letters not yet passed
        block = F.substring(ended, depth + 1, width)
        at = F.explode(F.sequence(F.lit(1), F.least(F.lit(width), F.col("left")))).alias("at")
        key = lambda block: F.xxhash64("node", block).alias("key")
        letter = lambda c, p: F.substring(c, p, F.lit(1))

        edges = alive.groupBy("node", block.alias("block")).agg(F.count("*").alias("below"), F.min("word").alias("only"))
        edges = written(edges.withColumn("child", F.xxhash64("node", "block")), "trie-edges")
        inner = edges.withColumn("left", F.length(F.regexp_replace("block", END, ""))).where("left > 0").select("*", at)
        to = ["child", "below", "only"]
        labels = edges.select(F.col("child").alias("key"), F.lit("").alias("to_letter"), *to).union(
            inner.select(key(_without(F.col("block"), F.col("at"), MASK)), letter(F.col("block"), F.col("at")), *to)
        )
        own = alive.withColumns({"left": left, "block": block, "more": F.substring(ended, depth + 1, width + 1)}).where("left > 0").select("*", at)
        asked = own.select("word", F.lit(0).alias("shift"), letter(F.col("block"), F.col("at")).alias("letter"), key(_without(F.col("block"), F.col("at"), MASK)))
        doubled = letter(F.col("more"), F.col("at")) == letter(F.col("more"), F.col("at") + 1)  # of equal letters in a row, the last goes
        asked = asked.union(own.where(~doubled).select("word", F.lit(1), F.lit(None).cast("string"), key(_without(F.col("more"), F.col("at")))))
        if states is not None:
            rest = F.substring(ended, F.col("shift") + depth + 1, F.lit(width))
            asked = asked.union(states.select("word", "shift", F.lit(None).cast("string"), key(rest)))
        met = asked.join(labels.hint("merge"), "key").where("letter IS NULL OR to_letter > letter")
        met = written(met.select("word", "shift", F.col("child").alias("node"), "below", "only"), "trie-states")
        ends = met.where("below = 1").where(F.levenshtein("word", "only", 1) == 1).select("word", F.col("only").alias("near"))
        pairs.append(written(ends.distinct(), "trie-pairs"))
        passed = alive.select("word", F.xxhash64("node", block).alias("node"))
        shared = edges.where("below > 1").select(F.col("child").alias("node"))
        later = written(passed.join(shared.hint("merge"), "node", "left_semi").select("word", "node"), "trie-words")
        open_states = met.where("below > 1").select("word", "shift", "node")
        done = later.isEmpty() and open_states.isEmpty()
        discard(alive, edges, *([states_table] if states is not None else []))
        alive, states, states_table = later, open_states, met
        depth += width
        if done:
            discard(alive, states_table)
            break
    found = pairs[0]
    for p in pairs[1:]:
        found = found.union(p)
    both = written(found.union(found.select("near", "word")).distinct().toDF("word", "near"), "near-pairs")
    discard(*pairs)
    return both


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last form reached, by pointer doubling; forms must not run in a circle."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(at.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = after.select("word", "root")
        at.written_path = after.written_path
        if after.where("moved").isEmpty():
            return at


def variants(counts: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of (word, n) that are long and frequent enough."""
    words = written(counts.where((F.length("word") >= min_length) & (F.col("n") >= min_count)).select("word", "n"), "words")
    near = near_pairs(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("m")).hint("merge"), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    rows = words.join(best.hint("merge"), "word", "left")
    usual = -F.col("best.m") >= ratio * F.col("n")
    rows = written(
        rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best.m")).alias("form_n")),
        "forms",
    )
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
