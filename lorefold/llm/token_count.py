"""Token counts by a finite-state transducer compiled from a byte-pair vocabulary.

A text's tokens come from merging the best-scored adjacent pair first. The sequence of tokens of a prefix is
fixed by its last token and by where that token begins, and two tokens may stand side by side exactly if the
merges of their joined text give these two back. So reading left to right is deterministic: a state holds, for
every suffix of the input that can still grow into a vocabulary entry, the entry's node in the trie, the last
token before it and the number of tokens since. Each transition is annotated with the number of tokens that it
adds (or takes back). Transitions are compiled when first needed and kept by the worker process.

White space starts a chunk (no entry holds a space after another character), and so does a character outside
the vocabulary, which costs one token a UTF-8 byte. A chunk's state map is then constant, whatever came before;
an unbroken run longer than CHUNK is cut and its maps take the state before them. Counts of a document are the
composition of its chunks' maps in order, done for all chunks at once by prefix sums; equal chunks of a slice
are mapped once.

Edge cases: null and empty texts have 0 tokens; special strings are ordinary text; very long texts are cut into
chunks, never shortened; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.llm.bytetext import buffers, code_points, mix, slices

CHUNK = 2048
LIMIT = 4096
KEPT_TRANSITIONS = 300_000
KEPT_CHUNKS = 3_000_000
SPACE = "▁"
_rng = np.random.default_rng(9)
_CLASS = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, CHUNK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Transducer:
    """Reads character classes; transition(state, class) gives (state, added tokens)."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.words = list(scores)
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        singles = [w for w in self.words if len(w) == 1]
        self.classes = {w: k + 1 for k, w in enumerate(singles)}
        for k, w in enumerate(self.words):
            if any(c not in self.classes for c in w):
                continue
            if SPACE in w.lstrip(SPACE):
                raise ValueError(f"an entry holds a space inside: {w!r}")
            node = 0
            for c in w:
                node = self.children[node].setdefault(self.classes[c], len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.token.append(-1)
            self.token[node] = k
        self.reset()
        self.rank = {w: -score for w, score in scores.items()}
        self.number = {w: k for k, w in enumerate(self.words)}
        self.edges: dict[int, tuple] = {}

    def reset(self) -> None:
        self.apart: dict[int, bool] = {}
        self.states: dict[tuple[int, ...], int] = {(128,): 0}
        self.entries: list[tuple[int, ...]] = [(128,)]  # node, 16 bits of the token before + 1, tokens since + 128
        self.moves: dict[int, int] = {}
        self.digests, self.added = np.zeros(0, np.uint64), np.zeros(0, np.int16)

    def merged(self, text: str) -> tuple[list[str], list, list]:
        """The tokens of text; the parts that were at its left and right edge, each with the rank that ended it."""
        parts, left, right, latest = list(text), [], [], 0.0
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                return parts, [*left, (parts[0], np.inf)], [*right, (parts[-1], np.inf)]
            latest = max(latest, best)
            if at == 0:
                left.append((parts[0], latest))
            if at == len(parts) - 2:
                right.append((parts[-1], latest))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stand(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: the beginning): no merge across them comes before their own."""
        if a < 0:
            return True
        key = (a << 16) | b
        if key not in self.apart:
            for k in (a, b):
                if k not in self.edges:
                    self.edges[k] = self.merged(self.words[k])[1:]
            ends, starts, i, j = self.edges[a][1], self.edges[b][0], 0, 0
            while True:
                (x, until_x), (y, until_y) = ends[i], starts[j]
                rank = self.rank.get(x + y)
                if rank is not None and rank < until_x and rank <= until_y:
                    self.apart[key] = False
                    break
                if until_x == until_y == np.inf:
                    self.apart[key] = True
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
        return self.apart[key]

    def compile(self, state: int, cls: int) -> int:
        children, token, found, kept = self.children, self.token, -1, []
        for entry in self.entries[state]:
            child = children[entry >> 24].get(cls)
            if child is None:
                continue
            if (t := token[child]) >= 0 and self.stand(((entry >> 8) & 0xFFFF) - 1, t):
                if found >= 0:
                    raise ValueError("the vocabulary has no deterministic reading")
                found, added = t, 129 - (entry & 255)
            if children[child]:
                kept.append((child << 24) | (entry & 0xFFFFFF))
        if found < 0:
            raise ValueError("the vocabulary has no deterministic reading")
        entries = (*[e + added for e in kept], ((found + 1) << 8) | 128)
        state = self.states.setdefault(entries, len(self.entries))
        if state == len(self.entries):
            self.entries.append(entries)
        return (state << 8) | (added + 128)

    def run(self, classes: list[int], state: int = 0) -> tuple[int, int]:
        """(state afterwards, tokens added) from state."""
        moves, total = self.moves, 0
        for c in classes:
            key = (state << 16) | c
            move = moves.get(key)
            if move is None:
                move = moves[key] = self.compile(state, c)
            state = move >> 8
            total += (move & 255) - 128
        return state, total

    def mapped(self, digests: np.ndarray, chunk_of) -> np.ndarray:
        """Tokens added from the initial state by chunks of ascending digests; chunk_of(k) gives the classes of one."""
        at = np.minimum(np.searchsorted(self.digests, digests), max(0, len(self.digests) - 1))
        seen = self.digests[at] == digests if len(self.digests) else np.zeros(len(digests), bool)
        out = np.zeros(len(digests), np.int64)
        out[seen] = self.added[at[seen]]
        new = np.flatnonzero(~seen)
        for k in new.tolist():
            out[k] = self.run(chunk_of(k))[1]
        if len(self.digests) + len(new) > KEPT_CHUNKS or len(self.moves) > KEPT_TRANSITIONS:
            kept = self.digests, self.added
            self.reset()
            if len(kept[0]) + len(new) <= KEPT_CHUNKS:
                self.digests, self.added = kept
        place = np.searchsorted(self.digests, digests[new])
        self.digests = np.insert(self.digests, place, digests[new])
        self.added = np.insert(self.added, place, out[new].astype(np.int16))
        return out


@cache
def load(model: str) -> tuple[Transducer, np.ndarray]:
    """The transducer of a model file and the class of each code point (0: outside the vocabulary)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    special = (sp.is_unknown, sp.is_control, sp.is_unused, sp.is_byte)
    ids = [i for i in range(sp.vocab_size()) if not any(f(i) for f in special)]
    machine = Transducer({sp.id_to_piece(i): sp.get_score(i) for i in ids})
    table = np.zeros(0x110000, np.uint16)
    for c, k in machine.classes.items():
        table[ord(c)] = k
    table[0x20] = table[ord(SPACE)]
    return machine, table


def counted(data: np.ndarray, offs: np.ndarray, machine: Transducer, table: np.ndarray) -> np.ndarray:
    """Tokens of each row of a slice."""
    rows = len(offs) - 1
    first = np.concatenate(([0], np.cumsum(code_points(data))))[offs]
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    full = np.flatnonzero(np.diff(first))
    points = np.insert(points, first[full], 0x20)  # the text's leading space
    start = first[full] + np.arange(len(full))
    classes = table[points]
    space = classes == table[0x20]
    outside = classes == 0
    total = np.zeros(rows, np.int64)
    if not len(full):
        return total
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    total[full] = np.add.reduceat(np.where(outside, width, 0), start)
    cut = np.zeros(len(points), bool)
    cut[start] = True
    cut[1:] |= (space[1:] & ~space[:-1]) | outside[:-1]
    cut |= outside
    heads = np.flatnonzero(cut)
    run = np.arange(len(points)) - np.repeat(heads, np.diff(np.append(heads, len(points))))
    chunk = np.flatnonzero(run % CHUNK == 0)
    size = np.diff(np.append(chunk, len(points)))
    value = _CLASS[classes] * _PLACE[run % CHUNK]
    digest = mix(np.add.reduceat(value, chunk) ^ size.astype(np.uint64))
    known = ~outside[chunk]
    chunk, size, digest = chunk[known], size[known], digest[known]
    fresh = run[chunk] == 0
    added = np.zeros(len(chunk), np.int64)
    distinct, one, back = np.unique(digest[fresh], return_index=True, return_inverse=True)
    where = np.flatnonzero(fresh)

    def chunk_of(k: int) -> list[int]:
        a = chunk[where[one[k]]]
        return classes[a : a + size[where[one[k]]]].tolist()

    maps = machine.mapped(distinct, chunk_of)
    added[where] = maps[back]
    for i in np.flatnonzero(~fresh).tolist():
        if fresh[i - 1]:
            a = chunk[i - 1]
            state, _ = machine.run(classes[a : a + size[i - 1]].tolist())
        a = chunk[i]
        state, added[i] = machine.run(classes[a : a + size[i]].tolist(), state)
    np.add.at(total, full[np.searchsorted(start, chunk, side="right") - 1], added)
    return total


def count_tokens(
    docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT
) -> DataFrame:
    """The keep columns with n_bytes, n_tokens (long) and over_limit (n_tokens > limit); model: the file's path."""
    schema = docs.select(
        *keep, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("over_limit")
    ).schema

    def count(batches):
        machine, table = load(model)
        for batch in batches:
            data, offs = buffers(batch.column(text))
            tokens = [
                counted(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], machine, table) for a, b in slices(offs)
            ]
            tokens = np.concatenate([np.zeros(0, np.int64), *tokens])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.diff(offs)), pa.array(tokens), pa.array(tokens > limit)],
                schema.names,
            )

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(count, schema)


def op9_token_count(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, str(public_tokenizers.path("piece_bpe_32k.model")))
