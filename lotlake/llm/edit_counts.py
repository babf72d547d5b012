"""Operator 9: token counts that follow edits.

Each document keeps a segment tree over its pre-tokens. A leaf stands for a few consecutive pre-tokens; nodes hold
the sums of characters and tokens below them. An edit descends to the leaf it falls in, backs up to a leaf
start whose boundary the edit can't move, splits from there until a boundary of the new text meets an old leaf
start behind the edit, encodes only what lies between, and updates the sums on the way up.

Why that is exact: the split looks ahead, never back, so from any boundary on it depends on the text from
there. A pre-token that ends at A has looked at no more than the white space after A and the character behind
it, and a contraction at no more than two characters after A; see `_safe`.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlake.llm.bpe_automaton import _differing, _usual
from lotlake.llm.common import Scratch, sized, table

#: Pre-tokens of a leaf when built; a leaf that edits have grown beyond LARGEST makes the tree be built anew.
LEAF, LARGEST = 32, 512
#: Pre-tokens kept in a worker's memo, which is emptied when full; longer ones are not kept.
MEMO_WORDS, MEMO_CHARS = 200_000, 40
STATE = "key long, text string, chars array<int>, tokens array<int>"


class Counter(dict):
    """Tokens of each pre-token, worked out once; splitting as the vocabulary's pattern says."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        super().__init__()
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self._exact, self._near = regex.compile(pattern), re.compile(_usual(pattern))
        self._alike = _differing().isdisjoint

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[piece] = n
        return n

    def alike(self, text: str) -> bool:
        """Whether the faster pattern splits the text, or any that is made of its characters, as the exact one does."""
        return self._alike(text)

    def pattern(self, alike: bool):
        return self._near if alike else self._exact


def _built(pairs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Trees of sums over the leaves (characters, tokens): node k has 2k and 2k + 1 below it, the root is 1."""
    size = 1
    while size < max(1, len(pairs)):
        size *= 2
    out = []
    for part in range(2):
        tree = [0] * size + [p[part] for p in pairs] + [0] * (size - len(pairs))
        for k in range(size - 1, 0, -1):
            tree[k] = tree[2 * k] + tree[2 * k + 1]
        out.append(tree)
    return out[0], out[1]


def build(text: str, counter: Counter) -> tuple[list[int], list[int]]:
    pieces = counter.pattern(counter.alike(text)).findall(text)
    counts, lengths = list(map(counter.__getitem__, pieces)), list(map(len, pieces))
    return _built([(sum(lengths[k : k + LEAF]), sum(counts[k : k + LEAF])) for k in range(0, len(pieces), LEAF)])


class Document:
    """A text and its trees under edits."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], counter: Counter):
        self.text, self.chars, self.tokens, self.counter = text, chars, tokens, counter
        self.encoded, self.alike = 0, counter.alike(text)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one for the end), and where it starts."""
        node, start, size = 1, 0, len(self.chars) // 2
        while node < size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node, start

    def _safe(self, start: int, at: int) -> bool:
        """Whether an edit at `at` leaves the boundary at `start` where it is."""
        return start == 0 or (at - start >= 3 and not self.text[start : at - 1].isspace())

    def _set(self, node: int, chars: int, tokens: int) -> None:
        c, t = chars - self.chars[node], tokens - self.tokens[node]
        while node and (c or t):
            self.chars[node] += c
            self.tokens[node] += t
            node //= 2

    def edit(self, at: int, deleted: int, inserted: str) -> None:
        at = min(max(at, 0), len(self.text))
        deleted = min(max(deleted, 0), len(self.text) - at)
        leaf, start = self._leaf(at)
        while not self._safe(start, at):
            leaf, start = self._leaf(start - 1)
        old_end, shift = at + deleted, len(inserted) - deleted
        self.text = self.text[:at] + inserted + self.text[old_end:]
        self.alike = self.alike and self.counter.alike(inserted)  # only what is new is looked at
        last, edge = self._leaf(old_end)  # the first leaf start that may stay: behind the deleted part
        if edge < old_end or edge <= start:
            edge += self.chars[last]
            last += 1
        size, end, pieces = len(self.chars) // 2, len(self.chars), []
        to = start
        for m in self.counter.pattern(self.alike).finditer(self.text, start):
            while last < end and edge + shift < to:
                edge += self.chars[last]
                last += 1
            if to >= at + len(inserted) and to == edge + shift and to > start:
                break
            pieces.append(m[0])
            to = m.end()
        else:
            last = end
        self.encoded += len(pieces)
        chars, tokens = sum(map(len, pieces)), sum(map(self.counter.__getitem__, pieces))
        if len(pieces) > LARGEST or leaf >= end:
            self.chars, self.tokens = build(self.text, self.counter)
            return
        self._set(leaf, chars, tokens)
        for node in range(leaf + 1, min(last, 2 * size)):
            self._set(node, 0, 0)


def _counter(held) -> Counter:
    if not hasattr(_counter, "made"):
        _counter.made = {}
    ranks, pattern = held.value
    key = (hash(ranks), pattern)
    if key not in _counter.made:
        _counter.made.clear()
        _counter.made[key] = Counter(ranks, pattern)
    return _counter.made[key]


def _vocabulary(spark: SparkSession, path: str, pattern: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def build_trees(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The state (key, text, chars, tokens), one row per row of `docs` (key long); chars[1] and tokens[1] are totals.

    Null texts are empty. Rows repeat as they come, null keys stay, other columns are not read.
    """
    held = _vocabulary(docs.sparkSession, vocabulary, pattern)

    def run(batches):
        counter = _counter(held)
        for batch in sized(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            trees = [build(t, counter) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), *(pa.array([t[k] for t in trees], pa.list_(pa.int32())) for k in range(2))], ["key", "text", "chars", "tokens"]
            )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, STATE)


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """`state` with the column edits: those of `edits` (key, seq, at, deleted, inserted) for each key, by seq.

    A document's edits apply one after the other, so they meet in its row.
    """
    listed = edits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "at", "deleted", "inserted"))).alias("edits"))
    return state.join(listed, "key", "left")


def apply_edits(state: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """State after each row's `edits` (array<struct<seq, at, deleted, inserted>>), with n_before, the tokens before
    them, and n_encoded, the pre-tokens encoded for them.

    Offsets are code points of the text as the edits before have left it and are held to its bounds; null
    numbers are 0, a null insertion is empty, null edits are none.
    """
    held = _vocabulary(state.sparkSession, vocabulary, pattern)

    def run(batches):
        counter = _counter(held)
        for batch in sized(batches, "text"):
            done = []
            for text, chars, tokens, edits in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                doc = Document(text, chars, tokens, counter)
                for e in edits or []:
                    doc.edit(e["at"] or 0, e["deleted"] or 0, e["inserted"] or "")
                done.append(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([d.text for d in done], pa.string()),
                    pa.array([d.chars for d in done], pa.list_(pa.int32())),
                    pa.array([d.tokens for d in done], pa.list_(pa.int32())),
                    pa.array([t[1].as_py() for t in batch.column(3)], pa.int64()),
                    pa.array([d.encoded for d in done], pa.int64()),
                ],
                ["key", "text", "chars", "tokens", "n_before", "n_encoded"],
            )

    return state.select("key", "text", "chars", "tokens", "edits").mapInArrow(run, STATE + ", n_before long, n_encoded long")


def sample_edits(key: Column, text: Column) -> Column:
    """Four edits that follow from a document alone: copy a piece, cut a piece, replace one, append one."""
    place = lambda n, upto: F.pmod(F.xxhash64(key, F.lit(n)), upto.cast("long")).cast("int")
    size = F.length(text)
    edit = lambda n, at, deleted, inserted: F.struct(F.lit(n).alias("seq"), at.alias("at"), F.lit(deleted).alias("deleted"), inserted.alias("inserted"))
    return F.array(
        edit(0, place(0, size + 1), 0, F.substring(text, place(1, size + 1) + 1, F.lit(25))),
        edit(1, place(2, size + 1), 40, F.lit("")),
        edit(2, place(3, size + 1), 10, F.lit("'s 2024\n  it'")),
        edit(3, size + 100, 0, F.lit(" the end.  ")),
    )


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's count, and its count after four edits to it."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    scratch = Scratch(spark, "counts")
    state = scratch.save(build_trees(table(spark, sf_dir, "documents"), *vocabulary), "trees")
    after = apply_edits(state.withColumn("edits", sample_edits(F.col("key"), F.col("text"))), *vocabulary)
    root = lambda tree: F.get(tree, F.lit(1)).cast("long")
    return after.select(F.col("key").alias("doc_id"), F.col("n_before").alias("n_tokens"), root("tokens").alias("n_tokens_edited"), root("chars").alias("n_chars_edited"), "n_encoded")
