"""Operator 8: BPE encoding and decoding by a token automaton.

The automaton reads tokens and accepts exactly the token sequences that BPE produces. It starts
with one state whose arcs are the base symbols and takes one gadget per merge (u, v), in order: every
state with an arc u whose target has an arc v gets an arc uv; the target of u loses its arc v. All arcs
with one label share their target, so a state is named by the label that leads to it, and the whole
automaton is a table of bits, state by label, that the gadgets fill (`_gadgets`). Labels with equal arcs share a
column, which leaves some 30 MB for 49,000 labels; each worker compiles it once, in seconds. A word's encoding is the
one path whose labels spell the word; a second table steps over bytes and knows the labels that end there.

Text handling is that of the vocabulary file: NFC, one blank for white space, lower case, the pre-token
pattern, byte-level symbols and a word-end suffix on the last symbol; strings of special tokens in a
text are those tokens. Decoding joins the arc labels by blanks, as a file without a decoder asks.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlake.llm.common import hex_sha256, sized, table

#: Words that a worker keeps (some 30 MB); they are dropped when full. Longer words are not kept.
MEMO_WORDS, MEMO_CHARS = 120_000, 40

#: White space as the vocabulary's pattern library has it (the Unicode property White_Space).
_BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where printable, else the next code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class Automaton:
    """Compiled from an ordered merge list; `encode` runs it over one pre-token, `labels` has the arcs' labels by id.

    States: 0 is the start, then one for each label that a word can go on after (labels with the word-end
    suffix end the word). Whether state s has an arc y is bit s of y's column; labels may share a column.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels = [""] * (1 + max(*ids.values(), *self.special.values()))
        for text, i in chain(ids.items(), self.special.items()):
            self.labels[i] = text
        made = [u + v for u, v in model["merges"]]
        merged = set(made)
        if len(merged) < len(made):
            raise ValueError("two merges make one label")
        bases = [t for t in ids if t not in merged]
        order = bases + made
        state = {t: s for s, t in enumerate((t for t in order if not suffix or not t.endswith(suffix)), 1)}
        self.dead = len(state) + 1  # the state of positions that no path reaches
        columns, group = _gadgets(model["merges"], order, state, len(bases))
        self.arcs, width = columns.tobytes(), columns.shape[1]
        places = [g * width for g in group]
        self._spell(order, state, places, ids, suffix)

    def _spell(self, order: list[str], state: dict[str, int], places: list[int], ids: dict[str, int], suffix: str) -> None:
        """The byte table: `step` leads from node and byte to the next node, `back` where no step does.

        A node's arcs (length, column, state, id) are those whose labels end at the byte just read, the longest first:
        `inner` within a word, `last` at its end.
        """
        code = {s: b for b, s in enumerate(byte_symbols())}
        self.step: dict[int, int] = {}
        inner: list = [()]
        last: list = [()]
        for token, place in zip(order, places, strict=True):
            ends = bool(suffix) and token.endswith(suffix)
            spelt = token[: -len(suffix)] if ends else token
            node = 0
            for s in spelt:
                node = self.step.setdefault(node << 8 | code[s], len(inner))
                if node == len(inner):
                    inner.append(())
                    last.append(())
            (last if ends else inner)[node] = ((len(spelt), place, state.get(token, self.dead), ids[token]),)
        self.inner, self.last = inner, last if suffix else inner
        self.back = [0] * len(inner)
        level = [(0, key, node) for key, node in self.step.items() if key < 256]
        below: dict[int, list] = {}
        for key, node in self.step.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        while level:
            for parent, key, node in level:
                if parent:
                    self.back[node] = self._next(self.back[parent], key & 255)
                inner[node] += inner[self.back[node]]
                if suffix:
                    last[node] += last[self.back[node]]
            level = [(node, byte, child) for _, _, node in level for byte, child in below.get(node, ())]

    def _next(self, node: int, byte: int) -> int:
        found = self.step.get(node << 8 | byte, 0)
        while not found and node:
            node = self.back[node]
            found = self.step.get(node << 8 | byte, 0)
        return found

    def encode(self, word: str) -> tuple[int, ...]:
        """The labels of the accepted path that spells the pre-token.

        One sweep over the bytes: of the arcs whose labels end at a byte, the one is taken that the state at its start
        has. At most one path reaches a position, so there is nothing to go back to, and work is linear in the length.
        """
        step, back, arcs, inner, dead = self.step.get, self.back, self.arcs, self.inner, self.dead
        data = word.encode()
        n = len(data)
        states, taken = [0], [(0, 0, 0, -1)]
        node = to = 0
        for byte in data:
            found = step(node << 8 | byte, 0)
            while not found and node:
                node = back[node]
                found = step(node << 8 | byte, 0)
            node = found
            to += 1
            for arc in inner[node] if to < n else self.last[node]:
                s = states[-arc[0]]
                if arcs[arc[1] + (s >> 3)] >> (s & 7) & 1:
                    states.append(arc[2])
                    taken.append(arc)
                    break
            else:
                states.append(dead)
                taken.append(None)
        path = []
        while n:
            arc = taken[n]
            if arc is None:
                raise ValueError("the vocabulary has no path for a word")
            path.append(arc[3])
            n -= arc[0]
        return tuple(reversed(path))


def _gadgets(merges: list, order: list[str], state: dict[str, int], n: int) -> tuple[np.ndarray, list[int]]:
    """Columns after all gadgets, a bit per state, and the column of each label of `order`; the first n are the base symbols.

    Labels share a column until a gadget takes an arc from one of them.
    """
    label = {t: k for k, t in enumerate(order)}
    columns = np.zeros((4096, (len(state) + 1) // 8 + 1), dtype=np.uint8)
    first = np.zeros(columns.shape[1] * 8, dtype=np.uint8)
    first[[0, *(state[t] for t in order[:n] if t in state)]] = 1
    columns[1] = np.packbits(first, bitorder="little")  # column 0 is that of labels without an arc
    used, group, sharing = 2, [1] * n, {0: 0, 1: n}

    def own(g: int) -> int:
        """A copy of a column for one label."""
        nonlocal columns, used
        if used == len(columns):
            columns = np.concatenate([columns, np.zeros_like(columns[: used // 4])])
        columns[used] = columns[g]
        sharing[used] = 1
        used += 1
        return used - 1

    for u, v in merges:
        a, b, s = label[u], label[v], state.get(u, 0)
        at, bit = s >> 3, 1 << (s & 7)
        if not s or not columns[group[b], at] & bit:
            group.append(0)  # no path has u and v next to each other
            continue
        if a == b:  # of three equal labels the first two merge
            group.append(own(group[a]))
            columns[group[-1], at] &= 255 - bit
        else:
            group.append(group[a])
            sharing[group[a]] += 1
        new = state.get(u + v)
        if new is not None:  # its state goes on as v's did
            row = columns[:used, state[v] >> 3] >> (state[v] & 7) & 1
            if a == b:
                row[group[-1]] = 1
            columns[:used, new >> 3] |= row << (new & 7)
        if sharing[group[b]] > 1:
            sharing[group[b]] -= 1
            group[b] = own(group[b])
        columns[group[b], at] &= 255 - bit
    return columns[:used], group


class Memo(dict):
    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.machine.encode(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = found
        return found


class Tokenizer:
    """Splitting around the automaton, as the vocabulary file states it."""

    def __init__(self, spec: dict):
        self.machine = Automaton(spec)
        self.memo = Memo(self.machine)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._exact = regex.compile(pattern.replace("\\s", _BLANKS)).findall
        self._usual = re.compile(_usual(pattern)).findall
        self._alike = _differing().isdisjoint
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.machine.special)) + ")") if self.machine.special else None

    def encode(self, text: str) -> Iterator[int]:
        if self.special and "<|" in text:
            parts = self.special.split(text)
            return chain.from_iterable((self.machine.special[p],) if k % 2 else self._plain(p) for k, p in enumerate(parts))
        return self._plain(text)

    def words(self, text: str) -> list[str]:
        """Pre-tokens. The standard library's classes agree with the pattern's but for a few characters."""
        return self._usual(text) if self._alike(text) else self._exact(text)

    def _plain(self, text: str) -> Iterator[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case goes by single characters
        return chain.from_iterable(map(self.memo.__getitem__, self.words(text.lower())))

    def decode(self, ids) -> str:
        return " ".join(map(self.machine.labels.__getitem__, ids))


def _usual(pattern: str) -> str:
    """The pattern in the standard library's classes: letters are word characters but digits and _."""
    return pattern.replace("[^\\s\\p{L}\\p{N}]", "(?:[^\\s\\w]|_)").replace("[\\p{L}]", "[^\\W\\d_]").replace("[\\p{N}]", "\\d").replace("\\p{L}", "[^\\W\\d_]").replace("\\p{N}", "\\d")


@functools.cache
def _differing() -> frozenset[str]:
    """The characters that the two libraries take differently: numbers that aren't digits, separators."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl") or "\x1c" <= c <= "\x1f")


def load_spec(path: str) -> str:
    """The vocabulary file's text, read on the driver; its size bounds what is broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_made: dict[int, Tokenizer] = {}


def tokenizer(spec: str) -> Tokenizer:
    """One per worker and vocabulary."""
    key = hash(spec)
    if key not in _made:
        _made.clear()
        _made[key] = Tokenizer(json.loads(spec))
    return _made[key]


def encode_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>, decoded string), one per input row, in one narrow pass.

    Null and empty texts give empty ids and an empty decoding. Rows repeat as they come, a null key stays
    null, other columns of `docs` are not read, and an empty table gives an empty one. Texts of any
    length are encoded whole; memory follows the longest text of a batch piece of about 4 MB.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(vocabulary))
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        made = tokenizer(spec.value)
        for batch in sized(batches, "text"):
            flat, ends, decoded = [], [0], []
            for value in batch.column(1).to_pylist():
                ids = np.fromiter(made.encode(value or ""), dtype=np.int32)
                flat.append(ids)
                ends.append(ends[-1] + len(ids))
                decoded.append(made.decode(ids.tolist()))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.string())], ["key", "ids", "decoded"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one per row of `docs`."""
    return encode_decode(docs, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.array_join("ids", " ")).alias("ids_sha256"),
        hex_sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), word_vocabulary())
