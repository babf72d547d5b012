"""Operator 13: exact ranked lexical search by inner products over sparse ball trees.

A document's vector has an integer per term, weight times saturated frequency; an item's has ones, so the score is
their inner product. Only terms of the items matter, so documents are kept as sparse vectors over these. Items are
taken in groups of up to ITEMS that share frequent terms, and a task takes its documents in blocks of up to BLOCK:

1. The group's terms fall into subspaces: the terms that one item has alone, and those that several share. An inner
   product is at most the sum over subspaces of length times length, so a document whose lengths stay under every
   item's threshold is left out, the ball around the origin.
2. The others make a ball tree over the group's terms, split at medians of a random projection. A node has the
   centroid of its documents and, in each subspace, the radius that holds them all.
3. Best first, an item opens the node of the highest bound, centroid . item plus radius times the item's length in each
   subspace, made larger by more than rounding can take from it, and ends once that is under its threshold: the tenth
   best score so far. At leaves scores are exact integers.

Thresholds pass from block to block of a task. They start from the best scores in a share of the documents, searched
before the others by the same tasks: real scores, so they only spare work.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlake.llm.common import Scratch, lowered, sized, table, utf8_buffers, word_spans

TOP = 10
#: Terms of the items that are broadcast at once, on average; more items go in slices, one after the other.
SLICE_TERMS = 400_000
#: Items of a group, documents of a block, cells of a block's dense matrix, documents of a leaf.
ITEMS, BLOCK, CELLS, LEAF = 8, 4_096, 1 << 21, 32
#: 1 of so many documents gives the first thresholds.
AHEAD = 64
#: Dimensions of the projection that trees are split by.
_SKETCH = 12
#: ASCII that ends a term: all but digits and letters.
GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_NO_ID = np.iinfo(np.int64).max


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, A-Z in lower case, one after the other, and the number of terms before each text."""
    data, offsets = utf8_buffers(column)
    data = lowered(data)
    starts, stops, first = word_spans(data, offsets, GAPS)
    ends = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[~GAPS[data]]))])
    return flat, first


def _item_terms(batches):
    for batch in sized(batches, "text"):
        flat, first = terms(batch.column(1))
        sets = [flat.slice(a, b - a).unique().to_pylist() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.binary()))], ["item_id", "terms"])


def _vectors(vocabulary):
    """Arrow function (doc_id, text) -> (doc_id, n, term, tf): terms of the text, and which of the vocabulary it holds how often."""

    def run(batches):
        words = pa.array(vocabulary.value, pa.large_binary())
        for batch in sized(batches, "text"):
            flat, first = terms(batch.column(1))
            at = pc.index_in(flat, value_set=words).fill_null(-1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            known = at >= 0
            key, tf = np.unique(row[known] * len(words) + at[known], return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * len(words)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in ((key % len(words)).astype(np.int32), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first).astype(np.int64)), *lists], ["doc_id", "n", "term", "tf"])

    return run


class Group(NamedTuple):
    """Items that are searched together.

    numbers: the items. terms: their terms, subspace by subspace; a subspace is what several of the items share, or what one
    has alone. places: of each item, the places of its terms. starts: where each subspace begins. roots: by subspace and
    item, the item's length there.
    """

    numbers: list[int]
    terms: np.ndarray
    places: list[np.ndarray]
    starts: np.ndarray
    roots: np.ndarray

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        """Length of each row in each subspace."""
        return np.sqrt(np.add.reduceat(rows * rows, self.starts, axis=1))


def group_of(numbers: list[int], sets: list[np.ndarray]) -> Group:
    held, counts = np.unique(np.concatenate(sets), return_counts=True)
    space = np.full(len(held), -1)
    for k, s in enumerate(sets):
        own = np.searchsorted(held, s)
        space[own[counts[own] == 1]] = k
    order = np.argsort(space, kind="stable")
    spaces, starts = np.unique(space[order], return_index=True)
    place = np.empty(len(held), dtype=np.int64)
    place[order] = np.arange(len(held))
    places = [np.sort(place[np.searchsorted(held, s)]) for s in sets]
    at = np.repeat(np.arange(len(spaces)), np.diff(np.append(starts, len(held))))
    roots = np.stack([np.sqrt(np.bincount(at[p], minlength=len(spaces))) for p in places], axis=1)
    return Group(numbers, held[order], places, starts, roots)


def groups(sets: list[np.ndarray], df: np.ndarray, size: int | None = None) -> list[Group]:
    """Items of like vocabulary in groups: ordered by their three most frequent terms."""
    size = size or ITEMS
    common = lambda s: tuple(s[np.argsort(-df[s], kind="stable")][:3].tolist())
    order = sorted((k for k, s in enumerate(sets) if len(s)), key=lambda k: (common(sets[k]), k))
    return [group_of(order[a : a + size], [sets[k] for k in order[a : a + size]]) for a in range(0, len(order), size)]


def _over(bounds: np.ndarray) -> np.ndarray:
    """Bounds made larger by more than rounding can have taken from them."""
    return bounds * (1 + 1e-9) + 1


class Tree:
    """Ball tree over the rows of a matrix of whole numbers. Nodes are ranges of `order`, children behind their parent.

    A node has a centroid and, for each subspace of the group's terms, the radius around it that holds all its rows there.
    """

    def __init__(self, rows: np.ndarray, group: Group, leaf: int | None = None):
        n, width = rows.shape
        leaf = leaf or LEAF
        self.group = group
        sketch = rows @ np.random.default_rng(13).standard_normal((width, min(_SKETCH, width))) if n > leaf else rows[:, :1]
        self.order, self.spans, self.children = np.arange(n), [(0, n)], []
        for node in range(2 * n):
            if node == len(self.spans):
                break
            lo, hi = self.spans[node]
            part = sketch[self.order[lo:hi]]
            spread = part.max(0) - part.min(0)
            if hi - lo <= leaf or spread.max() <= 1e-9 * np.abs(part).max():  # copies stay together
                self.children.append(())
                continue
            along, cut = part[:, spread.argmax()], (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(along, cut)]
            self.children.append((len(self.spans), len(self.spans) + 1))
            self.spans += [(lo, lo + cut), (lo + cut, hi)]
        self.rows = rows[self.order]
        self.centroids, self.radii = np.zeros((len(self.spans), width)), np.zeros((len(self.spans), len(group.starts)))
        for node in range(len(self.spans) - 1, -1, -1):
            lo, hi = self.spans[node]
            if self.children[node]:
                both = list(self.children[node])
                sizes = np.array([self.spans[c][1] - self.spans[c][0] for c in both])
                self.centroids[node] = sizes @ self.centroids[both] / sizes.sum()
                self.radii[node] = (group.lengths(self.centroids[both] - self.centroids[node]) + self.radii[both]).max(0)
            else:
                self.centroids[node] = self.rows[lo:hi].mean(0)
                self.radii[node] = group.lengths(self.rows[lo:hi] - self.centroids[node]).max(0)

    def bounds(self) -> np.ndarray:
        """For each node and item no less than the score of any document below: centroid . item, and the radius times the item's length in each subspace."""
        ones = np.zeros((self.rows.shape[1], len(self.group.places)))
        for k, p in enumerate(self.group.places):
            ones[p, k] = 1
        return _over(self.centroids @ ones + self.radii @ self.group.roots)


class Best:
    """The best TOP documents of each item so far. Equal scores: the smaller id first."""

    def __init__(self, starts: np.ndarray, top: int = TOP):
        self.top, self.least = top, np.maximum(starts, 1)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if item in self.held:
            scores, ids = (np.concatenate(x) for x in zip(self.held[item], (scores, ids)))
        order = np.lexsort((ids, -scores))[: self.top]
        self.held[item] = scores[order], ids[order]
        if len(order) == self.top:
            self.least[item] = max(self.least[item], int(scores[order[-1]]))


def search(rows: np.ndarray, ids: np.ndarray, group: Group, best: Best) -> int:
    """Hold a block of documents (rows over the group's terms) against its items; documents that were scored, over all items."""
    open_ = (_over(group.lengths(rows) @ group.roots) >= best.least[group.numbers]).any(1)
    rows, ids = rows[open_], ids[open_]
    if not len(rows):
        return 0
    tree, scored = Tree(rows, group), 0
    bounds, ids = tree.bounds(), ids[tree.order]
    for k, (item, places) in enumerate(zip(group.numbers, group.places)):
        bound = bounds[:, k]
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= best.least[item]:
            node = heapq.heappop(heap)[1]
            for child in tree.children[node]:
                heapq.heappush(heap, (-bound[child], child))
            if not tree.children[node]:
                lo, hi = tree.spans[node]
                scores = tree.rows[lo:hi, places].astype(np.int64).sum(1)
                scored += hi - lo
                take = scores >= best.least[item]
                if take.any():
                    best.add(item, scores[take], ids[lo:hi][take])
    return scored


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """A term's saturated frequency in a text of n terms, in whole numbers."""
    m = np.array([10 + 90 * k * documents // length for k in n.tolist()], dtype=np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _search(plan, documents: int, length: int):
    """Arrow function over vectors (doc_id, n, term, tf) -> the best documents of each item among a task's."""

    def run(batches):
        parts, weights, starts = plan.value
        best = Best(starts.copy())
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                ids = piece.column(0).fill_null(_NO_ID).to_numpy()
                sizes = piece.column(2).value_lengths().to_numpy()
                term, tf = (piece.column(k).flatten().to_numpy() for k in (2, 3))
                row = np.repeat(np.arange(len(ids)), sizes)
                value = weights[term] * impacts(tf, np.repeat(piece.column(1).to_numpy(), sizes), documents, length)
                by = np.argsort(term, kind="stable")
                term, row, value = term[by], row[by], value[by]
                for group in parts:
                    lo, hi = np.searchsorted(term, group.terms), np.searchsorted(term, group.terms, "right")
                    count = hi - lo
                    place = np.repeat(np.arange(len(count)), count)
                    take = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
                    met, dense = np.unique(row[take], return_inverse=True)
                    step = max(1, CELLS // len(group.terms))
                    for s in range(0, len(met), step):  # items of very many terms meet fewer documents at a time
                        inside = (dense >= s) & (dense < s + step)
                        matrix = np.zeros((min(step, len(met) - s), len(count)))
                        matrix[dense[inside] - s, place[inside]] = value[take[inside]]
                        search(matrix, ids[met[s : s + step]], group, best)
        for item, (scores, ids) in best.held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["q", "doc_id", "score"])

    return run


def _ranked(hits: DataFrame, top: int = TOP) -> DataFrame:
    """Spark keeps each task's best before the shuffle, so an item brings `top` rows a task at most."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the TOP best documents of each row of `items`, scores above 0 only.

    docs: doc_id long, text. items: item_id, text. Null and blank texts have no term: as documents they count for
    nothing, as items they find nothing. Each row is a document or an item of its own, also if it repeats an id or has none (documents
    without id come last among equal scores). Other columns are not read; either table may be empty.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = items.schema["item_id"].dataType
    found = T.StructType([T.StructField("item_id", kind), T.StructField("terms", T.ArrayType(T.BinaryType()))])
    sets = scratch.save(items.select("item_id", "text").mapInArrow(_item_terms, found), "items")
    total = sets.agg(F.sum(F.size("terms"))).first()[0] or 0
    slices = -(-total // SLICE_TERMS)
    out = None
    for k in range(slices):
        own = sets.where((F.pmod(F.xxhash64("item_id", "terms"), F.lit(slices)) == k) & (F.size("terms") > 0)).toArrow()  # about SLICE_TERMS terms
        if own.num_rows:
            part = _slice(docs, own, kind, scratch, f"{k}")
            out = part if out is None else out.unionByName(part)
    schema = T.StructType([T.StructField("item_id", kind), *T._parse_datatype_string("rank int, doc_id long, score long").fields])
    return out if out is not None else spark.createDataFrame([], schema)


def _slice(docs: DataFrame, own: pa.Table, kind: T.DataType, scratch: Scratch, name: str) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    lists = own.column("terms").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    sets = [np.sort(x) for x in np.split(coded.indices.to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])]
    vectors = scratch.save(docs.mapInArrow(_vectors(context.broadcast(words)), "doc_id long, n long, term array<int>, tf array<long>").where("n > 0"), f"vectors{name}")
    documents, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = np.zeros(len(words), dtype=np.int64)
    for r in vectors.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row a term of the items
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    parts = groups(sets, df)
    held = vectors.where(F.size("term") > 0)
    starts = np.zeros(len(sets), dtype=np.int64)
    ids = own.column("item_id").to_pylist()

    def hits(rows: DataFrame, starts: np.ndarray) -> DataFrame:
        plan = context.broadcast((parts, weights, starts))
        return _ranked(rows.mapInArrow(_search(plan, documents, length), "q long, doc_id long, score long"))

    ahead = hits(held.where(F.pmod(F.xxhash64("doc_id", F.lit("ahead")), F.lit(AHEAD)) == 0), starts)
    for r in ahead.where(F.col("rank") == TOP).collect():  # a row an item at most
        starts[r["q"]] = r["score"]
    names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("q", T.LongType()), T.StructField("item_id", kind)]))
    return hits(held, starts).join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def op13_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "search"))


_SQL_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_TERMS} AS t FROM documents), s AS (SELECT count(*) AS docs, sum(len(t)) AS total FROM d WHERE len(t) > 0),
i AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
v AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS v FROM f JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM i JOIN v USING (term) GROUP BY item_id, doc_id HAVING sum(v) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10
"""
