"""Operator 10: duplicate passages by super-k-mer partitioning.

A window is `WINDOW` consecutive words. Its minimiser is the least hash of its runs of `GRAM` words, so
equal windows have equal minimisers. Consecutive windows of a document that share a minimiser travel
together: one row with the packed piece of text that they cover goes to the minimiser's bucket. There
the windows are unpacked, sorted by a 128-bit hash of their exact words, and every window that also starts
in a document with a smaller id is marked. Only marked spans come back to the documents.

Only minimisers that stand under two ids or more can mark anything. A slim table of (minimiser, id) tells
which those are and how many rows each would get; documents learn theirs before anything is packed.
A minimiser of over HOT_ROWS rows (a passage in a third of all documents, say) has its windows grouped by
window instead, which combines on the map side, so no bucket outgrows that bound; results are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlake.llm.common import Scratch, hex_sha256, mixed, release, run_hashes, sized, table, utf8_buffers, word_hashes, word_ids, word_spans

WINDOW, GRAM = 50, 8
#: Longest run of windows in one row, which bounds the row's size.
RUN = 1_024
#: Rows above which a minimiser has no bucket and its windows are grouped one by one.
HOT_ROWS = 2_000
#: Text bytes that a task splits, or unpacks from buckets, at a time.
CHUNK = 4 << 20
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
PACKED = "doc_id long, version long, mini long, at long, packed binary, one long, two long"


def _windows(words: tuple[np.ndarray, np.ndarray], first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window inside a row, and the windows before each row: sums of word times power, shifted back.

    words: two numbers of each word, one for each hash.
    """
    counts = np.maximum(np.diff(first) - window + 1, 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(before[-1]) + np.repeat(first[:-1] - before[:-1], counts)
    out = []
    for k, base in enumerate(_BASES):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        own = mixed(words[k] * _BASES[0] + np.uint64(k + 1))
        up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(own), base))])
        down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(own), inverse))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(own * up[:-1])])
        out.append(mixed((sums[at + window] - sums[at]) * down[at]))
    return out[0], out[1], before


def _minimisers(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's minimiser, its row, and the windows before each row."""
    grams, before = run_hashes(words, first, gram)
    width, length = window - gram + 1, 1
    least = grams
    while length * 2 <= width:
        least = np.minimum(least[:-length], least[length:]) if len(least) > length else least[:0]
        length *= 2
    if length < width:
        least = np.minimum(least[: -(width - length)], least[width - length :]) if len(least) > width - length else least[:0]
    counts = np.maximum(np.diff(first) - window + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    rows = np.repeat(np.arange(len(counts)), counts)
    return least[np.arange(ends[-1]) - ends[rows] + before[rows]], rows, ends


class _Runs:
    """The super-k-mers of a batch of texts: runs of windows of a row that share a minimiser."""

    def __init__(self, text: pa.Array, window: int, gram: int):
        self.data, offsets = utf8_buffers(text)
        self.starts, self.stops, self.first = word_spans(self.data, offsets)
        self.words = word_hashes(self.data, self.starts, self.stops)
        self.least, self.rows, ends = _minimisers(self.words, self.first, window, gram)
        self.inside = np.arange(len(self.least)) - ends[self.rows]
        new = np.ones(len(self.least), dtype=bool)
        new[1:] = (self.least[1:] != self.least[:-1]) | (self.rows[1:] != self.rows[:-1]) | (self.inside[1:] % RUN == 0)
        self.cuts = np.flatnonzero(new)
        self.sizes = np.diff(np.concatenate([self.cuts, [len(self.least)]]))


def _list(window: int, gram: int):
    """Arrow function over (doc_id, text): the id and minimiser of every super-k-mer."""

    def run(batches):
        for batch in sized(batches, "text", CHUNK):
            found = _Runs(batch.column(1), window, gram)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found.rows[found.cuts])), pa.array(found.least[found.cuts].view(np.int64))], ["doc_id", "mini"])

    return run


def _pack(window: int, gram: int):
    """Arrow function over (doc_id, version, text, minis, hot): PACKED rows, a super-k-mer of a listed minimiser each, or a window if it is hot."""

    def run(batches):
        for batch in sized(batches, "text", CHUNK):
            found = _Runs(batch.column(2), window, gram)
            cold, hot = (np.unique(batch.column(k).flatten().to_numpy().view(np.uint64)) for k in (3, 4))
            least = found.least[found.cuts]
            apart = np.isin(least, hot)
            take = np.isin(least, cold) & ~apart
            cuts, sizes = found.cuts[take], found.sizes[take]
            if len(cuts):
                word = found.first[found.rows[cuts]] + found.inside[cuts]
                text = found.data.tobytes()
                packed = [text[a:b] for a, b in zip(found.starts[word].tolist(), found.stops[word + sizes + window - 2].tolist())]
                rows, none = pa.array(found.rows[cuts]), pa.nulls(len(cuts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found.least[cuts].view(np.int64)), pa.array(found.inside[cuts]), pa.array(packed, pa.binary()), none, none],
                    ["doc_id", "version", "mini", "at", "packed", "one", "two"],
                )
            picked = np.flatnonzero(np.repeat(apart, found.sizes))
            if len(picked):
                one, two, _ = _windows((found.words, word_hashes(found.data, found.starts, found.stops, 1)), found.first, window)
                rows = pa.array(found.rows[picked])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found.least[picked].view(np.int64)), pa.array(found.inside[picked]), pa.nulls(len(picked), pa.binary()), pa.array(one[picked].view(np.int64)), pa.array(two[picked].view(np.int64))],
                    ["doc_id", "version", "mini", "at", "packed", "one", "two"],
                )

    return run


def _mark(window: int):
    """Arrow function over a bucket partition, sorted by minimiser: spans [from, to) of words to remove."""

    def solved(rows: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        docs = whole.column(0).to_numpy(zero_copy_only=False)
        data, offsets = utf8_buffers(whole.column(4))
        starts, stops, first = word_spans(data, offsets)
        ids = word_ids(data, starts, stops)
        one, two, before = _windows((ids, ids), first, window)
        if not len(one):
            return None
        row = np.repeat(np.arange(len(docs)), np.diff(before))
        order = np.argsort(one, kind="stable")
        new = one[order][1:] != one[order][:-1]
        other = two[order][1:] != two[order][:-1]
        if (other & ~new).any():
            order = np.lexsort((two, one))
            new = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        heads = np.flatnonzero(np.concatenate([[True], new]))
        ids = docs[row]
        least = np.repeat(np.minimum.reduceat(ids[order], heads), np.diff(np.concatenate([heads, [len(order)]])))
        marked = np.zeros(len(ids), dtype=bool)
        marked[order] = ids[order] > least
        hits = np.flatnonzero(marked)
        if not len(hits):
            return None
        cut = np.concatenate([[True], (np.diff(hits) > 1) | (row[hits][1:] != row[hits][:-1])])
        begin = hits[cut]
        end = hits[np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(hits) - 1]])]
        shift = whole.column(3).to_numpy()[row[begin]] - before[row[begin]]
        take = pa.array(row[begin])
        return pa.RecordBatch.from_arrays([whole.column(0).take(take), whole.column(1).take(take), pa.array(begin + shift), pa.array(end + shift + window)], ["doc_id", "version", "begin", "end"])

    def run(batches):
        kept, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            mini = batch.column(2).to_numpy()
            sizes = np.diff(utf8_buffers(batch.column(4))[1])
            edges = np.concatenate([[0], np.flatnonzero(mini[1:] != mini[:-1]) + 1, [len(mini)]])
            total = np.concatenate([[0], np.cumsum(sizes)])
            start = 0
            # a group may go on from the batch before, so what is held is only solved at a later edge
            fresh = not kept or kept[-1].column(2)[-1].as_py() != int(mini[0])
            for edge in edges[(0 if fresh else 1) :]:
                if held + total[edge] - total[start] >= CHUNK and edge < len(mini):
                    kept.append(batch.slice(start, int(edge) - start))
                    if (out := solved([b for b in kept if b.num_rows])) is not None:
                        yield out
                    kept, held, start = [], 0, int(edge)
            kept.append(batch.slice(start))
            held += int(total[-1] - total[start])
        if kept and (out := solved(kept)) is not None:
            yield out

    return run


def _kept(text: pa.Array, spans: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words, words outside the spans, and those joined by one blank, for each text."""
    data, offsets = utf8_buffers(text)
    starts, stops, first = word_spans(data, offsets)
    delta = np.zeros(len(starts) + 1, dtype=np.int64)
    if spans.null_count < len(spans):
        flat = spans.flatten()
        lengths = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        base = np.repeat(first[:-1], lengths)
        np.add.at(delta, flat.field(0).to_numpy() + base, 1)
        np.add.at(delta, flat.field(1).to_numpy() + base, -1)
    word = np.flatnonzero(np.cumsum(delta)[:-1] == 0)
    row = np.searchsorted(first, word, side="right") - 1
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(edge, starts[word], 1)
    np.add.at(edge, stops[word], -1)
    mask = np.cumsum(edge[:-1]) > 0
    out = data.copy()
    between = stops[word[:-1]][row[1:] == row[:-1]] if len(word) else word
    mask[between] = True
    out[between] = 0x20
    ends = np.concatenate([[0], np.cumsum(mask)])[offsets]
    joined = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out[mask].tobytes())).cast(pa.string())
    return np.diff(first).astype(np.int64), np.bincount(row, minlength=len(text)).astype(np.int64), joined


def _keep(batches):
    """Arrow function over (doc_id, text, spans)."""
    for batch in sized(batches, "text", CHUNK):
        words, left, text = _kept(batch.column(1), batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(words - left), text], ["doc_id", "n_words", "n_removed", "kept"])


def _rewrite(batches):
    """Arrow function over whole rows with spans last: rows that lost words get the rest as text, those that lost all go."""
    for batch in sized(batches, "text", CHUNK):
        names, columns = batch.schema.names[:-1], batch.columns[:-1]
        at = names.index("text")
        words, left, text = _kept(columns[at], batch.column(len(names)))
        lost = pa.array(left < words)
        columns[at] = pc.if_else(lost, text, columns[at])
        if "n_chars" in names:
            k = names.index("n_chars")
            columns[k] = pc.if_else(lost, pc.utf8_length(text).cast(columns[k].type), columns[k])
        yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array((left > 0) | (words == 0)))


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (doc_id, version, begin, end): words covered by windows that also start under a smaller doc_id.

    version is a hash of the text, so rows that repeat a doc_id are told apart.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    slim = scratch.save(rows.mapInArrow(_list(window, gram), "doc_id long, mini long"), "slim")
    # what the join reads is stored, so its sides are plain shuffles and a hot minimiser can be split
    shared = slim.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.count("*") > hot_rows).alias("hot")).where("lo < hi")
    shared = scratch.save(shared.select("mini", "hot"), "shared")
    listed = slim.join(shared, "mini").groupBy("doc_id").agg(F.collect_set(F.when(~F.col("hot"), F.col("mini"))).alias("minis"), F.collect_set(F.when(F.col("hot"), F.col("mini"))).alias("hot"))
    listed = scratch.save(listed, "listed")
    met = rows.hint("merge").join(listed, "doc_id").select("doc_id", F.xxhash64("text").alias("version"), "text", "minis", "hot")
    packed = scratch.save(met.mapInArrow(_pack(window, gram), PACKED), "packed")
    scratch.drop("slim", "shared", "listed")
    release(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = packed.where("packed IS NOT NULL").select("doc_id", "version", "mini", "at", "packed").repartition(parts, "mini").sortWithinPartitions("mini")
    spans = scratch.save(buckets.mapInArrow(_mark(window), "doc_id long, version long, begin long, end long"), "spans")
    apart = packed.where("packed IS NULL").select("doc_id", "version", "at", "one", "two")
    least = apart.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    least = scratch.save(least, "least")  # stored as `shared` is
    more = apart.join(least, ["one", "two"]).where("doc_id > least").select("doc_id", "version", F.col("at").alias("begin"), (F.col("at") + window).alias("end"))
    spans = spans.unionByName(scratch.save(more, "more"))
    scratch.drop("packed", "least")
    release(spark)
    return spans


def remove_repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept), one per row of `docs` (doc_id long, text).

    Words are split by blanks and the controls from tab to carriage return, and stay as they are. A null
    text has none; texts shorter than a window keep all. Rows without doc_id lose nothing and count for
    nothing. Rows that share a doc_id don't remove each other's words. Other columns are not read; an
    empty table gives an empty one.
    """
    rows = _with_spans(docs.select("doc_id", "text"), repeated_spans(docs, scratch, window, gram, hot_rows))
    return rows.select("doc_id", "text", "spans of words").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept string")


def rewrite_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """`docs` (doc_id long, text, and any others) without repeated passages, under the same columns.

    Documents that lose nothing stay as they are; others hold their remaining words joined by one blank, with
    n_chars to match; those of which no word is left go.
    """
    rows = _with_spans(docs, repeated_spans(docs, scratch))
    return rows.select(*docs.columns, "spans of words").mapInArrow(_rewrite, docs.schema)


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row with the list of its spans, null if it has none."""
    listed = spans.distinct().groupBy("doc_id", "version").agg(F.collect_list(F.struct("begin", "end")).alias("spans of words"))
    listed = listed.select(F.col("doc_id").alias("id of spans"), F.col("version").alias("version of spans"), "spans of words")
    same = (F.col("doc_id") == F.col("id of spans")) & (F.xxhash64("text") == F.col("version of spans"))
    return docs.join(listed, same, "left").drop("id of spans", "version of spans")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "substrings"))
    return out.select("doc_id", "n_words", "n_removed", hex_sha256(F.col("kept")).alias("kept_sha256"))


OP10_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
