"""Operator 2: language identification by prediction by partial matching.

Per language a context tree counts which byte follows each context of up to `order` bytes. A text's
code length under a language is the sum over its bytes of -log2 p, where p comes from the longest
known context, escaping to shorter ones (method C: escapes count as often as there are different
successors; successors already offered by a longer context are excluded). The counts are frozen, so a
byte's code length depends on its context alone: all of them are worked out once, into tables of
(context, byte, language), and scoring is table lookups over whole texts. The least code length wins.
Languages share a table while it stays within TABLE_BYTES, so tables grow in number and no context is left out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlake.llm.common import lowered, sized, table, utf8_buffers, word_spans

#: Longest context in bytes.
ORDER = 3
#: The fit's bounds: text bytes read per language (expected; rows are drawn by a hash), and languages (more are an error).
SAMPLE_BYTES, LANGUAGES = 1_500_000, 64
#: Bytes of a table that several languages share. A language by itself has a table of any size, which its sample bounds.
TABLE_BYTES = 64 << 20
#: What stands before a text.
_PAD = 0x0A
#: Bytes that are scored at a time.
STRIP = 1 << 16


def _padded(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows, each after `order` pad bytes, and where each row's own bytes begin."""
    rows = len(offsets) - 1
    out = np.full(len(data) + order * rows, _PAD, dtype=np.uint8)
    begins = offsets[:-1] + order * np.arange(1, rows + 1)
    at = np.arange(len(data)) + np.repeat(order * np.arange(1, rows + 1), np.diff(offsets))
    out[at] = data
    return out, begins


def _count_runs(order: int):
    """Counts of all runs of order + 1 bytes, per language and Arrow batch."""

    def run(batches):
        for batch in batches:
            for piece in sized([batch], "text"):
                langs = np.array(piece.column(0).to_pylist(), dtype=object)
                data, offsets = utf8_buffers(piece.column(1))
                for lang in sorted(set(langs)):
                    mine = np.flatnonzero(langs == lang)
                    own = np.concatenate([data[offsets[k] : offsets[k + 1]] for k in mine])
                    ends = np.concatenate([[0], np.cumsum(np.diff(offsets)[mine])])
                    padded, begins = _padded(own, ends, order)
                    at = np.arange(len(own)) + np.repeat(begins - ends[:-1], np.diff(ends))
                    code = np.zeros(len(own), dtype=np.int64)
                    for k in range(order, -1, -1):
                        code = code * 256 + padded[at - k]
                    codes, counts = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))], ["lang", "code", "n"])

    return run


class Table:
    """Frozen code lengths of some languages.

    classes: byte -> class (0: a byte that no sample had). down[node, class]: the context one byte longer,
    0 if unknown. costs[node, class, language]: bits.
    """

    def __init__(self, order: int, classes: np.ndarray, down: np.ndarray, costs: np.ndarray):
        self.order, self.classes, self.down, self.costs = order, classes, down, costs

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row under each language, worked out in strips of STRIP bytes, so memory doesn't follow a row's length."""
        order, width, down, languages = self.order, self.down.shape[1], self.down.ravel(), self.costs.shape[2]
        flat, pad = self.costs.reshape(-1, languages), int(self.classes[_PAD])
        out = np.zeros((len(offsets) - 1, languages))
        sums = np.zeros((STRIP + 1, languages))
        for s in range(0, len(data), STRIP):
            e = min(s + STRIP, len(data))
            back = min(order, s)
            symbols = self.classes[np.concatenate([np.full(order - back, _PAD, dtype=np.uint8), data[s - back : e]])].astype(np.int64)
            rows = np.searchsorted(offsets, (s - order, e))
            begins = np.unique(offsets[rows[0] : rows[1]]) - s
            node, known = np.zeros(e - s, dtype=np.int64), np.ones(e - s, dtype=bool)
            for k in range(1, order + 1):
                before = symbols[order - k : order - k + e - s].copy()
                for j in range(k):  # the row's first k bytes look back before its begin
                    at = begins + j
                    before[at[(at >= 0) & (at < e - s)]] = pad
                longer = down[node * width + before]
                known &= longer > 0
                node = np.where(known, longer, node)
            np.cumsum(flat[node * width + symbols[order:]], axis=0, dtype=np.float64, out=sums[1 : e - s + 1])
            first, last = np.searchsorted(offsets, s, side="right") - 1, np.searchsorted(offsets, e)
            edges = np.clip(offsets[first : last + 1], s, e) - s
            out[first:last] += sums[edges[1:]] - sums[edges[:-1]]
        return out


class Model(NamedTuple):
    """languages, by name, and the tables that hold them one after the other."""

    languages: list[str]
    tables: list[Table]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.concatenate([t.bits(data, offsets) for t in self.tables], axis=1)


def build(rows: list[tuple[str, int, int]], order: int = ORDER, table_bytes: int = TABLE_BYTES) -> Model | None:
    """The model of counted runs (language, run of order + 1 bytes as a base-256 number, count)."""
    lang, code, count = zip(*rows) if rows else ((), (), ())
    return built(pa.array(lang, pa.string()), np.array(code, dtype=np.int64), np.array(count, dtype=np.int64), order, table_bytes)


def built(lang: pa.Array, code: np.ndarray, count: np.ndarray, order: int = ORDER, table_bytes: int = TABLE_BYTES) -> Model | None:
    """The model of counted runs, as columns. How languages fall to tables changes no code length."""
    if not len(code):
        return None
    coded = lang.dictionary_encode()
    names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    order_of = sorted(range(len(names)), key=names.__getitem__)
    tables, held, shared = [], [], None
    for k in order_of:
        mine = code[at == k]
        own = [np.unique((mine >> 8) & ((1 << 8 * d) - 1)) for d in range(order + 1)], np.unique([(mine >> 8 * d) & 255 for d in range(order + 1)])
        both = own if shared is None else ([np.union1d(x, y) for x, y in zip(shared[0], own[0])], np.union1d(shared[1], own[1]))
        if held and 4 * sum(map(len, both[0])) * (len(both[1]) + 1) * (len(held) + 1) > table_bytes:
            tables.append(_table(held, at, code, count, order))
            held, both = [], own
        held, shared = [*held, k], both
    tables.append(_table(held, at, code, count, order))
    return Model([names[k] for k in order_of], tables)


def _table(languages: list[int], at: np.ndarray, code: np.ndarray, count: np.ndarray, order: int) -> Table:
    """The table of some languages; at: the language of each run."""
    mine = np.isin(at, languages)
    lang, code, count = np.array([languages.index(k) for k in at[mine].tolist()]), code[mine], count[mine]
    digits = np.stack([(code >> (8 * k)) & 255 for k in range(order + 1)])  # the symbol, then its context, nearest first
    seen = np.unique(digits)
    classes = np.zeros(256, dtype=np.int32)
    classes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    digits = classes[digits].astype(np.int64)
    keys = []
    key = np.zeros(len(code), dtype=np.int64)
    for depth in range(order + 1):
        if depth:
            key = key * width + digits[depth]
        keys.append(np.unique(key))
    first = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    down = np.zeros((first[-1], width), dtype=np.int32)
    for depth in range(1, order + 1):
        if len(keys[depth]):
            parent = np.searchsorted(keys[depth - 1], keys[depth] // width) + first[depth - 1]
            down[parent, keys[depth] % width] = np.arange(first[depth], first[depth + 1])
    costs = np.zeros((first[-1], width, len(languages)), dtype=np.float32)
    for l in range(len(languages)):
        mine = lang == l
        above = None
        key = np.zeros(mine.sum(), dtype=np.int64)
        for depth in range(order + 1):
            if depth:
                key = key * width + digits[depth][mine]
            if not len(keys[depth]):
                break
            at = np.minimum(np.searchsorted(keys[depth], key), len(keys[depth]) - 1)
            ok = keys[depth][at] == key
            counts = np.bincount(at[ok] * width + digits[0][mine][ok], weights=count[mine][ok], minlength=len(keys[depth]) * width).reshape(-1, width)
            parent = np.searchsorted(keys[depth - 1], keys[depth] // width) if depth else None
            total = _code_lengths(counts, above, parent)
            costs[first[depth] : first[depth + 1], :, l] = total[0]
            above = (counts, *total)
    return Table(order, classes, down, costs)


def _code_lengths(counts: np.ndarray, above: tuple | None, parent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each symbol after each context of one length, and bits once the context's own symbols are excluded.

    above: (counts, bits, bits after exclusion) of the contexts one byte shorter; parent: which of them each one extends.
    """
    own = counts > 0
    total, kinds = counts.sum(1, keepdims=True), own.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        if above is None:  # below the empty context, all bytes that it hasn't seen are alike
            shorter = np.broadcast_to(np.log2(np.maximum(256 - kinds, 1)).astype(float), counts.shape)
        else:
            c, _, beyond = (x[parent] for x in above)
            left, rest = np.where(own, 0, c).sum(1, keepdims=True), ((c > 0) & ~own).sum(1, keepdims=True)
            escape = np.where(rest > 0, np.log2(left + rest) - np.log2(np.maximum(rest, 1)), 0.0)
            shorter = np.where((c > 0) & ~own, np.log2(left + rest) - np.log2(np.where(c > 0, c, 1)), escape + beyond)
        escape = np.where(kinds > 0, np.log2(total + kinds) - np.log2(np.maximum(kinds, 1)), 0.0)
        bits = np.where(own, np.log2(total + kinds) - np.log2(np.where(own, counts, 1)), escape + shorter)
    return bits, shorter


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Count runs over a sample of `rows`; None if no row has text and language, an error if there are over LANGUAGES languages.

    The driver receives one size per language and the counted runs of the sample, all of them.
    """
    known = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).limit(LANGUAGES + 1).collect()
    if not sizes:
        return None
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages; LANGUAGES bounds the model")
    part = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_bytes / max(1, r["n"])))])
    share = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(share < F.coalesce(part[F.col("lang")], F.lit(0.0))).select("lang", "text")
    counted = drawn.mapInArrow(_count_runs(order), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    runs = counted.toArrow()
    return built(runs.column("lang").combine_chunks(), runs.column("code").to_numpy(), runs.column("n").to_numpy(), order)


def _scored(model: Model | None, text: pa.Array, letters: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """Language, score and bits per byte of each text."""
    n = len(text)
    lang, score, rate = np.full(n, "und", dtype=object), np.zeros(n), [None] * n
    if model is not None and n:
        data, offsets = utf8_buffers(text)
        bits = model.bits(data, offsets)
        best = bits.argmin(1)
        share = 1 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1)
        for k in np.flatnonzero(letters.to_numpy(zero_copy_only=False).astype(bool)):
            lang[k], score[k] = model.languages[best[k]], share[k]
            rate[k] = bits[k, best[k]] / (offsets[k + 1] - offsets[k])
    return lang, score, rate


def _letters(text: str) -> Column:
    return F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))


def predict(rows: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred, score, bits_per_byte), one per row of `rows`, in one narrow pass over whole texts.

    score is the winner's share of the posterior under equal priors. A null text, one without a letter, and
    every text if there is no model, is `und` with score 0 and null bits. Equal code lengths go to the
    first language by name. Other columns are not read.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("key", rows.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]

    def run(batches):
        for batch in sized(batches, "text", 1 << 20):
            lang, score, rate = _scored(held.value, batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rate, pa.float64())], [f.name for f in fields])

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text"), _letters(text).alias("letters")).mapInArrow(run, T.StructType(fields)).withColumnRenamed("key", key)


_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[97:123] = True
_PLAIN[128:] = True


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of each row, A-Z as a-z, with a blank after each run of them.

    Words that hold a digit lose their ASCII letters (keys, hashes, addresses); bytes beyond ASCII always stay.
    """
    data = lowered(data)
    starts, stops, _ = word_spans(data, offsets)
    letter = _PLAIN[data]
    if len(starts):
        coded = np.logical_or.reduceat((data >= 48) & (data < 58), starts)  # gaps hold no digit
        edge = np.zeros(len(data) + 1, dtype=np.int8)
        edge[starts[coded]] += 1
        edge[stops[coded]] -= 1
        letter &= (np.cumsum(edge[:-1], dtype=np.int8) == 0) | (data >= 128)
    gap = np.zeros(len(data), dtype=bool)
    gap[1:] = letter[:-1] & ~letter[1:]
    gap[offsets[:-1][offsets[:-1] < len(data)]] = False
    take = letter | gap
    kept = [np.count_nonzero(take[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    data[~letter] = 0x20
    return data[take], np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])


def _foreign(model: Model, text: pa.Array, rate: float, margin: float) -> np.ndarray:
    """Texts whose n bytes of plain words take more than rate * n + margin * sqrt(n) bits in every language."""
    data, offsets = plain_words(*utf8_buffers(text))
    n = np.diff(offsets)
    return model.bits(data, offsets).min(1) > rate * n + margin * np.sqrt(n)


def keep_languages(rows: DataFrame, model: Model | None, most_excess: float, text: str = "text", plain: tuple[float, float] | None = None, fill: str | None = None) -> DataFrame:
    """The rows of `rows` whose text is in a learned language; a null in the text column `fill` becomes that language, all else stays.

    Rejected are texts that `predict` calls `und`; those that a flat code of 8 bits a byte describes in fewer
    bits than the best language by more than `most_excess`; and, with `plain` = (rate, margin), those whose plain
    words take more bits than the rate allows at their length (see _foreign), so that keys and numbers don't decide
    there. Without a model (nothing to learn from) only null texts and texts without a letter are rejected.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)
    flag = "letters of " + "".join(rows.columns)

    def run(batches):
        for batch in sized(batches, text, 1 << 20):
            ok = batch.column(batch.num_columns - 1)
            if held.value is not None:
                column = batch.column(batch.schema.get_field_index(text))
                (lang, _, rate), sizes = _scored(held.value, column, ok), np.diff(utf8_buffers(column)[1])
                if fill:
                    at = batch.schema.get_field_index(fill)
                    batch = batch.set_column(at, batch.schema.field(at), pc.coalesce(batch.column(at), pa.array(lang, batch.schema.field(at).type)))
                fits = np.array([r is not None and (r - 8) * n <= most_excess for r, n in zip(rate, sizes.tolist())], dtype=bool)
                ok = pa.array(fits & ~_foreign(held.value, column, *plain) if plain else fits)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(ok)

    return rows.withColumn(flag, _letters(text)).mapInArrow(run, rows.schema)


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    out = predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
