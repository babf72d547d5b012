"""Operator 5: size-partitioned MinHash containment search, in Spark expressions only.

Which documents hold at least a share t of a benchmark item's word shingles? An item's sketch is the
smallest part of its hash-ordered shingles (a bottom-k MinHash). Its depth follows from the item's size:
a document that holds need = ceil(t * m) of m shingles misses at most m - need, so it holds one of the
m - need + 1 smallest. With that depth no pair is lost, where banded signatures lose short items in long
documents. Sizes partition the search: items and documents fall into bands of doubling size, the band is part of
the join's key, and an item's sketch stands in the bands of the documents that are large enough for it. Candidates
are then verified by counting shared shingles as strings. Items of fewer words than a shingle are a partition by
their own length: what they are looked up among are the runs of so many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlake.llm.common import GAP_PATTERN, Scratch, table

SHINGLE, PERCENT = 5, 75
#: Sketch rows, bands counted, that are broadcast (32 bytes each); larger sketches meet the documents by a shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of a text in lower case; none for null or blank texts."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP_PATTERN, -1))


def _runs(w: Column, size: int, of) -> Column:
    """of(words of a run) for every run of `size` words; none if there are fewer."""
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: of([F.get(w, i + k) for k in range(size)]))
    return F.when(F.size(w) >= size, every)


def shingles(w: Column, size: int = SHINGLE) -> Column:
    """Distinct shingles of words as strings."""
    return F.coalesce(F.array_distinct(_runs(w, size, lambda run: F.concat_ws(" ", *run))), F.array().cast("array<string>"))


def hashes(w: Column, size: int = SHINGLE) -> Column:
    """A 64-bit hash for every shingle of words, repeats included."""
    return F.coalesce(_runs(w, size, lambda run: F.xxhash64(*run)), F.array().cast("array<long>"))


def _by_size(sizes: list[int], size: Column, of) -> Column:
    """of(k) for the k of `sizes` that a row's `size` names."""
    out = F.lit(None)
    for k in sizes:
        out = F.when(size == k, of(k)).otherwise(out)
    return out


def band(n: Column) -> Column:
    """The size band of n shingles: 1, 2 to 3, 4 to 7, ..."""
    return F.length(F.bin(n))


def find_leaks(docs: DataFrame, items: DataFrame, scratch: Scratch, percent: int = PERCENT, alone: int = 1) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_shared), one per pair of ids of which the document holds `percent` of the item.

    A shingle is SHINGLE words, or all words of an item that has fewer, which is searched for as a run of its own length. alone: items
    of fewer words than that are found only in documents that are nothing else. Texts without words and null texts have
    no shingle and match nothing. Rows without an id give no pair. Repeated ids: a pair stands if any of its rows does, with
    the largest count. Other columns are not read. Either table may be empty.
    """
    every = list(range(1, SHINGLE + 1))
    test = items.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w")).withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    test = test.select("item_id", "k", _by_size(every, F.col("k"), lambda k: shingles(F.col("w"), k)).alias("set"), F.array_distinct(_by_size(every, F.col("k"), lambda k: hashes(F.col("w"), k))).alias("h"))
    # filters stand behind stored tables and aggregates: pushed below the words, they would split a text again for every word
    stored = scratch.save(test.withColumn("item", F.xxhash64("item_id", "set")).dropDuplicates(["item"]), "items").where(F.size("set") > 0)
    sized = stored.withColumn("m", F.size("set")).withColumn("need", F.ceil(F.col("m") * F.lit(percent) / 100.0).cast("int"))
    depth = F.greatest(F.lit(1), F.size("h") - F.col("need") + 1)
    found = sized.agg(F.max(band(F.col("need"))), F.sort_array(F.collect_set("k"))).first()
    top, sizes = found[0] or 1, found[1] or [SHINGLE]  # all larger documents share the last band; sizes are SHINGLE and what shorter items have
    least = sized.select("item", "need", F.slice(F.sort_array("h"), F.lit(1), depth).alias("h"), F.explode(F.sequence(band(F.col("need")), F.lit(top))).alias("band"))
    sketch = scratch.save(least.select("band", "item", "need", F.explode("h").alias("h")), "sketch")
    small = sketch.count() <= BROADCAST_ROWS
    held = docs.where(F.col("doc_id").isNotNull()).select("doc_id", words(F.col("text")).alias("w"))
    # shorter items need one shingle, which any band may hold, so one number of shingles serves all sizes
    held = held.withColumn("n", F.greatest(F.lit(1), F.size("w") - SHINGLE + 1))
    every_hash = F.concat(*[hashes(F.col("w"), k) for k in sizes]) if len(sizes) > 1 else hashes(F.col("w"), sizes[0])
    probes = held.select("doc_id", "n", F.least(band(F.col("n")), F.lit(top)).alias("band"), F.explode(every_hash).alias("h"))
    met = probes.join(F.broadcast(sketch) if small else sketch, ["band", "h"]).where("n >= need")
    pairs = scratch.save(met.select("doc_id", "item").distinct(), "pairs")
    wanted = pairs.join(sized.select("item", "item_id", "k", "set", "m", "need"), "item")
    shared = F.size(F.array_intersect("set", _by_size(sizes, F.col("k"), lambda k: shingles(F.col("w"), k))))
    checked = (
        docs.select("doc_id", "text")
        .join(wanted, "doc_id")
        .withColumn("w", words(F.col("text")))
        .select("doc_id", "item_id", F.col("m").cast("long").alias("n_item"), "need", F.when((F.col("k") >= alone) | (F.size("w") == F.col("k")), shared).otherwise(0).cast("long").alias("n_shared"))
    )
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") - F.col("need")).alias("over"), "n_shared", "n_item")).alias("x"))
    return best.where("x.over >= 0").select("doc_id", "item_id", "x.n_item", "x.n_shared")


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "leaks"))


_SQL_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+')"
_SQL_SHINGLES = "unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))"
OP5_SQL = f"""
WITH iw AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark)), i AS (SELECT item_id, k, {_SQL_SHINGLES} AS s FROM iw WHERE k > 0),
d AS (SELECT doc_id, k, {_SQL_SHINGLES} AS s FROM (SELECT doc_id, {_SQL_WORDS} AS w FROM documents), (SELECT DISTINCT k FROM iw WHERE k > 0) WHERE len(w) >= k),
m AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM d JOIN i USING (s, k) JOIN m USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= 75 * n_item
"""
