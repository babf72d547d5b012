"""Operator 6: rendezvous hashing of record keys over weighted shards, in Spark expressions only.

A record goes to the shard whose draw -ln(u) / weight is least, u being a uniform number from the MD5 of
key and shard, which other engines work out alike. A further shard only adds one draw per record, so records move into it and nowhere
else; about its share of all weight moves. The law held is `key`: key and shard count decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlake.llm.common import Scratch, table
from lotlake.operators.numbering import numbered

SHARDS = 24


def draw(key: list[Column], shard: Column, weight: Column) -> Column:
    """The record's draw for a shard; the least one wins. u comes from the first 52 bits of MD5(key parts and shard, with | between)."""
    parts = [F.coalesce(k.cast("string"), F.lit("null")) for k in key]
    bits = F.conv(F.left(F.md5(F.concat_ws("|", *parts, shard.cast("string"))), F.lit(13)), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / 2.0**52) / weight


def assign(rows: DataFrame, key: list[str], weights: list[float], grown_weight: float | None = None) -> DataFrame:
    """`rows` with `shard` (0 .. len(weights) - 1) and `grown_shard`, the shard if one of grown_weight joined.

    No shuffle. Shards of weight 0 take nothing; at least one weight must be positive. Equal draws go to
    the smaller shard. Null keys hash as the text null, so equal keys, nulls too, share a shard. An empty
    table gives an empty one. grown_shard is null where no grown_weight is given.
    """
    if not any(w > 0 for w in weights) or any(w < 0 or not math.isfinite(w) for w in weights):
        raise ValueError("weights must be finite, not negative, and one positive")
    columns = [F.col(k) for k in key]
    open_shards = F.array(*[F.struct(F.lit(k).alias("shard"), F.lit(float(w)).alias("weight")) for k, w in enumerate(weights) if w > 0])
    best = F.array_min(F.transform(open_shards, lambda s: F.struct(draw(columns, s["shard"], s["weight"]).alias("draw"), s["shard"].alias("shard"))))
    out = rows.withColumn("_best", best)
    grown = F.lit(None).cast("int")
    if grown_weight:
        new = F.lit(len(weights))
        grown = F.when(draw(columns, new, F.lit(float(grown_weight))) < F.col("_best.draw"), new).otherwise(F.col("_best.shard"))
    return out.withColumns({"shard": F.col("_best.shard"), "grown_shard": grown}).drop("_best")


def shard_documents(docs: DataFrame, scratch: Scratch, weights: list[float], grown_weight: float | None = 1.0) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per row of `docs`.

    size: UTF-8 bytes of the text plus 8. A null text counts as empty and has the CRC 0. slot counts 0, 1, 2 ... in each
    shard, by doc_id, CRC and size; rows are numbered by ranges, so no task holds a shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    dealt = scratch.save(assign(rows, ["doc_id"], weights, grown_weight), "dealt")
    # rows that tie in all that is shown spread over ranges by the last column
    tied = dealt.withColumn("tie", F.monotonically_increasing_id())
    placed = numbered(tied, ["doc_id", "text_crc32", "size", "tie"], scratch.path("ranges"), ["shard"])
    return placed.withColumn("slot", F.col("place") - 1).drop("place", "tie")


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), Scratch(spark, "shards"), [1.0] * SHARDS)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def _sql_draw(shard: str) -> str:
    return f"-ln((CAST(CAST('0x' || left(md5(doc_id || '|' || {shard}), 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)"


#: CRC-32 (reflected polynomial edb88320) byte by byte, from its table.
OP6_SQL = f"""
WITH tab AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t
), bytes AS (
  SELECT doc_id, list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS b FROM documents
), crc AS (
  SELECT doc_id, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM bytes, tab
), d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, list_transform(range(0, 24), lambda s: {_sql_draw('s')}) AS draws, {_sql_draw('24')} AS new FROM documents
), p AS (SELECT *, CAST(list_position(draws, list_min(draws)) - 1 AS INTEGER) AS shard FROM d)
SELECT doc_id, size, shard, 'key' AS law, CASE WHEN new < list_min(draws) THEN 24 ELSE shard END AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, text_crc32 FROM p JOIN crc USING (doc_id)
"""
