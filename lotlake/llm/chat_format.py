"""Operator 3: relational chat formatting, in Spark expressions only.

The turns of a conversation are collected as structs, sorted, merged into runs of one role, and each run
becomes one block of the output:

    <s>ROLE[INST]TEXT[SEP]TEXT ...[/INST]</s>

ROLE is URL-encoded. Inside a text, a control string gets a backslash after its first character, and one
that already has some there gets one more, so that no text holds a control string and reading back
removes exactly what was added. The loss mask is a list of spans of the output, in code points: one for
each text of the trained role, in order. Where a span starts is a running sum over the turns, taken by a window
before they are collected, so work is linear in the length of a conversation.

A conversation is one output row, so one task holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotlake.llm.common import hex_sha256, table

OPEN, BODY, BETWEEN, END = "<s>", "[INST]", "[SEP]", "[/INST]</s>"
#: A control string with any number of backslashes after its first character.
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|SEP\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]|SEP\]))"
#: Code points of a piece of output that a span is looked up in.
PIECE = 1_024
_BLOCK = r"(?s)<s>([^\[<]*)\[INST\](.*?)\[/INST\]</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """Rows (conv, formatted string, loss_spans array<struct<start, size>>), one per conversation.

    Turns go by (turn, role, text), nulls first, so ties and repeated rows have a defined place and all
    stay. A null text or role is empty; rows with a null conversation form one conversation. Other
    columns are not read, whatever their names; an empty table gives an empty one.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("at"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy("at", "role", "text")
    head = lambda role: F.concat(F.lit(OPEN), F.url_encode(role), F.lit(BODY))
    placed = rows.select(
        "conv",
        F.row_number().over(order).alias("place"),
        "role",
        F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True)).alias("opens"),
        F.coalesce(F.lead("role").over(order) != F.col("role"), F.lit(True)).alias("closes"),
        escaped(F.col("text")).alias("text"),
    )
    lead = F.when(F.col("opens"), F.length(head(F.col("role")))).otherwise(len(BETWEEN))
    tail = F.when(F.col("closes"), len(END)).otherwise(0)
    sized = placed.select("*", F.length("text").alias("size"), tail.alias("tail"), (lead + F.length("text") + tail).alias("all"))
    upto = F.sum("all").over(Window.partitionBy("conv").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spanned = sized.select("conv", F.struct("place", "role", "opens", "text", (upto - F.col("size") - F.col("tail")).alias("start"), "size").alias("turn"))
    sorted_turns = spanned.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    starts = sorted_turns.withColumn("starts", F.transform(F.filter("turns", lambda t: t["opens"]), lambda t: t["place"]))
    merged = F.transform(
        "starts",
        lambda at, k: F.concat(
            head(F.get("turns", at - 1)["role"]),
            F.array_join(F.transform(F.slice("turns", at, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - at), lambda t: t["text"]), BETWEEN),
            F.lit(END),
        ),
    )
    spans = F.transform(F.filter("turns", lambda t: t["role"] == trained), lambda t: F.struct(t["start"].alias("start"), t["size"].alias("size")))
    return starts.select(F.col("conv").alias(conv), F.array_join(merged, "").alias("formatted"), spans.alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns of an output as array<struct<role, text>>: the exact inverse of the format."""
    return F.flatten(
        F.zip_with(
            F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(1)),
            F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(2)),
            lambda role, body: F.transform(F.split(body, r"\[SEP\]", -1), lambda x: F.struct(F.url_decode(role).alias("role"), unescaped(x).alias("text"))),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between. The output is cut into pieces once; a span looks at its own pieces only."""

    def under(pieces: Column) -> Column:
        def one(s: Column) -> Column:
            first = F.floor(s["start"] / PIECE).cast("int")
            last = F.floor((s["start"] + F.greatest(s["size"], F.lit(1)) - 1) / PIECE).cast("int")
            return unescaped(F.substr(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), s["start"] - first * PIECE + 1, s["size"]))

        return F.array_join(F.transform(spans, one), "")

    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.get(F.transform(F.array(pieces), under), F.lit(0))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.sql(
        """SELECT CAST(-7 AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, '</s>[INST] ok [/INST]' text
        FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"""
    )
    columns = ["conv_id", "turn", "role", "text"]
    out = format_conversations(table(spark, sf_dir, "conversations").select(columns).unionByName(tricky))
    read = out.withColumns({"turns": parsed(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hex_sha256(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        hex_sha256(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|SEP\]))', '\1\\\2\3', 'g') AS held,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM all_turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(held) + CASE WHEN before = role THEN 5 ELSE 20 + length(url_encode(role)) END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
