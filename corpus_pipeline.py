"""The corpus pipeline: five stages over `documents`, each written as Parquet and reread by the next.

Every stage works on all that the one before has kept, and returns the columns of `documents`; the last
returns a row of token digests per document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlake.llm import bpe_automaton, decontamination, jaccard_tree, ppm_language, substring_dedup
from lotlake.llm.common import Scratch, table

#: Bits by which a flat code may beat the best learned language before a text counts as in none of them.
MOST_EXCESS = 1_000.0
#: Bits a byte that plain words may take in the best learned language, and the margin over sqrt(bytes). On sf0.1 texts in
#: the learned languages take at most 4.6 from 100 bytes on; sentences of 170 to 180 bytes in other ones 8.2 and more.
PLAIN = 6.5, 12.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts that no learned language explains; a row without language gets the one found."""
    known = docs.where(F.col("doc_id").isNotNull() & ~ppm_language.held_out(F.col("doc_id")))
    return ppm_language.keep_languages(docs, ppm_language.fit(known), MOST_EXCESS, plain=PLAIN, fill="lang")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the document with the smallest id."""
    found = jaccard_tree.jaccard_components(docs, Scratch(spark, "jaccard"))
    return docs.join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more that also stand in a document with a smaller id."""
    return substring_dedup.rewrite_documents(docs, Scratch(spark, "substrings"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold three quarters of a benchmark item. Items of under five words stand in clean texts too: they count where they are all of a text."""
    leaks = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "leaks"), alone=decontamination.SHINGLE)
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of the texts that are left."""
    return bpe_automaton.digests(docs, bpe_automaton.word_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring),
    ("decontaminate", decontaminate),
    ("bpe", encode),
]

#: SQL can't express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])  # read for the last time
    return STAGES[-1][1](spark, docs, sf_dir)
