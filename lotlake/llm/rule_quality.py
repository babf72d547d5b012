"""Operator 12: text quality by a sparse ensemble of rules.

Every text becomes a row of statistics (STATISTICS), Spark expressions over the whole text. Trees are grown on the
labelled rows; every path from a root to a node is a rule, a conjunction of bounds on statistics. A logistic
regression with a lasso penalty gives the rules weights and drops most of them, and what is left is compiled into
one Spark column: the score is a sum of weights behind a logistic function, with no Python on the way.

Both fits run on Spark over all labelled rows. The driver sees trees, rules and weights, whose number TREES and
DEPTH bound.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlake.llm.common import GAP_PATTERN, Scratch, table

#: Trees and their depth, cuts that are tried per statistic, rows that a node holds at least.
TREES, DEPTH, CUTS, NODE_ROWS = 24, 3, 64, 4
#: Weight of the lasso penalty, and its iterations at most.
LASSO, STEPS = 0.001, 100
#: Score from which a text counts as good.
THRESHOLD = 0.3
SEED = 12


def _kept(text: Column, but: str) -> Column:
    """Characters of a text that are in a class, given as the class of all others."""
    return F.length(F.regexp_replace(text, but, "")).cast("double")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows (*keep, STATISTICS as doubles), one per row of `docs`; a null text counts as empty, whose statistics are all 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("text_of"))
    t = F.col("text_of")
    words = F.filter(F.split(t, GAP_PATTERN), lambda w: w != "")
    rows = rows.select(*keep, "text_of", words.alias("words_of"), F.filter(F.split(t, "\n"), lambda x: x != "").alias("lines_of"))
    rows = rows.select(
        *keep,
        F.length("text_of").cast("double").alias("chars"),
        F.size("words_of").cast("double").alias("words"),
        F.size(F.array_distinct("words_of")).cast("double").alias("kinds"),
        F.size("lines_of").cast("double").alias("lines"),
        F.size(F.array_distinct("lines_of")).cast("double").alias("line_kinds"),
        F.coalesce(F.array_max(F.transform("words_of", lambda w: F.length(w))), F.lit(0)).cast("double").alias("longest"),
        # words that repeat the one before
        F.size(F.filter(F.arrays_zip(F.col("words_of").alias("a"), F.slice("words_of", 2, F.greatest(F.size("words_of"), F.lit(1))).alias("b")), lambda p: p["a"] == p["b"])).cast("double").alias("again"),
        F.size(F.filter("words_of", lambda w: ~w.rlike(r"\p{L}"))).cast("double").alias("bare"),
        _kept(F.col("text_of"), r"[^\p{L}]+").alias("letters"),
        _kept(F.col("text_of"), r"[^\p{Lu}]+").alias("capitals"),
        _kept(F.col("text_of"), r"[^0-9]+").alias("digits"),
        _kept(F.col("text_of"), r"[^.,;:]+").alias("stops"),
        _kept(F.col("text_of"), r"[^!?]+").alias("cries"),
        _kept(F.col("text_of"), r"[^#$%&*+/<=>@\\^_`{|}~\[\]]+").alias("signs"),
    )
    c = F.col
    return rows.select(
        *keep,
        "chars",
        "words",
        "lines",
        "longest",
        _share(c("chars"), c("words")).alias("word_length"),
        _share(c("kinds"), c("words")).alias("kind_share"),
        _share(c("again"), c("words")).alias("again_share"),
        _share(c("bare"), c("words")).alias("bare_share"),
        _share(c("line_kinds"), c("lines")).alias("line_kind_share"),
        _share(c("words"), c("lines")).alias("line_words"),
        _share(c("letters"), c("chars")).alias("letter_share"),
        _share(c("capitals"), c("letters")).alias("capital_share"),
        _share(c("digits"), c("chars")).alias("digit_share"),
        _share(c("stops"), c("words")).alias("stop_rate"),
        _share(c("cries"), c("words")).alias("cry_rate"),
        _share(c("signs"), c("words")).alias("sign_rate"),
    )


STATISTICS = ["chars", "words", "lines", "longest", "word_length", "kind_share", "again_share", "bare_share", "line_kind_share", "line_words", "letter_share", "capital_share", "digit_share", "stop_rate", "cry_rate", "sign_rate"]

#: A rule: (statistic, lower bound, upper bound), lower < value <= upper, in the statistics' order; None for no bound.
Rule = tuple[tuple[str, float | None, float | None], ...]


class Ensemble(NamedTuple):
    """Rules with their weights, and what a text scores that meets none (before the logistic function)."""

    rules: list[tuple[Rule, float]]
    intercept: float

    def column(self) -> Column:
        """The score, 0 to 1, over a row of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, low, high in rule:
        out = out if low is None else out & (F.col(name) > low)
        out = out if high is None else out & (F.col(name) <= high)
    return out


def paths(node, bounds: dict[int, tuple[float | None, float | None]]) -> list[Rule]:
    """A rule for every node under a tree's node; bounds on one statistic are drawn together."""
    if node.subtreeDepth() == 0:
        return []
    split, out = node.split(), []
    at, cut = split.featureIndex(), split.threshold()
    low, high = bounds.get(at, (None, None))
    for child, new in ((node.leftChild(), (low, cut if high is None else min(high, cut))), (node.rightChild(), (cut if low is None else max(low, cut), high))):
        inside = bounds | {at: new}
        out.append(tuple((STATISTICS[k], *inside[k]) for k in sorted(inside)))
        out += paths(child, inside)
    return out


def learnt(key: Column) -> Column:
    """Whether labels may be learnt from a row; a row without key has no label."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 != 0, F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, scratch: Scratch, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Ensemble:
    """Fit on the rows of `stats` (doc_id, STATISTICS) that `labels` (doc_id, quality) has a label for.

    Null labels and ids count for nothing. Labels that repeat an id count as one, 1 if at least half are. Without
    both labels there are no rules, and every text scores the share of 1 among the labels, one of each added.
    """
    # a row per id, so that no id multiplies; only statistics meet labels, texts don't move
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    rows = stats.join(known, "doc_id").select("doc_id", "label", array_to_vector(F.array(*STATISTICS)).alias("seen"), *STATISTICS)
    rows = scratch.save(rows.orderBy("doc_id"), "labelled")
    ones, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if ones in (0, n):
        return Ensemble([], float(_logit((ones + 1) / (n + 2))))
    forest = RandomForestClassifier(featuresCol="seen", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=CUTS, minInstancesPerNode=NODE_ROWS, featureSubsetStrategy="onethird", seed=SEED).fit(rows)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree._call_java("rootNode"), {})}, key=repr)
    if not rules:
        return Ensemble([], float(_logit((ones + 1) / (n + 2))))
    met = scratch.save(rows.select("label", F.array(*[holds(r).cast("double") for r in rules]).alias("met")), "met").select("label", array_to_vector("met").alias("met"))
    line = LogisticRegression(featuresCol="met", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=STEPS, standardization=False).fit(met)
    scratch.drop("labelled", "met")
    weights = line.coefficients.toArray().tolist()
    return Ensemble([(r, w) for r, w in zip(rules, weights) if w], float(line.intercept))


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def score_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per row of `docs` (doc_id, text).

    Texts are read once: statistics are stored, the fit joins them with the labels of rows that aren't held out, and
    the compiled rules score them. Null and blank texts are scored by their statistics like others, rows without
    id too (never held out). Other columns are not read; empty tables are fine.
    """
    stats = scratch.save(statistics(docs.select("doc_id", "text"), "doc_id"), "statistics")
    model = fit(stats.where(learnt(F.col("doc_id"))), labels.where(learnt(F.col("doc_id"))), scratch)
    out = stats.select("doc_id", (~learnt(F.col("doc_id"))).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op12_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "quality"))
