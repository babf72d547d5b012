"""Whitening, rule ensembles and ball-tree search against brute force, held-out labels and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlake.llm import ball_search, rule_quality, whitening
from lotlake.llm.common import Scratch
from tests.llm.test_operators import CLASHES, TEXTS, frame
from tests.oracle import DATA


@pytest.fixture()
def scratch(spark):
    return Scratch(spark, "test")


# whitening


def plain_whitening(rows, k=4):
    """{vec_id: [(n, deviation, |whitened| by component)]} by an eigensolver."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], dtype=np.float64) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    out = []
    for i, x in kept:
        d = [n * c - s for c, s in zip(x, sums)]
        out.append((i, n, sum(c * c for c in d), np.abs(np.array(d) / n @ vectors[:, order] / np.sqrt(values[order]))))
    return out, values[order] / values.sum()


def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want, explained = plain_whitening(rows)
    got = whitening.op11_cholesky_whitening(spark, DATA)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    found = {(r["vec_id"], r["component"]): r for r in got.collect()}
    assert len(found) == 4 * len(rows) == 4 * len(want)
    for i, n, deviation, whitened in want:
        for c in range(4):
            r = found[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation) and abs(abs(r["whitened"]) - whitened[c]) < 1e-9
            assert abs(r["explained"] / explained[c] - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit(v).alias(k) for k, v in CLASHES.items()])


def test_whitening_edges(spark, scratch):
    rng = random.Random(3)
    own = [(k, [rng.uniform(-1, 1) for _ in range(3)]) for k in range(40)]
    odd = [(100, None), (101, [1.0, None, 0.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, [])]
    again = [(0, own[0][1]), (None, own[1][1]), (7, own[2][1])]
    got = whitening.whiten(vectors(spark, own + odd + again + [(200, [1.0, 2.0]), (201, [1.0, 2.0])]), scratch).collect()
    want, _ = plain_whitening(own + odd[:4] + again, 3)
    assert sorted((str(r["vec_id"]), r["component"], int(r["deviation"])) for r in got) == sorted((str(i), c, d) for i, _, d, _ in want for c in (1, 2, 3))
    assert {r["n"] for r in got} == {40}  # copies count once; the two equal vectors of width 2 have no component
    assert whitening.whiten(vectors(spark, []), scratch).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])]), scratch).collect() == []
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [(1, [1e30])]), scratch).collect()


@pytest.mark.parametrize("kind", ["constant", "dependent", "few", "steep"])
def test_whitening_of_hard_lists(spark, scratch, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 6))
    if kind == "constant":
        x[:, 2] = 0.5
    elif kind == "dependent":
        x = np.floor(256 * x) / 256
        x[:, 5] = x[:, 0] + x[:, 1]
    elif kind == "few":
        x = x[:3]
    else:
        x *= 10.0 ** np.array([5, 4, 3, 2, 1, 0])
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch).collect()
    want, explained = plain_whitening(rows)
    keep = 2 if kind == "few" else 4
    assert {r["component"] for r in got} == set(range(1, keep + 1)) and max(r["identity_error"] for r in got) < 1e-9
    by = {(r["vec_id"], r["component"]): r for r in got}
    for i, _, deviation, whitened in want:
        for c in range(keep):
            assert int(by[i, c + 1]["deviation"]) == deviation and abs(abs(by[i, c + 1]["whitened"]) - whitened[c]) < 1e-6
            assert abs(by[i, c + 1]["explained"] / explained[c] - 1) < 1e-6


def test_deviations_are_exact():
    x = np.array([[2**40, -(2**40), 3], [1, 2, 3]])
    d = whitening.deviations(x, 1000, x.sum(0))
    assert [int(v.as_py()) for v in whitening.square_sums(d)] == [sum(int(c) ** 2 for c in row) for row in d.tolist()]
    with pytest.raises(OverflowError):
        whitening.deviations(np.array([[2**50]]), 2**20, np.array([0]))


def test_triangular_solves():
    rng = np.random.default_rng(5)
    a, r = rng.standard_normal((50, 8)), np.triu(rng.standard_normal((8, 8))) + 4 * np.eye(8)
    assert np.allclose(whitening.solved(a, [r]), a @ np.linalg.inv(r), atol=1e-12)


# quality


def plain_statistics(text):
    t = text or ""
    words = [w for w in re.split("[ \t-\r]+", t) if w]
    lines = [x for x in t.split("\n") if x]
    share = lambda a, b: a / b if b else 0.0
    kept = lambda pattern: len(re.findall(pattern, t))
    letters, capitals = sum(c.isalpha() for c in t), sum(c.isupper() for c in t)
    return {
        "chars": len(t), "words": len(words), "lines": len(lines), "longest": max(map(len, words), default=0), "word_length": share(len(t), len(words)), "kind_share": share(len(set(words)), len(words)),
        "again_share": share(sum(a == b for a, b in zip(words, words[1:])), len(words)), "bare_share": share(sum(not any(c.isalpha() for c in w) for w in words), len(words)), "line_kind_share": share(len(set(lines)), len(lines)),
        "line_words": share(len(words), len(lines)), "letter_share": share(letters, len(t)), "capital_share": share(capitals, letters), "digit_share": share(kept("[0-9]"), len(t)), "stop_rate": share(kept("[.,;:]"), len(words)),
        "cry_rate": share(kept("[!?]"), len(words)), "sign_rate": share(kept(r"[#$%&*+/<=>@\\^_`{|}~\[\]]"), len(words)),
    }


def test_statistics(spark):
    texts = [t for _, t in TEXTS] + ["A A a\n\nA A a\n| x ## [y] \\ 12", "Ä ÖÜ! x?\ty\x0bz", "   ", "a\na\nb b b"]
    rows = rule_quality.statistics(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k").collect()
    assert rule_quality.STATISTICS == list(plain_statistics(""))
    for r in rows:
        want = plain_statistics(texts[r["k"]])
        for name in rule_quality.STATISTICS:
            assert abs(r[name] - want[name]) < 1e-9, (name, texts[r["k"]])


def test_quality_query(spark, tmp_path):
    """Held-out labels are met, and don't matter; the compiled column scores as the rules say."""
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in rule_quality.op12_rule_quality(spark, DATA.replace("0.001", "0.01")).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for k, r in got.items())
    held = [(truth[k], r["predicted"]) for k, r in got.items() if r["held_out"] and k in truth]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.97 * len(held)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = rule_quality.score_documents(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), turned, Scratch(spark, "again"))
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {k: r["score"] for k, r in got.items()}


def test_rules_compile(spark, scratch):
    stats = rule_quality.statistics(frame(spark, TEXTS), "doc_id")
    model = rule_quality.Ensemble([((("chars", 3.0, 80.0), ("kind_share", None, 0.9)), 2.0), ((("lines", 0.0, None),), -1.5)], 0.25)
    for r in stats.withColumn("score", model.column()).collect():
        total = 0.25 + 2.0 * (3 < r["chars"] <= 80 and r["kind_share"] <= 0.9) - 1.5 * (r["lines"] > 0)
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-12


def test_quality_edges(spark, scratch):
    docs = frame(spark, TEXTS)
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int").withColumn("label", F.lit(9))
    odd = [(None, 1), (1, None), (999, 0)]
    got = rule_quality.score_documents(docs, label(odd + [(k, int(k < 6)) for k in (1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10)]), scratch).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    same = {}
    for r, (k, text) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(TEXTS, key=lambda r: (r[0] is None, r[0]))):
        assert r["doc_id"] == k and same.setdefault(text or "", r["score"]) == r["score"]  # equal texts score alike, null as empty
    for rows, share in (([], 0.5), ([(1, 1), (2, 1), (3, 1)], None), (odd, 0.5)):
        seen = {r["score"] for r in rule_quality.score_documents(docs, label(rows), scratch).collect()}
        n = sum(q is not None and k is not None and k < 900 and zlib.crc32(str(k).encode()) % 5 != 0 for k, q in rows)
        n += sum(k == 2 and zlib.crc32(b"2") % 5 != 0 for k, _ in rows)  # two rows have the id 2
        assert len(seen) == 1 and abs(seen.pop() - (share or (n + 1) / (n + 2))) < 1e-12
    assert rule_quality.score_documents(frame(spark, []), label([(1, 1)]), scratch).collect() == []


# search


def plain_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top=10):
    held = [(k, Counter(t)) for k, t in ((k, plain_terms(t)) for k, t in docs) if t]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for k, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if c[t])
            if score > 0:
                found.append((-score, k is None, k or 0))
        out += [(item, rank, None if none else k, -s) for rank, (s, none, k) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def ranked(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, scratch, monkeypatch, small):
    """small: slices, groups, leaves and matrices so small that all of them are cut."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)] + ["é", "Straße", "日本", "a1", "X"]
    draw = lambda n: rng.choice([" ", "-", ", ", "\x00"]).join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(n))
    docs = [(k, draw(rng.choice([1, 5, 30, 120]))) for k in range(300)]
    docs += [(1000 + k, docs[k % 3][1]) for k in range(60)] + TEXTS + [(None, docs[0][1]), (5, docs[0][1]), (12, "--- !!"), (13, "x" * 100_000)]
    items = [(k, draw(rng.randint(1, 25))) for k in range(40)] + [(40, None), (41, ""), (42, "?!"), (43, "nowhere"), (44, docs[0][1]), (44, docs[0][1].upper()), (None, "w1 w2"), (45, " ".join(words) + " " + LONG_ITEM)]
    if small:
        for name, value in (("SLICE_TERMS", 120), ("ITEMS", 3), ("BLOCK", 50), ("CELLS", 300), ("LEAF", 2), ("AHEAD", 3)):
            monkeypatch.setattr(ball_search, name, value)
    got = ranked(ball_search.rank_documents(frame(spark, docs), frame(spark, items, "item_id long, text string"), scratch))
    assert got == plain_search(docs, items)


LONG_ITEM = " ".join(f"term{k}" for k in range(5_000))


def test_search_edges(spark, scratch):
    none, some = frame(spark, []), frame(spark, TEXTS)
    items = lambda rows: frame(spark, rows, "item_id long, text string")
    assert ranked(ball_search.rank_documents(none, items([(1, "a b")]), scratch)) == []
    assert ranked(ball_search.rank_documents(some, items([]), scratch)) == []
    assert ranked(ball_search.rank_documents(some, items([(1, None), (2, " .")]), scratch)) == []
    got = ball_search.op13_ball_search(spark, DATA)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_bounds_hold_and_prune():
    """No bound is under a score, and documents of other items' terms are hardly scored."""
    rng = np.random.default_rng(7)
    rows = np.concatenate([np.floor(1e10 * rng.random((400, 40)) * (rng.random((400, 40)) < 0.2) * (np.arange(40) // 10 == c)) for c in range(4)])
    sets = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(30)]
    group = ball_search.group_of(list(range(30)), sets)
    assert sorted(group.terms) == list(np.unique(np.concatenate(sets))) and all(sorted(group.terms[p]) == s.tolist() for p, s in zip(group.places, sets))
    tree = ball_search.Tree(rows[:, group.terms], group)
    assert sorted(tree.order) == list(range(len(rows)))
    bounds = tree.bounds()
    for node, (lo, hi) in enumerate(tree.spans):
        for k, p in enumerate(group.places):
            assert bounds[node, k] >= tree.rows[lo:hi][:, p].sum(1).max()
    group = ball_search.group_of([0, 1, 2, 3], [np.append(np.arange(10 * c, 10 * c + 10), [40, 41]) for c in range(4)])
    rows = np.append(rows, np.floor(1e8 * rng.random((1600, 2))), axis=1)[:, group.terms]
    best = ball_search.Best(np.zeros(4, dtype=np.int64))
    scored = ball_search.search(rows, np.arange(len(rows)), group, best)
    for k, p in enumerate(group.places):
        want = sorted((-int(s), i) for i, s in enumerate(rows[:, p].sum(1)))[:10]
        assert list(zip(-best.held[k][0], best.held[k][1])) == want
    assert scored < 0.6 * 4 * len(rows)
    same = ball_search.Tree(np.tile(rows[:1], (5_000, 1)), group)
    assert len(same.spans) == 1 and same.radii.max() < 1e-3 * rows[0].max()  # copies are one ball
