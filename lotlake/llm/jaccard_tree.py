"""Operator 4: exact n-gram Jaccard join with signature trees, as one component per document.

1. Every text becomes its set of shingle hashes; of equal sets the smallest id stands for all.
2. Sets that share one of their LEADS least hashes make groups, each searched by a signature tree (see 3). Of the
   pairs that a tree leaves, the most promising ones that connect the group are verified, so that a group
   of near copies costs about a pair a member and not all pairs. What this round misses is found below.
3. Exact search: two sets that link share a token of their prefixes, the first n - ceil(0.75 n) + 1 tokens
   in one global order. Tokens whose documents are all in one component already are left out. The others
   make groups, and each group a signature tree: nodes hold the OR of their
   members' token bitmaps and their range of sizes, and a dual traversal drops node pairs whose largest
   possible overlap is too small, or that are in one component already. A group of over GROUP members has
   upper levels in a table, a row per block of members with its range of sizes and of components (a bitmap of
   so many is full): members are dealt to blocks by component, if it is a large one, or else by size, and only
   the pairs of blocks that those ranges leave become trees. This search runs twice. The first
   time it takes each set's most promising pair in a share of the groups and joins most of what belongs
   together, so that the second time, when it takes all pairs that are left in all groups, it meets few.
4. Pairs are verified on the texts' whole sets; components follow from the links.

The global order puts frequent tokens last. They are listed from a share of the documents, at most
HOT_LIST of them; which tokens are listed changes the work, never the result. Unlisted tokens meet in one
shuffle, sorted by token; listed ones are counted by an aggregate and joined, so that they can be split.
Tokens are 64-bit hashes of five words; two different shingles of one pair of documents would have to
agree in all 64 bits to be taken for one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlake.llm.common import Scratch, lowered, mixed, release, run_hashes, sized, table, utf8_buffers, word_hashes, word_spans
from lotlake.llm.graph import components

SHINGLE, PERCENT = 5, 75
#: Least hashes of a set that step 2 groups by.
LEADS = 3
#: Share of documents from which frequent tokens are listed, the documents that make a token frequent, and the longest list.
HOT_SHARE, HOT_DOCS, HOT_LIST = 32, 256, 200_000
#: Members of a tree; a larger group is cut into blocks of about as many, and pairs of blocks are searched.
GROUP = 256
#: Groups that a set is known by (see _search), and the share of groups that the first round searches.
FIRST, BEST_SHARE = 8, 8
#: What a round takes of the pairs that trees leave.
ALL, BEST, FOREST = "all", "best", "forest"
#: Members of a tree of the first round.
LEAD_GROUP = 64
#: Bits of a bitmap per token. Few shared bits by chance keep pairs with half their tokens in common from verification.
WIDE = 4
#: Members of a lowest node, and nodes under a node.
LEAF, FAN = 16, 4
CHUNK = 4 << 20
#: No gid, and pairs that are looked at at a time.
_NONE, _PAIRS = np.iinfo(np.int64).max, 1 << 14
#: Partners of a document that one block of _verify holds against it, on average.
PARTNERS = 256


def token_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct token hashes of each text; texts with fewer words than a shingle are one token."""
    data, offsets = utf8_buffers(column)
    data = lowered(data)
    starts, stops, first = word_spans(data, offsets)
    words = word_hashes(data, starts, stops)
    runs, before = run_hashes(words, first, shingle)
    out = []
    for k, n in enumerate(np.diff(first).tolist()):
        if 0 < n < shingle:
            token = np.zeros(1, dtype=np.uint64)
            for w in words[first[k] : first[k + 1]]:
                token = mixed((token * np.uint64(0x9E3779B97F4A7C15)) ^ w)
            out.append(mixed(token + np.uint64(n)))
        else:
            out.append(np.unique(runs[before[k] : before[k + 1]]))
    return out


def bitmap(tokens: np.ndarray) -> bytes:
    """One bit per token in the least power of two bits (64 at least) that is WIDE times the set."""
    bits = max(64, 1 << max(0, (WIDE * len(tokens) - 1)).bit_length())
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _describe(hot, percent: int, shingle: int):
    """Arrow function (doc_id, text) -> set size, 128-bit set digest, least tokens, prefix (unlisted and listed tokens) and bitmap."""

    def run(batches):
        listed = np.array(hot.value, dtype=np.uint64)
        for batch in sized(batches, "text", CHUNK):
            sets = token_sets(batch.column(1), shingle)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            prefixes, common = [], []
            for s in sets:
                take = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                last = listed[np.minimum(np.searchsorted(listed, s), len(listed) - 1)] == s if len(listed) else np.zeros(len(s), dtype=bool)
                prefixes.append(s[~last][:take])
                common.append(s[last][: take - len(prefixes[-1])])
            sums = [np.array([int(mixed(s ^ np.uint64(k)).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).view(np.int64) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), _lists([s[:LEADS] for s in sets]), _lists(prefixes), _lists(common), pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary())],
                ["doc_id", "n", "d1", "d2", "leads", "prefix", "common", "bits"],
            )

    return run


def _count_tokens(shingle: int):
    def run(batches):
        for batch in sized(batches, "text", CHUNK):
            sets = token_sets(batch.column(1), shingle)
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["token", "n"])

    return run


def frequent_tokens(docs: DataFrame, shingle: int, hot_docs: int) -> list[int]:
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("frequent")), F.lit(HOT_SHARE)) == 0)
    counted = part.mapInArrow(_count_tokens(shingle), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") * HOT_SHARE >= hot_docs).orderBy(F.desc("n"), "token").limit(HOT_LIST)
    return sorted(t & (2**64 - 1) for t in top.select("token").toArrow().column(0).to_pylist())


class _Tree:
    """Signature tree of a group whose members are in order of size: lowest nodes of LEAF members, FAN nodes under one.

    A node is a range of members. Its signature at a width (64-bit words) is the OR of its members' bitmaps
    folded to that width, with the most tokens that one member has beyond one per bit.
    """

    def __init__(self, n: np.ndarray, labels: np.ndarray, bitmaps: list[np.ndarray]):
        self.n, self.labels, self.bitmaps = n, labels, bitmaps
        self.widths = np.array([len(b) for b in bitmaps])  # grow with size
        self.folds: dict[int, tuple[int, np.ndarray]] = {}
        self.seen: dict[tuple[int, int, int], tuple[np.ndarray, int]] = {}

    def rows(self, lo: int, hi: int, width: int) -> np.ndarray:
        if width not in self.folds:
            start = int(np.searchsorted(self.widths, width))
            self.folds[width] = start, np.stack([folded(b, width) for b in self.bitmaps[start:]])
        start, all_rows = self.folds[width]
        return all_rows[lo - start : hi - start]

    def signature(self, lo: int, hi: int, width: int) -> tuple[np.ndarray, int]:
        if (lo, hi, width) not in self.seen:
            rows = self.rows(lo, hi, width)
            excess = int((self.n[lo:hi] - np.bitwise_count(rows).sum(1, dtype=np.int64)).max())
            self.seen[lo, hi, width] = np.bitwise_or.reduce(rows), excess
        return self.seen[lo, hi, width]

    def parts(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The nodes under a node; none for a lowest one."""
        if hi - lo <= LEAF:
            return []
        step = LEAF
        while step * FAN < hi - lo:
            step *= FAN
        return [(k, min(k + step, hi)) for k in range(lo, hi, step)]

    def apart(self, x: tuple[int, int], y: tuple[int, int], percent: int) -> bool:
        """No member of node x can link with one of y, or all are in one component."""
        least, most = (self.n[x[0]], self.n[y[0]]), (self.n[x[1] - 1], self.n[y[1] - 1])
        if 100 * most[0] < percent * least[1] or 100 * most[1] < percent * least[0]:
            return True
        label = self.labels[x[0]]
        if (self.labels[x[0] : x[1]] == label).all() and (self.labels[y[0] : y[1]] == label).all():
            return True
        width = int(min(self.widths[x[0]], self.widths[y[0]]))
        (a, more_a), (b, more_b) = self.signature(*x, width), self.signature(*y, width)
        overlap = int(np.bitwise_count(a & b).sum()) + min(more_a, more_b)
        return overlap * (100 + percent) < percent * int(least[0] + least[1])

    def pairs(self, x: tuple[int, int], y: tuple[int, int], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members of two lowest nodes that may link, with the most that they can share: tokens whose bit the other lacks can't be."""
        width = int(min(self.widths[x[0]], self.widths[y[0]]))
        a, b = self.rows(*x, width)[:, None], self.rows(*y, width)[None]
        na, nb = self.n[x[0] : x[1], None], self.n[None, y[0] : y[1]]
        both = a & b
        most = np.minimum(na - np.bitwise_count(a ^ both).sum(2, dtype=np.int64), nb - np.bitwise_count(b ^ both).sum(2, dtype=np.int64))
        i, j = np.nonzero((most * (100 + percent) >= percent * (na + nb)) & (self.labels[x[0] : x[1], None] != self.labels[None, y[0] : y[1]]))
        share = (most / (na + nb))[i, j]
        i, j = i + x[0], j + y[0]
        ok = i < j if x == y else slice(None)
        return i[ok], j[ok], share[ok]


def _forest(a: np.ndarray, b: np.ndarray, share: np.ndarray, size: int) -> np.ndarray:
    """Of pairs over `size` members those that join what more promising ones haven't joined: fewer than members, and they connect what all connect."""
    root, kept = list(range(size)), []
    for k in np.argsort(-share, kind="stable").tolist():
        x, y = int(a[k]), int(b[k])
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def candidates(n: np.ndarray, labels: np.ndarray, bitmaps: list[bytes], percent: int = PERCENT, mode: str = ALL) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a group that may link and aren't in one component; in mode ALL no pair that links is missing.

    Modes for rounds before that: BEST has each member's most promising pair only, FOREST the most promising pairs that
    connect all that may link.
    """
    order = np.argsort(n, kind="stable")
    sizes = n[order]
    cuts = np.flatnonzero(100 * sizes[:-1] < percent * sizes[1:]) + 1  # nothing links over such a gap
    one, two, share = [], [], []
    for part in np.split(order, cuts):
        if len(part) < 2 or (labels[part] == labels[part[0]]).all():
            continue
        tree = _Tree(n[part], labels[part], [np.frombuffer(bitmaps[k], dtype=np.uint64) for k in part])
        stack = [((0, len(part)), (0, len(part)))]
        while stack:
            x, y = stack.pop()
            if tree.apart(x, y, percent):
                continue
            under_x, under_y = tree.parts(*x), tree.parts(*y)
            if not under_x and not under_y:
                i, j, most = tree.pairs(x, y, percent)
                one.append(part[i])
                two.append(part[j])
                share.append(most)
            elif x == y:
                stack += [(p, q) for a, p in enumerate(under_x) for q in under_x[a:]]
            elif not under_y or (under_x and x[1] - x[0] >= y[1] - y[0]):
                stack += [(p, y) for p in under_x]
            else:
                stack += [(x, q) for q in under_y]
    if not one:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = np.concatenate(one), np.concatenate(two)
    if mode == FOREST and len(a):
        kept = _forest(a, b, np.concatenate(share), len(n))
        a, b = a[kept], b[kept]
    elif mode == BEST and len(a):
        order = np.argsort(-np.concatenate(share), kind="stable")
        ends = np.stack([a[order], b[order]], axis=1).ravel()
        first = np.unique(ends, return_index=True)[1] // 2
        kept = order[np.unique(first)]
        a, b = a[kept], b[kept]
    return a, b


def _open(group: int):
    """Arrow function over (token, rep, label) sorted by token: the members of the tokens that hold two components or more.

    A token of up to `group` members gives rows (gid, rep), where tokens with the same members have the same gid; a larger
    one (token, rep, label). The rows of a token are held until it ends.
    """

    def run(batches):
        for whole in _groups(batches, 1):
            token, rep, label = (whole.column(k).to_numpy() for k in range(3))
            edges = _edges([token])
            sizes = np.diff(edges)
            many = np.maximum.reduceat(label, edges[:-1]) > np.minimum.reduceat(label, edges[:-1])
            sums = np.add.reduceat(mixed(rep.view(np.uint64)), edges[:-1])
            gid = mixed(sums + sizes.astype(np.uint64)).view(np.int64)
            keep, big = np.repeat(many, sizes), np.repeat(sizes > group, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(gid, sizes)[keep], mask=big[keep]), pa.array(token[keep]), pa.array(rep[keep]), pa.array(label[keep])], ["gid", "token", "rep", "label"]
            )

    return run


def _groups(batches, keys: int):
    """Tables of whole groups from batches sorted by the first `keys` columns; what is not ended yet is held."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        cols = [held.column(k).to_numpy() for k in range(keys)]
        edge = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
        if len(edge):
            at = int(edge[-1]) + 1
            yield held.slice(0, at).combine_chunks()
            held = held.slice(at)
    if held is not None:
        yield held.combine_chunks()


def _edges(columns: list[np.ndarray]) -> np.ndarray:
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(columns[0])]])


def _search(percent: int, mode: str):
    """Arrow function over (gid, rep, n, label, bits, first) sorted by gid: candidate pairs.

    first (mode ALL): the smallest gids of the set's groups. If two sets have one in common there, the least of those is
    the least group that holds both, and only that group gives the pair.
    """

    def run(batches):
        for whole in _groups(batches, 1):
            gid, rep, n, label = (whole.column(k).to_numpy() for k in range(4))
            bits = whole.column(4).to_pylist()
            first = np.full((len(gid), FIRST), _NONE)
            lists = whole.column(5).combine_chunks()
            first[np.arange(FIRST) < lists.value_lengths().to_numpy()[:, None]] = lists.flatten().to_numpy()
            a, b = [], []
            edges = _edges([gid]).tolist()
            for s, e in zip(edges[:-1], edges[1:]):
                i, j = candidates(n[s:e], label[s:e], bits[s:e], percent, mode)
                for c in range(0, len(i), _PAIRS):
                    x, y = i[c : c + _PAIRS] + s, j[c : c + _PAIRS] + s
                    if mode == ALL:
                        shared = np.where(first[x][:, :, None] == first[y][:, None, :], first[x][:, :, None], _NONE).min((1, 2))
                        own = (shared == gid[s]) | (shared == _NONE)
                        x, y = x[own], y[own]
                    a.append(rep[x])
                    b.append(rep[y])
            none = [np.zeros(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or none)), pa.array(np.concatenate(b or none))], ["a", "b"])

    return run


def _verify(percent: int, shingle: int):
    """Arrow function over (a, salt, side, doc, text) sorted by the first three: links between side 0 and side 1.

    Side 0 is the document `a`: the sets of its rows are held while its partners pass, a piece of a batch at a time.
    """

    def run(batches):
        key, leads = None, []
        for batch in sized(batches, "text", CHUNK):
            a, salt, side, doc = (batch.column(k).to_pylist() for k in range(4))
            sets = token_sets(batch.column(4), shingle)
            one, two = [], []
            for k, y in enumerate(sets):
                if (a[k], salt[k]) != key:
                    key, leads = (a[k], salt[k]), []
                if not side[k]:
                    leads.append(y)
                    continue
                for x in leads:
                    if 100 * len(x) < percent * len(y) or 100 * len(y) < percent * len(x):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both) and both:
                        one.append(a[k])
                        two.append(doc[k])
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["u", "v"])

    return run


def _dealt(pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (a, b, salt): the partners of one `a` in blocks of about PARTNERS. `pairs` is read twice.

    What is broadcast is a row per `a` of more than PARTNERS partners.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).alias("salts")).where("salts > 1")
    many = F.broadcast(scratch.save(many, f"{name}salts"))
    return pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1).cast("long"))).alias("salt"))


def verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole texts link, as (u, v). A hot document should be the `a` of its pairs."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = _dealt(scratch.save(pairs, f"{name}pairs"), scratch, name)
    left = salted.select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("doc")).distinct()
    sides = left.unionByName(salted.select("a", "salt", F.lit(1).alias("side"), F.col("b").alias("doc")))
    # by a shuffle at every size: what is joined grows with the documents
    met = sides.hint("merge").join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").select("a", "salt", "side", "doc", "text")
    blocks = met.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "side")
    found = scratch.save(blocks.mapInArrow(_verify(percent, shingle), "u long, v long").distinct(), f"{name}links")
    scratch.drop(f"{name}pairs", f"{name}salts")
    return found


def _lead_groups(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (gid, rep): sets that share one of their least hashes, in groups of about LEAD_GROUP.

    A hash that more sets have is several groups, by a hash of the set; its first and last set are in each of them, so that
    groups of near copies hang together.
    """
    shown = reps.select("rep", F.explode("leads").alias("token"))
    held = shown.groupBy("token").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.ceil(F.count("*") / F.lit(LEAD_GROUP)).alias("parts")).where("first < last")
    held = scratch.save(held, "held")
    part = F.pmod(F.xxhash64("rep", F.lit("lead")), F.col("parts"))
    members = shown.join(held.select("token", "parts"), "token").select("token", part.alias("part"), "rep")
    ends = held.where("parts > 1").select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "first", "last")
    ends = ends.select("token", "part", F.explode(F.array("first", "last")).alias("rep"))
    return members.unionByName(ends).select(F.xxhash64("token", "part").alias("gid"), "rep").distinct()


def _labels(small: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (rep, label): the component of every set under the links so far."""
    found = components(links, scratch).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    found = scratch.save(small.select("rep").join(found, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label")), name)
    scratch.drop("roots", "least")
    return found


def _blocks(members: DataFrame, small: DataFrame, scratch: Scratch, percent: int, group: int) -> DataFrame:
    """Rows (gid, rep): the members (token, rep, label) of large groups, once for each pair of blocks that may hold a link."""
    sized_members = scratch.save(members.join(small.select("rep", "n"), "rep").select("token", "rep", "label", "n"), "large")
    # sets that link are in one band of sizes or in neighbouring ones
    band = F.floor(F.log("n") / F.lit(np.log(100 / percent)) + 1e-9).cast("int")
    own = scratch.save(sized_members.groupBy("token", "label").agg(F.count("*").alias("c")).where(F.col("c") >= group // 2), "own")
    dealt = sized_members.join(own, ["token", "label"], "left").withColumn("band", F.when(F.col("c").isNull(), band))
    mixed_bands = dealt.where("c IS NULL").groupBy("token", "band").agg(F.count("*").alias("m"))
    mixed_bands = scratch.save(mixed_bands, "bands")
    dealt = dealt.join(mixed_bands, ["token", "band"], "left")
    part = F.pmod(F.xxhash64("rep", F.lit("block")), F.ceil(F.coalesce("c", "m") / F.lit(group)).cast("long"))
    dealt = scratch.save(dealt.select("token", "rep", "label", "n", F.xxhash64(F.when(F.col("c").isNotNull(), F.col("label")), "band", part).alias("block")), "dealt")
    ranges = dealt.groupBy("token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    ranges = scratch.save(ranges, "ranges")
    x, y = (ranges.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("block", "low", "high", "lo", "hi")]) for k in "xy")
    near = (100 * F.col("highx") >= percent * F.col("lowy")) & (100 * F.col("highy") >= percent * F.col("lowx"))
    one = (F.col("lox") == F.col("hix")) & (F.col("loy") == F.col("hiy")) & (F.col("lox") == F.col("loy"))
    pairs = x.join(y, "token").where((F.col("blockx") <= F.col("blocky")) & near & ~one)
    pairs = pairs.select("token", F.xxhash64("token", "blockx", "blocky").alias("gid"), F.explode(F.array_distinct(F.array("blockx", "blocky"))).alias("block"))
    pairs = scratch.save(pairs, "blockpairs")
    return dealt.join(pairs, ["token", "block"]).select("gid", "rep")


def jaccard_components(docs: DataFrame, scratch: Scratch, percent: int = PERCENT, shingle: int = SHINGLE, group: int = GROUP, hot_docs: int = HOT_DOCS) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of `docs` (doc_id long, text).

    These are the components of the join and not its links: pairs that are in one component already aren't verified.

    Words are split by blanks and the controls from tab to carriage return, A-Z in lower case. Null texts
    and texts without words have no shingle and link with nothing, so their component is their own id.
    Rows that share a doc_id are one node: what links one links all. Rows without doc_id have a size and
    no component. Other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known = docs.where(F.col("doc_id").isNotNull())
    hot = spark.sparkContext.broadcast(frequent_tokens(known, shingle, hot_docs))
    sets = scratch.save(
        docs.mapInArrow(_describe(hot, percent, shingle), "doc_id long, n long, d1 long, d2 long, leads array<long>, prefix array<long>, common array<long>, bits binary"), "sets"
    )
    full = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = full.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n", "leads", "prefix", "common", "bits")).alias("x"))
    reps = scratch.save(reps.select("d1", "d2", F.col("x.doc_id").alias("rep"), "x.n", "x.leads", "x.prefix", "x.common", "x.bits"), "reps")
    heads = scratch.save(sets.select("doc_id", "n", "d1", "d2"), "heads")
    ids = scratch.save(reps.select("d1", "d2", "rep"), "ids")
    small = scratch.save(reps.select("rep", "n", "bits"), "small")
    scratch.drop("sets")
    release(spark)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def searched(members: DataFrame, mode: str, name: str) -> DataFrame:
        """The candidate pairs (a, b) of trees over members (gid, rep, label, first)."""
        rows = members.join(small, "rep").select("gid", "rep", "n", "label", "bits", "first").repartition(parts, "gid").sortWithinPartitions("gid")
        pairs = rows.mapInArrow(_search(percent, mode), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
        return scratch.save(pairs.distinct(), name)

    leads = _lead_groups(reps, scratch).select("gid", "rep", F.col("rep").alias("label"), F.array().cast("array<long>").alias("first"))
    near = verified(searched(leads, FOREST, "leads"), known, scratch, "near", percent, shingle)
    scratch.drop("held", "leads")
    release(spark)

    known_links = near
    labels = _labels(small, known_links, scratch, "labels0")
    tokens = lambda column: reps.select("rep", column).join(labels, "rep").select(F.explode(column).alias("token"), "rep", "label")
    members = tokens("prefix").repartition(parts, "token").sortWithinPartitions("token").mapInArrow(_open(group), "gid long, token long, rep long, label long")
    members = scratch.save(members, "members")
    common = scratch.save(tokens("common"), "common")
    open_tokens = scratch.save(common.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token"), "open")
    large = members.where("gid IS NULL").select("token", "rep", "label").unionByName(common.join(open_tokens, "token").select("token", "rep", "label"))
    groups = members.where("gid IS NOT NULL").select("gid", "rep").unionByName(_blocks(large, small, scratch, percent, group))
    groups = scratch.save(groups.distinct(), "groups")
    scratch.drop("reps", "members", "common", "open", "large", "own", "bands", "dealt", "ranges", "blockpairs")
    release(spark)
    first = scratch.save(groups.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("gid")), 1, FIRST).alias("first")), "first")
    for name, mode in (("best", BEST), ("rest", ALL)):
        part = groups.where(F.pmod("gid", F.lit(BEST_SHARE)) == 0) if mode == BEST else groups
        labelled = part.join(labels, "rep")
        live = scratch.save(labelled.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gid"), f"{name}live")
        pairs = searched(labelled.join(live, "gid").join(first, "rep").select("gid", "rep", "label", "first"), mode, f"{name}found")
        del labelled
        release(spark)
        known_links = known_links.unionByName(verified(pairs, known, scratch, name, percent, shingle))
        scratch.drop(f"{name}live", f"{name}found")
        if mode == BEST:
            labels = _labels(small, known_links, scratch, "labels1")
        release(spark)
    scratch.drop("groups", "first", "small", "labels0", "labels1")

    whole = components(known_links, scratch).select(F.col("node").alias("rep"), "component")
    classes = ids.join(whole, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    classes = scratch.save(classes, "classes")
    out = heads.join(classes, ["d1", "d2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def op4_jaccard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), Scratch(spark, "jaccard"))


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w
), ids AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS rep FROM sets),
one AS (SELECT doc_id AS a, len(s) AS n, unnest(s) AS x FROM sets JOIN ids USING (doc_id) WHERE rep = doc_id),
l AS (
  SELECT p.a AS a, q.a AS b FROM one p JOIN one q USING (x) WHERE p.a <> q.a GROUP BY p.a, q.a, p.n, q.n
  HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), r AS (SELECT a, b AS c FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.c)
SELECT i.doc_id, CAST(i.n AS BIGINT) AS n_shingles, least(i.rep, coalesce(c, i.rep)) AS component_id
FROM ids i LEFT JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = i.rep
"""
