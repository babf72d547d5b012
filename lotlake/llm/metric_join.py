"""Operator 7: exact metric range join of embeddings.

Vectors are scaled to length one, so cosine >= c is a distance of at most r = sqrt(2 - 2c). Pivots are drawn
from the vectors; a vector's home is the cell of its nearest pivot. A cell is cut into blocks of about BLOCK
vectors, each stored as one row, with its least and largest distance to every pivot. By the triangle inequality two
vectors are apart by the difference of their distances to any pivot, and vectors of different cells p and q by their distances
from the plane halfway between p and q, which for x is (d(x, q)^2 - d(x, p)^2) / (2 d(p, q)). Pairs of blocks for which one of these
bounds, less what rounding may add, is over r are left out, and of the others the single vectors for which it is.

No vector is copied: tasks read the stored blocks, some against some, so disk is linear in the vectors. How many pairs of
blocks are compared depends on the data: where vectors spread in all of many dimensions, no bound of this kind
drops much, and work comes to all pairs once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlake.llm.common import BATCH_BYTES, Scratch, table
from lotlake.llm.graph import components

COSINE = 0.9
#: Vectors of a cell on average, and of a block; bytes of a block, for wide vectors.
CELL, BLOCK, BLOCK_BYTES = 4_096, 8_192, 8 << 20
#: Pivots at most: they are broadcast, with 8 bytes a component.
PIVOTS = 1_024
#: Rows of a block that are compared at a time, and bytes of vectors that are compared in double precision.
_STRIP, _EXACT_BYTES = 512, 16 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths[0]) if len(lengths) else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _unit(raw: np.ndarray, top: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return raw.astype(np.float64) / top[:, None] / norm[:, None]


def _units(batch) -> np.ndarray:
    """Vectors of length one of a batch or table (raw, top, norm)."""
    raw, top, norm = (batch.column(c) for c in ("raw", "top", "norm"))
    return _unit(_matrix(raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw), top.to_numpy(), norm.to_numpy())


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ p.T), 0))


def _noise(width: int) -> float:
    """More than squared distances of scaled vectors are off by rounding: in lengths, in products and in their sums."""
    return 4 * (width + 8) * float(np.finfo(np.float64).eps)


def _between(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of pivots. Near or equal ones: rounding must not decide, so none is taken for less than it is."""
    return np.sqrt(np.maximum(2 - 2 * (p @ q.T), 0) + _noise(p.shape[1]))


def scaled(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, width, raw array, top double, norm double) of the usable vectors; raw / top / norm has length one.

    Null vectors, those with null or non-finite components, empty and zero vectors are left out. The scale is
    taken in two steps so that very large and very small components neither overflow nor vanish. raw stays float if
    the column is, which is half of what doubles take.
    """
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    raw = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("raw")).where(F.col("vec_id").isNotNull() & F.col("raw").isNotNull())
    fine = raw.where(~F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    top = fine.withColumn("top", F.array_max(F.transform("raw", lambda x: F.abs(x.cast("double"))))).where("top > 0")
    even = lambda x: x.cast("double") / F.col("top")
    return top.select("vec_id", F.size("raw").alias("width"), "raw", "top", F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + even(x) * even(x))).alias("norm"))


def _nearest(pivots):
    """Arrow function (raw, top, norm, other columns) -> (home, the same columns)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                home = _distances(_units(batch), pivots.value).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *batch.columns], ["home", *batch.schema.names])

    return run


_PACKED = ["ids", "raw", "top", "norm"]
_BLOCK_ROW = "block int, home int, ids binary, raw binary, top binary, norm binary, low array<double>, high array<double>, gap array<double>"


def _pack(pivots):
    """Grouped function: the vectors of a block as one row. low, high: distances to each pivot. gap: least distance from the plane between it and the home."""

    def run(rows: pa.Table) -> pa.Table:
        p, home = pivots.value, rows.column("home")[0].as_py()
        x, between = _units(rows), _between(p[[home]], p)
        low, high, gap = np.full(len(p), np.inf), np.zeros(len(p)), np.full(len(p), np.inf)
        for s in range(0, len(x), _STRIP):
            d = _distances(x[s : s + _STRIP], p)
            low, high = np.minimum(low, d.min(0)), np.maximum(high, d.max(0))
            gap = np.minimum(gap, ((d * d - d[:, [home]] ** 2 - 4 * _noise(p.shape[1])) / (2 * between)).min(0))
        packed = [rows.column("vec_id").to_numpy(), _matrix(rows.column("raw").combine_chunks()), rows.column("top").to_numpy(), rows.column("norm").to_numpy()]
        return pa.table(
            [rows.column("block").slice(0, 1), rows.column("home").slice(0, 1), *[pa.array([np.ascontiguousarray(c).tobytes()]) for c in packed], *[pa.array([c.tolist()], pa.list_(pa.float64())) for c in (low, high, gap)]],
            names=[c.split()[0] for c in _BLOCK_ROW.split(", ")],
        )

    return run


def _unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Bring linked positions under one label in place. A label is its own; only such are hooked, so earlier links stay."""
    while True:
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels != (up := labels[labels])).any():
            labels[:] = up


def _links_between(x: np.ndarray, y: np.ndarray, cosine: float):
    """Pairs of rows (i, j) of x and y within the cosine, by strips. Single precision finds; double precision decides what it leaves open."""
    width = x.shape[1]
    slack = 1e-4 + (width + 8) * float(np.finfo(np.float32).eps)
    single, most = y.astype(np.float32).T, max(1, _EXACT_BYTES // (8 * max(1, width)))
    for s in range(0, len(x), _STRIP):
        rough = x[s : s + _STRIP].astype(np.float32) @ single
        i, j = np.nonzero(rough >= cosine - slack)
        if len(i):
            ok = rough[i, j] >= cosine + slack
            i += s
            for c in range(0, len(open_ := np.flatnonzero(~ok)), most):
                at = open_[c : c + most]
                ok[at] = np.einsum("ij,ij->i", x[i[at]], y[j[at]]) >= cosine
            yield i[ok], j[ok]


def _join(pivots, kind: str, cosine: float, most: float):
    """Arrow function over pairs of blocks: of what a task has seen, link counts, and links that connect what it connects."""

    def run(batches):
        p, at, held = pivots.value, {}, (None, None)
        ids, labels, counts = (np.zeros(0, dtype=np.int64) for _ in range(3))

        def vectors(row, side):
            own, raw, top, norm = (np.frombuffer(row[f"{side}_{c}"].as_buffer(), dtype) for c, dtype in zip(_PACKED, (np.int64, kind, np.float64, np.float64)))
            return own, _unit(raw.reshape(len(own), -1), top, norm)

        def near(x, row, side, other):
            """Rows of x that may be within reach of the other block, by its distances to its own pivot and by the plane between both."""
            own, pivot = p[row[f"{side}_home"].as_py()], p[row[f"{other}_home"].as_py()]
            low, high, gap = (row[f"{other}_{c}"].as_py() for c in ("low", "high", "gap"))
            d = _distances(x, np.stack([pivot, own]))
            plane = (d[:, 0] ** 2 - d[:, 1] ** 2 - 4 * _noise(len(own))) / (2 * _between(own[None], pivot[None])[0, 0]) + gap
            return np.flatnonzero((d[:, 0] - high <= most) & (low - d[:, 0] <= most) & ((plane <= most) | (row["a_home"].as_py() == row["b_home"].as_py())))

        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(c)[k] for c, name in enumerate(batch.schema.names)}
                a, b = row["a_block"].as_py(), row["b_block"].as_py()
                if held[0] != a:
                    held = a, vectors(row, "a")
                xi, x = held[1]
                yi, y = held[1] if a == b else vectors(row, "b")
                for block, own in ((a, xi), (b, yi)):
                    if block not in at:
                        at[block] = len(ids)
                        ids, labels, counts = np.concatenate([ids, own]), np.concatenate([labels, np.arange(len(ids), len(ids) + len(own))]), np.concatenate([counts, np.zeros(len(own), dtype=np.int64)])
                xs, ys = (np.arange(len(xi)),) * 2 if a == b else (near(x, row, "a", "b"), near(y, row, "b", "a"))
                for i, j in _links_between(x[xs], y[ys], cosine) if len(xs) and len(ys) else ():
                    i, j = xs[i], ys[j]
                    other = xi[i] != yi[j]
                    i, j = i[other], j[other]
                    counts[at[a] : at[a] + len(xi)] += np.bincount(i, minlength=len(xi))
                    if a != b:
                        counts[at[b] : at[b] + len(yi)] += np.bincount(j, minlength=len(yi))
                    _unite(labels, i + at[a], j + at[b])
        joined, some = np.flatnonzero(labels != np.arange(len(ids))), np.flatnonzero(counts)
        for u, v, n in ((ids[joined], ids[labels[joined]], np.zeros(len(joined), dtype=np.int64)), (ids[some], ids[some], counts[some])):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], ["u", "v", "n"])

    return run


def near_vectors(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of `vectors` (vec_id long, embedding array of numbers).

    n_links counts the rows of other ids within the cosine; rows that repeat a vec_id add up their counts and
    don't link with each other. Vectors that are null, zero, empty or hold a null or non-finite component
    link with nothing, as rows without vec_id, whose component is null. Vectors only link with those of
    their own width. Other columns are not read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # a row here is a pair of blocks
    unit = scaled(vectors)
    links = None
    for width, n in sorted((r["width"], r["n"]) for r in unit.groupBy("width").agg(F.count("*").alias("n")).collect()):
        found = _links(unit.where(F.col("width") == width).drop("width"), n, scratch, cosine, cell, max(1, min(block, BLOCK_BYTES // (8 * width))))
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = spark.createDataFrame([], "u long, v long, n long")
    counts = links.where("n > 0").groupBy("u").agg(F.sum("n").alias("n_links")).withColumnRenamed("u", "vec_id")
    parts = components(links.where("n = 0").select("u", "v"), scratch).withColumnRenamed("node", "vec_id")
    out = vectors.select("vec_id").join(counts, "vec_id", "left").join(parts, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(unit: DataFrame, n: int, scratch: Scratch, cosine: float, cell: int, block: int) -> DataFrame:
    """Rows (u, v, 0) that connect components, and (u, u, count) of links that a task found for a vector."""
    spark = unit.sparkSession
    wanted = max(1, min(PIVOTS, -(-n // cell)))
    drawn = unit.orderBy(F.xxhash64("vec_id", F.lit("pivot"))).limit(wanted).toArrow()  # at most PIVOTS rows
    pivots = spark.sparkContext.broadcast(np.unique(_units(drawn), axis=0))  # equal vectors are one pivot
    # homes are worked out twice, once to be counted, which takes less than to store the vectors with them
    homes = unit.mapInArrow(_nearest(pivots), f"home int, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in unit.schema)}")
    sizes = homes.groupBy("home").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("subs")).orderBy("home").collect()  # at most PIVOTS rows
    first = np.cumsum([0, *[r["subs"] for r in sizes]]).tolist()
    cells = spark.createDataFrame([(r["home"], r["subs"], at) for r, at in zip(sizes, first)], "home int, subs int, first int")
    number = F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("subs").cast("long")).cast("int")
    dealt = homes.join(F.broadcast(cells), "home").withColumn("block", number).drop("first", "subs")
    blocks = scratch.save(dealt.groupBy("block").applyInArrow(_pack(pivots), _BLOCK_ROW), "blocks")

    most = float(np.sqrt(2 - 2 * cosine) + 8 * np.sqrt(_noise(pivots.value.shape[1])))  # a distance near zero is off by the root
    a, b = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "ab")
    # each pair of blocks in one of its two orders, in turn, so that all tasks have as many
    once = (F.col("a_block") == F.col("b_block")) | ((F.col("a_block") < F.col("b_block")) == ((F.col("a_block") + F.col("b_block")) % 2 == 1))
    apart = lambda low, high: F.array_max(F.zip_with(low, high, lambda x, y: x - y)) > most
    planes = F.get("a_gap", F.col("b_home")) + F.get("b_gap", F.col("a_home"))
    far = apart("a_low", "b_high") | apart("b_low", "a_high") | ((F.col("a_home") != F.col("b_home")) & (planes > most))
    pairs = a.hint("shuffle_replicate_nl").join(b, once & ~far)
    own = [F.get(f"{x}_{c}", F.col(f"{y}_home")).alias(f"{x}_{c}") for x, y, c in [("a", "a", "low"), ("a", "a", "high"), ("a", "b", "gap"), ("b", "b", "low"), ("b", "b", "high"), ("b", "a", "gap")]]
    whole = [f"{side}_{c}" for side in "ab" for c in ("block", "home", *_PACKED)]
    kind = "f4" if unit.schema["raw"].dataType.elementType.typeName() == "float" else "f8"
    return scratch.save(pairs.select(*whole, *own).mapInArrow(_join(pivots, kind, cosine, most), "u long, v long, n long"), "joined")


def op7_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Scratch(spark, "vectors"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (SELECT vec_id, e FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a, b AS c FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.c)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = e.vec_id
"""
