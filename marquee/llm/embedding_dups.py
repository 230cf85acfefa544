"""Embedding near-duplicates by int8 quantised tile products.

Equal vectors are one class. Each class's unit vector x is held as s*q with int8 codes q,
once, and e = |x - s*q| is known. Classes are dealt by hash into tiles of bounded size;
every pair of tiles is one row, of codes, scales and errors, so tasks are alike whatever
the groups in the data. From x.y - (s q).(s' q') = x.(y - s' q') + (x - s q).(s' q')
follows |error| <= e' + e * (1 + e'). A pair whose quantised product is further than that
from the threshold is settled by it. For the others the tile pair names the vectors in
them; those alone are fetched in full precision, per tile pair, and their open pairs are
computed in double precision.

Code products are whole numbers: slices of 1024 dimensions stay below 2^24, which 32-bit
floats hold exactly, and slices are added in 64 bits. Bounds are compared with MARGIN to
spare, more than their own rounding.

A tile pair returns a row for each vector with links there: how many, and one edge of a
spanning forest of the links. So nothing that leaves a task grows with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import components, forest, named_by_id, settle, table

TILE = 16_384  # vectors of a tile at most, in expectation half of it
TILE_NUMBERS = 1 << 23  # numbers of a tile at most
LEVELS = 127
SLICE = 1024
BLOCK = 1 << 21  # products held at once
MARGIN = 1e-9


def units(x: np.ndarray) -> np.ndarray:
    """Unit rows; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and error norms of unit rows."""
    scale = np.abs(x).max(axis=1, keepdims=True) / LEVELS
    code = np.rint(x / scale).astype(np.int8)
    error = np.linalg.norm(x - scale * code, axis=1)
    return code, scale[:, 0], error * (1 + 1e-9) + 1e-12


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    out = np.zeros((len(x), len(y)))
    for at in range(0, x.shape[1], SLICE):
        out += x[:, at:at + SLICE].astype(np.float32) @ y[:, at:at + SLICE].astype(np.float32).T
    return out


def judged(x, y, threshold: float, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, linked, open) of blocks of rows of x against y, each (codes, scales, errors); of a tile with itself each pair once."""
    (qx, sx, ex), (qy, sy, ey) = x, y
    step = max(1, BLOCK // max(1, len(qy)))
    for at in range(0, len(qx), step):
        rows = slice(at, at + step)
        value = products(qx[rows], qy) * (sx[rows, None] * sy[None, :])
        bound = ey[None, :] + ex[rows, None] * (1 + ey[None, :])
        linked = value - bound >= threshold + MARGIN
        open_ = (value + bound >= threshold - MARGIN) & ~linked
        if same:
            later = np.arange(len(qy))[None, :] > np.arange(at, at + len(value))[:, None]
            linked &= later
            open_ &= later
        yield at, linked, open_


class Links:
    """Counts of links and their spanning forest over the vectors of a pair of tiles."""

    def __init__(self, nodes: list[np.ndarray], weights: list[np.ndarray], same: bool):
        self.node, self.weight = (nodes[0], weights[0]) if same else map(np.concatenate, (nodes, weights))
        self.shift = 0 if same else len(nodes[0])
        self.count = np.zeros(len(self.node), np.int64)
        self.root = np.arange(len(self.node))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        b = b + self.shift
        self.count += np.bincount(a, self.weight[b], len(self.count)).astype(np.int64)
        self.count += np.bincount(b, self.weight[a], len(self.count)).astype(np.int64)
        # roots seen so far take part, so that the forest holds all links added
        self.root = forest(len(self.node), [(np.arange(len(self.node)), self.root), (a, b)])

    def rows(self) -> list[pa.Array]:
        at = np.flatnonzero(self.count)
        return [pa.array(self.node[at]), pa.array(self.node[self.root[at]]), pa.array(self.count[at])]


def quantised(classes: DataFrame) -> DataFrame:
    """(node, weight, dim, code, scale, error) of classes (node, weight, v)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                values = b.column(2)
                lengths = np.asarray(values.value_lengths())
                flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                starts = np.concatenate([[0], np.cumsum(lengths)])
                for dim in np.unique(lengths).tolist():
                    rows = np.flatnonzero(lengths == dim)
                    code, scale, error = quantise(units(flat[starts[rows][:, None] + np.arange(dim)]))
                    picked = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(picked), b.column(1).take(picked), pa.array(np.full(len(rows), dim, np.int32)), pa.array([c.tobytes() for c in code], pa.binary()),
                         pa.array(scale), pa.array(error)], names=["node", "weight", "dim", "code", "scale", "error"])

    return classes.select("node", "weight", "v").mapInArrow(run, "node long, weight long, dim int, code binary, scale double, error double")


def tile_links(pairs: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, other, links) of settled links, and (node, side, tile, tile2) of vectors in open pairs, from rows (tile, tile2, x, y)."""
    names = ["node", "other", "links", "side", "tile", "tile2"]

    def codes(held):
        node, weight, code, scale, error = (held.field(k) for k in range(5))
        q = np.frombuffer(b"".join(code.to_pylist()), np.int8).reshape(len(node), -1)
        return node.to_numpy(), weight.to_numpy(), (q, scale.to_numpy(), error.to_numpy())

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                tile, tile2 = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                same = tile == tile2
                i, wi, x = codes(b.column(2)[r].values)
                j, wj, y = (i, wi, x) if same else codes(b.column(3)[r].values)
                links = Links([i, j], [wi, wj], same)
                wanted = [np.zeros(len(i), bool), np.zeros(len(j), bool)]
                for at, linked, open_ in judged(x, y, threshold, same):
                    a, c = np.nonzero(linked)
                    if len(a):
                        links.add(a + at, c)
                    wanted[0][at:at + len(open_)] |= open_.any(axis=1)
                    wanted[1] |= open_.any(axis=0)
                if same:
                    wanted = [wanted[0] | wanted[1]]
                node, other, count = links.rows()
                empty = pa.nulls(len(node), pa.int64())
                yield pa.RecordBatch.from_arrays([node, other, count, empty, empty, empty], names=names)
                for side, (ids, w) in enumerate(zip((i, j), wanted)):
                    n = int(w.sum())
                    nothing = pa.nulls(n, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[w]), nothing, nothing, *(pa.array(np.full(n, v, np.int64)) for v in (side, tile, tile2))], names=names)

    return pairs.select("tile", "tile2", "x", "y").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def exact_links(pairs: DataFrame, threshold: float) -> DataFrame:
    """(node, other, links) of the open pairs of rows (same, held): the vectors in them, by side and node."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                same = b.column(0)[r].as_py()
                held = b.column(1)[r].values
                side, node, weight = (held.field(k).to_numpy() for k in range(3))
                x = units(held.field(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(node), -1))
                first = np.flatnonzero(side == 0)
                second = first if same else np.flatnonzero(side == 1)
                u, v = x[first], x[second]
                links = Links([node[first], node[second]], [weight[first], weight[second]], same)
                for at, _, open_ in judged(quantise(u), quantise(v), threshold, same):
                    a, c = np.nonzero(open_)
                    for k in range(0, len(a), 65536):
                        p, q = a[k:k + 65536] + at, c[k:k + 65536]
                        hit = np.einsum("ij,ij->i", u[p], v[q]) >= threshold
                        links.add(p[hit], q[hit])
                yield pa.RecordBatch.from_arrays(links.rows(), names=["node", "other", "links"])

    return pairs.select("same", "held").mapInArrow(run, "node long, other long, links long")


def near_vectors(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row, by cosine >= threshold in double precision.

    Null, empty and zero vectors and those with null or non-finite components link with
    nothing; nor do vectors of different length with one another. Repeated rows are
    vectors of their own, and so are different vectors of one id, linked by value alone. Ids are integers; a vector without one links with nothing, has no
    component and is kept. Other columns are left out. An empty table gives an empty one.
    """
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.coalesce(F.col(id_col).isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col), v.alias("v"), fine.alias("fine"))
    # two hashes name a vector's value; equal vectors are one class of some weight
    k1, k2 = F.xxhash64("v"), F.xxhash64(F.reverse("v"), F.size("v"))
    classes = settle(
        rows.where("fine").groupBy(k1.alias("k1"), k2.alias("k2")).agg(
            F.min(F.col(id_col).cast("long")).alias("id"), F.count("*").alias("weight"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    # classes are dealt into tiles of the vectors of a length, as many as keep a tile bounded
    sizes = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    most = F.least(F.lit(tile), F.floor(F.lit(TILE_NUMBERS) / F.col("dim")))
    sizes = sizes.select("dim", F.when(F.col("n") <= most, 1).otherwise(F.ceil(2 * F.col("n") / most)).cast("long").alias("tiles"))
    packed = settle(
        quantised(classes).join(sizes, "dim").groupBy("dim", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile"))
        .agg(F.sort_array(F.collect_list(F.struct("node", "weight", "code", "scale", "error"))).alias("x")), "tiles")
    # tile i meets tiles i..: an equi-join of numbered rows, of bounded size each
    left = packed.withColumn("tile2", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)))
    right = packed.select("dim", F.col("tile").alias("tile2"), F.col("x").alias("y"))
    found = settle(tile_links(left.join(right, ["dim", "tile2"]).repartition("dim", "tile", "tile2"), threshold), "links")
    wanted = found.where("tile is not null").join(classes.select("node", "weight", "v"), "node")
    # a node's length is its tiles'
    open_ = wanted.groupBy(F.size("v"), "tile", "tile2").agg(F.sort_array(F.collect_list(F.struct("side", "node", "weight", "v"))).alias("held"))
    exact = settle(exact_links(open_.select((F.col("tile") == F.col("tile2")).alias("same"), "held"), threshold), "exact")
    links = found.where("tile is null").select("node", "other", "links").unionAll(exact)
    groups = components(links.select(F.col("node").alias("src"), F.col("other").alias("dst")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = named_by_id(classes.select("k1", "k2", "node", "id", "weight").join(counts, "node", "left"), groups).select(
        "k1", "k2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    mine = rows.select(id_col, F.when(F.col("fine"), k1).alias("k1"), F.when(F.col("fine"), k2).alias("k2"))
    out = mine.join(named, ["k1", "k2"], "left").select(
        id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.col(id_col).cast("long")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op5_embedding_dups(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
