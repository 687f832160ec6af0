"""Exact cosine range join: pivots partition the vectors, the triangle inequality leaves out what is too far apart.

Equal vectors are one row with a weight. On unit vectors cosine >= c is Euclidean distance <= r. Each vector
belongs to the cell of its nearest pivot; cells with more than ``CELL`` vectors are split into blocks. A block is
one row: its vectors, packed, its pivot, and the largest distance to it. Blocks are saved once, in parts of a
bounded size, and a task holds two parts and streams their pairs of blocks past each other, so that nothing is
copied to disk however many blocks meet. Two blocks meet unless their pivots are more than both radii and r apart;
of the blocks that meet, vectors are left out that lie too far from the other pivot (beyond its radius and r, nearer
to their own by more than ``2 r``, or beyond the bisecting hyperplane by more than r).

Products are taken in a few leading directions first, with a bound (Cauchy-Schwarz) on what the other directions
can add; what this leaves is compared in full. A task returns for each of its vectors that has links their number
and the smallest vector that they reach, so pairs are never listed. In many dimensions distances concentrate and
the inequality can prune little; then every block meets every other one and the arithmetic is quadratic (a matrix
product), with exact results still.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.llm.common import components, mix, save
from slate.llm.vectors import keyed, matrix, unit, width
from slate.sources.staged import discard

#: Vectors of a block; pivots at most (they are broadcast: 4,096 of 1,024 dimensions are 32 MB).
CELL, MAX_PIVOTS = 4096, 4096
#: Bytes of a block and of a part, as doubles (vectors that floats hold exactly take half of it).
BLOCK_BYTES, PART_BYTES = 4 << 20, 16 << 20
#: Parts that one job pairs with as many others, so that the driver has no more tasks to keep than this squared.
JOB_PARTS = 128
#: Vectors by which the leading directions are chosen, at most; vectors of a block that are compared at a time.
SAMPLE, STRIP = 2048, 128
#: Nothing within this of the limit is left to a matrix product.
BORDER = 1e-12


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = x @ pivots.T
    return near.argmax(axis=1), near


def _distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


# --- leading directions ----------------------------------------------------------------------------


def _screen(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors in the leading directions, and the length of what is left: their products bound the cosines."""
    lead = x @ basis
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", lead, lead))) + 1e-7
    return np.column_stack([lead, rest]).astype(np.float32)


def _slack(dims: int) -> float:
    """More than a float product of that many terms of two unit vectors can be wrong."""
    return (dims + 8) * 2.5e-7


def leading(sample: np.ndarray, least: float) -> np.ndarray:
    """Directions to compare first: half the sample's principal ones, as many as make comparing the other half cheapest."""
    dim = sample.shape[1]
    half, other = sample[::2], sample[1::2]
    basis = np.linalg.eigh(half.T @ half)[1][:, ::-1]
    pairs = np.triu_indices(len(other), 1)

    def cost(k: int) -> float:
        lead = _screen(other, basis[:, :k])
        left = np.count_nonzero((lead @ lead.T)[pairs] >= least - _slack(k))
        return k + 16 + 10_000 * (left + 1) / (len(pairs[0]) + 1)  # a pair compared in full costs that many products

    return np.ascontiguousarray(basis[:, : min([*range(4, dim, 4), dim], key=cost)])


# --- blocks ----------------------------------------------------------------------------------------


def _pack_blocks(dim: int, pivots: Callable[[], np.ndarray]):
    """Rows sorted by block become a row for each block."""
    names = ["block", "part", "pivot", "radius", "ids", "weights", "data"]

    def packed(rows):
        block, part, cell, ids, weights, data = (np.concatenate(c) if n < 5 else sum(c, []) for n, c in enumerate(zip(*rows, strict=True)))
        x = matrix(data, dim)
        pivot = pivots()[cell[0]]
        radius = float(_distance(unit(x) @ pivot).max())
        short = x.astype(np.float32) if all(len(d) % 8 for d in data) else x
        values = [int(block[0])], [int(part[0])], [pivot.tolist()], [radius], [ids.tobytes()], [weights.tobytes()], [short.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), *[pa.binary()] * 3], strict=True)], names)

    def run(batches):
        block, rows = None, []
        for batch in batches:
            blocks = np.array(batch.column("block"))
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
                if a == b:
                    continue
                if blocks[a] != block:
                    if rows:
                        yield packed(rows)
                    block, rows = blocks[a], []
                part = batch.slice(a, b - a)
                rows.append((*(np.array(part.column(c)) for c in ("block", "part", "cell")), *(np.array(part.column(c), np.int64) for c in ("id", "weight")), part.column("vector").to_pylist()))
        if rows:
            yield packed(rows)

    return run


class _Hits:
    """Places in a matrix product that reach a bound; the product and its mask are written where the last ones were."""

    def __init__(self, bound: float):
        self.bound, self.near, self.mask = np.float32(bound), np.empty(0, np.float32), np.empty(0, bool)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = len(x) * len(y)
        if n > len(self.near):
            self.near, self.mask = np.empty(n, np.float32), np.empty(n + 7, bool)
        near, mask = self.near[:n], self.mask[: (n + 7) // 8 * 8]
        np.matmul(x, y.T, out=near.reshape(len(x), len(y)))
        mask[n:] = False
        np.greater_equal(near, self.bound, out=mask[:n])
        eights = np.flatnonzero(mask.view(np.uint64))
        row, at = np.nonzero(mask.reshape(-1, 8)[eights])
        return eights[row] * 8 + at


class _Forest:
    """Vectors that a task has met: their links so far, and the trees that these make of them."""

    def __init__(self):
        self.starts: dict[int, int] = {}
        self.ids = self.links = self.root = np.zeros(0, np.int64)

    def place(self, block: int, ids: np.ndarray) -> int:
        """Where a block's vectors stand."""
        if block not in self.starts:
            at = self.starts[block] = len(self.ids)
            self.ids = np.concatenate([self.ids, ids])
            self.links = np.concatenate([self.links, np.zeros(len(ids), np.int64)])
            self.root = np.concatenate([self.root, np.arange(at, at + len(ids))])
        return self.starts[block]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            u, v = root[a], root[b]
            apart = u != v
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
            while (root[root] != root).any():
                root[:] = root[root]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.root, self.ids)
        linked = np.flatnonzero(self.links)
        return self.ids[linked], self.links[linked], least[self.root[linked]]


def _join_blocks(least: float, dim: int, basis: np.ndarray):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
    reach = float(np.sqrt(2 - 2 * least)) + 1e-9
    bound = least - _slack(basis.shape[1]) - 1e-7

    def decided(x, y, i, j):
        """Which of some pairs link."""
        near = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 8192]], y[j[a : a + 8192]]) for a in range(0, len(i), 8192)])
        link = near >= least + BORDER
        # At the border a product's last digits depend on the order of summing: there one fixed order decides.
        for n in np.flatnonzero(~link & (near >= least - BORDER)):
            link[n] = sum((x[i[n]] * y[j[n]]).tolist()) >= least
        return link

    def dense(x, y):
        """All links of a strip in which many pairs are near."""
        near = x @ y.T
        mask = near >= least + BORDER
        for i, j in zip(*np.nonzero(~mask & (near >= least - BORDER)), strict=True):
            mask[i, j] = sum((x[i] * y[j]).tolist()) >= least
        return mask

    def reachable(held, other):
        """Vectors of ``held`` that may have links in the block ``other``."""
        (_, x, _, own, away, _), (_, _, _, pivot, _, radius) = held, other
        far = _distance(cosines := x @ pivot)
        beyond = (1 - away * away / 2 - cosines) > reach * float(_distance(own @ pivot)) + 1e-9
        return np.flatnonzero((far <= radius + reach + 1e-7) & (far - away <= 2 * reach + 1e-7) & ~beyond)

    def compare(forest, reaching, one, two, same):
        at, to = (forest.place(side[0][0], side[0][1]) for side in (one, two))
        a, b = (np.arange(len(one[1])),) * 2 if same else (reachable(one, two), reachable(two, one))
        if not len(a) or not len(b):
            return
        (_, _, weights), (_, _, other_weights) = one[0], two[0]
        x, y, lead, other_lead = one[1], two[1], one[2], two[2]
        if len(b) < len(y):
            y, other_lead = y[b], other_lead[b]
        other_weights = other_weights[b]
        for s in range(0, len(a), STRIP):
            rows = a[s : s + STRIP]
            hits = reaching(lead[rows], other_lead)
            if not len(hits):
                continue
            if len(hits) * 64 < len(rows) * len(b):
                i, j = np.divmod(hits, len(b))
                link = decided(x[rows], y, i, j)
                if same:
                    link &= rows[i] != j
                i, j = i[link], j[link]
                np.add.at(forest.links, at + rows[i], other_weights[j])
                if not same:
                    np.add.at(forest.links, to + b[j], weights[rows[i]])
                forest.join(at + rows[i], to + b[j])
                continue
            mask = dense(x[rows], y)
            if same:
                mask[np.arange(len(rows)), rows] = False
            counts = mask.astype(np.float64)
            forest.links[at + rows] += (counts @ other_weights).astype(np.int64)
            if not same:
                forest.links[to + b] += (weights[rows] @ counts).astype(np.int64)
            roots = np.concatenate([forest.root[at + rows[mask.any(axis=1)]], forest.root[to + b[mask.any(axis=0)]]])
            if len(roots) and (roots != roots[0]).any():
                i, j = np.nonzero(mask)
                forest.join(at + rows[i], to + b[j])

    def held(batch, side, n):
        ids, weights = (np.frombuffer(batch.column(f"{side}_{c}")[n].as_py(), np.int64) for c in ("ids", "weights"))
        data = batch.column(f"{side}_data")[n].as_py()
        x = unit(np.frombuffer(data, np.float32 if len(data) == 4 * dim * len(ids) else np.float64).reshape(len(ids), dim).astype(np.float64))
        pivot = np.array(batch.column(f"{side}_pivot")[n].as_py())
        block = batch.column(f"{side}_block")[n].as_py()
        return (block, ids, weights), x, _screen(x, basis), pivot, _distance(x @ pivot), batch.column(f"{side}_radius")[n].as_py()

    def run(batches):
        forest, reaching, one, others = _Forest(), _Hits(bound), None, {}
        for batch in batches:
            for n, (a, b) in enumerate(zip(batch.column("a_block").to_pylist(), batch.column("b_block").to_pylist(), strict=True)):
                if one is None or one[0][0] != a:
                    one = held(batch, "a", n)
                if b not in others:  # a part's blocks, which every block of the other part meets
                    others[b] = held(batch, "b", n)
                compare(forest, reaching, one, others[b], a == b)
        found = forest.rows()
        for n in range(0, len(found[0]), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(v[n : n + 4096], pa.int64()) for v in found], schema=schema)

    return run


def _meet(reach: float) -> Column:
    """Blocks of which a vector of one may be within ``reach`` of a vector of the other."""
    cosine = F.aggregate(F.zip_with("a_pivot", "b_pivot", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine)) <= F.col("a_radius") + F.col("b_radius") + reach + 1e-7


def _join_parts(one: DataFrame, two: DataFrame, least: float, dim: int, basis: np.ndarray) -> DataFrame:
    """(id, links, other), saved: every two blocks meet in the task that reads their two files."""
    spark = one.sparkSession
    sides = [blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in blocks.columns if c != "part")) for side, blocks in (("a", one), ("b", two))]
    pairs = sides[0].join(sides[1].hint("shuffle_replicate_nl"), (F.col("a_block") <= F.col("b_block")) & _meet(float(np.sqrt(2 - 2 * least))))
    # A file is a task's part: neither split nor read with another.
    limits = {f"spark.sql.files.{name}": spark.conf.get(f"spark.sql.files.{name}") for name in ("maxPartitionBytes", "openCostInBytes")}
    try:
        for name in limits:
            spark.conf.set(name, str(1 << 30))
        return save(pairs.mapInArrow(_join_blocks(least, dim, basis), "id long, links long, other long"))
    finally:
        for name, value in limits.items():
            spark.conf.set(name, value)


def _drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete files of shuffles that nothing will read again: it does so when their plans are collected."""
    spark.sparkContext._jvm.System.gc()


def near_duplicates(vectors: DataFrame, least: float = 0.9, cell: int = CELL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable by links), kept.

    Vectors that take no part (see ``vectors.keyed``) have no links and are their own component. Rows without
    vec_id link to the rows like them but are no link of theirs, and are kept.
    """
    spark = vectors.sparkSession
    whole = save(keyed(vectors, narrow=True))
    rows = save(whole.select("vec_id", "key"))
    classes = save(whole.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.min("vector").alias("vector")))
    discard(whole)
    _drop_shuffles(spark)
    n, dim = classes.agg(F.count("*"), F.max(width(F.col("vector")))).first()
    dim = dim or 1
    cell = max(1, min(cell, BLOCK_BYTES // (8 * dim)))
    n_pivots = min(MAX_PIVOTS, max(1, -(-n // cell)))
    n_sample = max(256, min(SAMPLE, BLOCK_BYTES // (8 * dim)))
    chosen = classes.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(max(n_pivots, n_sample)).collect()
    sample = unit(matrix([r.vector for r in chosen], dim)) if chosen else np.eye(1, dim)
    basis = leading(sample[:n_sample], least)
    n_pivots = min(n_pivots, len(sample))
    shared = spark.sparkContext.broadcast(sample[:n_pivots])

    def count(batches):
        for batch in batches:
            at, many = np.unique(_nearest(unit(matrix(batch.column("vector").to_pylist(), dim)), shared.value)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(many, pa.int64())], ["cell", "n"])

    sizes = np.zeros(n_pivots, np.int64)
    for r in classes.select("vector").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    split = np.maximum(1, -(-sizes // cell))  # blocks of each cell
    start = np.cumsum(split) - split
    # Parts of a bounded size, and enough that their pairs keep all cores busy; part_of: the part of each block.
    n_blocks = int(split.sum())
    busy = int(np.ceil(np.sqrt(6 * spark.sparkContext.defaultParallelism)))
    n_parts = max(-(-int(n) * dim * 8 // PART_BYTES), min(n_blocks, busy), 1)
    each = np.repeat(sizes / split, split)
    part_of = np.minimum(n_parts - 1, (np.cumsum(each) - each / 2) * n_parts / max(1, int(n))).astype(np.int32)

    def deal(batches):
        for batch in batches:
            at, _ = _nearest(unit(matrix(batch.column("vector").to_pylist(), dim)), shared.value)
            block = start[at] + mix_ids(np.array(batch.column("id"), np.int64)) % split[at]
            arrays = [pa.array(block, pa.int64()), pa.array(part_of[block], pa.int32()), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns], ["block", "part", "cell", *batch.schema.names])

    dealt = classes.select("id", "weight", "vector").mapInArrow(deal, "block long, part int, cell int, id long, weight long, vector binary")
    stored = []
    for low in range(0, n_parts, JOB_PARTS):
        some = min(JOB_PARTS, n_parts - low)
        here = dealt.where((F.col("part") >= low) & (F.col("part") < low + some))
        here = here.repartitionById(some, F.col("part") - low).sortWithinPartitions("block")
        stored.append(save(here.mapInArrow(_pack_blocks(dim, lambda: shared.value), "block long, part int, pivot array<double>, radius double, ids binary, weights binary, data binary")))
    whole, classes = classes, save(classes.select("key", "id", "weight"))
    discard(whole)
    del here, dealt
    _drop_shuffles(spark)
    found = functools.reduce(DataFrame.union, [_join_parts(one, two, least, dim, basis) for k, one in enumerate(stored) for two in stored[k:]])
    discard(*stored)
    reached = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(links, "id", "left").join(reached, F.col("id") == F.col("node"), "left")
    named = named.select(F.col("key").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("class_id"))
    out = rows.select("vec_id", "key").join(named, F.col("key") == F.col("class_key"), "left")
    component = F.coalesce("class_id", "vec_id")
    alone = F.col("vec_id").isNull()
    return out.select(
        "vec_id",
        F.when(alone, F.coalesce(F.col("n_links") + 1, F.lit(0))).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def mix_ids(ids: np.ndarray) -> np.ndarray:
    """Spread ids over the blocks of a cell."""
    return (mix(ids.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
