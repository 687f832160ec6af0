"""MinHash near-dedup through an LSH forest, every link confirmed on full shingle sets.

1.  One pass over the texts gives each document the digest of its shingle set, ``TREES`` signatures of ``DEPTH`` MinHash
    values, and a sketch of a bit for each value. Documents with equal sets form one class, which its smallest doc_id
    stands for.
2.  Each tree is one sorted order of the signatures. There a document's neighbours on both sides are those that share
    the longest prefixes with it: in a crowded region they agree to a great depth, in a thin one to as little as ``LEAST``
    values. The nearest whose sketch isn't too far from the document's is a candidate; candidates are confirmed on
    full sets, and links make components.
3.  The same orders are walked again: now all ``NEAR`` neighbours on either side that lie in another component are
    candidates. So no pair of a region (a run that shares ``BASE`` values) of up to ``NEAR`` + 1 documents stays open.
4.  Larger regions that still hold several components are settled exactly: their documents go by their rarest shingles
    (a prefix filter with positions). Two documents at the threshold share one of them at a place where enough
    shingles follow in both; only pairs of different components, one of them outside its region's largest, are met.

Every pass costs a bounded number of comparisons for each document and tree; no region is compared pair by pair. A pair at
similarity 0.8 shares no region in any tree with probability (1 - 0.8**4)**16 = 0.0002, and its sketches are
found too far apart with probability 0.000001.
Rows without doc_id link with nothing (component_id null, kept true). Rows of one doc_id are one node, whatever their
texts. Null or empty texts have an empty set and link with nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.llm.common import components, discard, mix, passes, save, shingle_sets, small_batches, splitmix

TREES, DEPTH = 16, 8
#: Values that neighbours share at least, values that make a region, neighbours looked at on either side.
LEAST, BASE, NEAR = 2, 4, 8
#: Shingles are counted in so many buckets, to tell rare from common ones.
BUCKETS = 1 << 18

_KEYS = splitmix(TREES * DEPTH, 0xF04E57)
_MULT = splitmix(TREES * DEPTH, 0x5EED) | np.uint64(1)
_ORDER, _SKETCH = 2 * DEPTH, TREES * DEPTH // 8


def _signature(shingles: np.ndarray) -> tuple[bytes, bytes]:
    """MinHash values of two bytes each, and a further bit of each of them."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096, None]
        np.minimum(low, ((part ^ _KEYS) * _MULT).min(axis=0), out=low)
    low = mix(low)
    return low.astype(np.uint16).tobytes(), np.packbits((low >> np.uint64(40)).astype(np.uint8) & 1).tobytes()


def far(percent: int) -> int:
    """Sketch bits in which a pair at the threshold differs at most, but for five deviations' luck."""
    n, p = TREES * DEPTH, (100 - percent) / 200
    return int(n * p + 5 * np.sqrt(n * p * (1 - p)))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature, sketch) of every document."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in passes(batch):
                sets = shingle_sets(texts, width)
                signed = [_signature(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[at.start : at.stop],
                        pa.array(map(len, sets), pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        *[pa.array(c, pa.binary()) for c in zip(*signed, strict=True)],
                    ],
                    names,
                )

    names = ["doc_id", "n_shingles", "set_key", "signature", "sketch"]
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary, sketch binary")


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those (a, b) whose full shingle sets have ``100 * |intersection| >= percent * |union|``."""

    def run(batches):
        last, own = None, None
        for batch in batches:
            kept = []
            a_ids, b_ids, a_texts = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("a_text")
            for at, texts in passes(batch, "b_text"):
                for i, other in enumerate(shingle_sets(texts, width), at.start):
                    if last is None or a_ids[i] != last[0] or a_texts[i].as_py() != last[1]:
                        last = (a_ids[i], a_texts[i].as_py())
                        own = shingle_sets([last[1].encode()], width)[0]
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(other) - both):
                        kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a_ids[i] for i in kept], pa.int64()), pa.array([b_ids[i] for i in kept], pa.int64())], ["a", "b"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t")).where("id is not null and t is not null")
    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("t").alias("b_text")), "b").join(texts.select(F.col("id").alias("a"), F.col("t").alias("a_text")), "a")
    return joined.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long").distinct()


def _entries(classes: DataFrame) -> DataFrame:
    """(doc, component, sketch, tree, order): a class once for each tree."""
    trees = [F.struct(F.lit(t).alias("tree"), F.substring("signature", 1 + t * _ORDER, _ORDER).alias("order")) for t in range(TREES)]
    return classes.select("doc", "component", "sketch", F.explode(F.array(*trees)).alias("e")).select("doc", "component", "sketch", "e.tree", "e.order")


def _walk(limit: int, every: bool):
    """Along a sorted order: each document with the nearest of the ``NEAR`` before it that may be alike, or, with
    ``every``, with all of them that lie in another component. A task's first and last rows come out as well (b null)."""

    def fixed(column: pa.Array, size: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)

    def read(batch: pa.RecordBatch) -> list[np.ndarray]:
        tree, doc, component = (np.array(batch.column(c), np.int64) for c in ("tree", "doc", "component"))
        return [tree, doc, component, fixed(batch.column("order"), _ORDER), fixed(batch.column("sketch"), _SKETCH)]

    def pairs(rows: list[np.ndarray], new: int) -> tuple[np.ndarray, np.ndarray]:
        tree, doc, component, order, sketch = rows
        start = np.ascontiguousarray(order[:, : 2 * LEAST]).view(f"V{2 * LEAST}")[:, 0]
        bits = sketch.view(np.uint64)
        first, second, done = [], [], np.zeros(len(doc), bool)
        for k in range(1, min(NEAR, len(doc) - 1) + 1):
            i = np.arange(max(k, new), len(doc))
            i = i[~done[i]]
            j = i - k
            near = (tree[i] == tree[j]) & (start[i] == start[j]) & (doc[i] != doc[j])
            if every:
                near &= component[i] != component[j]
            near[near] = np.bitwise_count(bits[i[near]] ^ bits[j[near]]).sum(axis=1, dtype=np.int64) <= limit
            first.append(doc[i[near]])
            second.append(doc[j[near]])
            if not every:
                done[i[near]] = True
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (first, second))
        return np.minimum(a, b), np.maximum(a, b)

    def seam(rows: list[np.ndarray]) -> pa.RecordBatch:
        tree, doc, component, order, sketch = rows
        columns = [doc, [None] * len(doc), tree, component, [x.tobytes() for x in order], [x.tobytes() for x in sketch]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def run(batches):
        last, seen = None, 0
        for batch in batches:
            rows = read(batch)
            if seen < NEAR:
                yield seam([c[: NEAR - seen] for c in rows])
            seen += len(rows[0])
            new = len(last[0]) if last else 0
            rows = [np.concatenate(pair) for pair in zip(last, rows, strict=True)] if last else rows
            a, b = pairs(rows, new)
            yield pa.RecordBatch.from_arrays([pa.array(a, kinds[0]), pa.array(b, kinds[1]), *[pa.nulls(len(a), t) for t in kinds[2:]]], names)
            last = [c[-NEAR:] for c in rows]
        if last:
            yield seam(last)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    names = ["a", "b", "tree", "component", "order", "sketch"]
    return run


def neighbours(classes: DataFrame, limit: int, every: bool) -> DataFrame:
    """Distinct candidate pairs (a, b) of the classes (doc, component, signature, sketch), from all trees."""
    schema, by = "a long, b long, tree int, component long, order binary, sketch binary", ["tree", "order", "doc"]
    walked = save(_entries(classes).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_walk(limit, every), schema))
    # What stands on both sides of a cut between tasks: 2 * NEAR rows of each task.
    seams = walked.where("b is null").select(F.col("a").alias("doc"), "component", "sketch", "tree", "order").distinct()
    across = seams.repartition(1).sortWithinPartitions(*by).mapInArrow(_walk(limit, every), schema)
    return walked.union(across).where("b is not null").select("a", "b").distinct()


# --- crowded regions: a prefix filter ---


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (doc, component, open) with items: four bytes of each shingle, one for each."""

    def run(batches):
        for batch in batches:
            for at, texts in passes(batch):
                items = [(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in shingle_sets(texts, width)]
                rest = [batch.column(c)[at.start : at.stop] for c in ("doc", "component", "open")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(items, pa.binary())], ["doc", "component", "open", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    return wanted.join(texts, F.col("doc") == F.col("id")).select("doc", "component", "open", "text").mapInArrow(run, "doc long, component long, open boolean, items binary")


def _bucket_counts(sets: DataFrame) -> np.ndarray:
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("items").to_pylist()), np.uint32) & (BUCKETS - 1), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    rows = sets.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[np.array(rows.column("bucket"))] = np.array(rows.column("n"))
    return out


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(doc, component, open, size, item, place) of each document's rarest items: those of which a pair at the threshold shares one."""
    counts = sets.sparkSession.sparkContext.broadcast(_bucket_counts(sets))  # BUCKETS numbers, 2 MB

    def run(batches):
        n = counts.value
        for batch in batches:
            at, items, places, sizes = [], [], [], []
            for k, packed in enumerate(batch.column("items").to_pylist()):
                own = np.frombuffer(packed, np.uint32)
                held = len(own) + (-percent * len(own)) // 100 + 1  # less what even an equal-sized half of the pair must share
                own = own[np.lexsort((own, n[own & (BUCKETS - 1)]))[:held]]
                at.append(np.full(len(own), k))
                items.append(own.astype(np.int64))
                places.append(np.arange(len(own)))
                sizes.append(np.full(len(own), len(packed) // 4))
            at, items, places, sizes = map(np.concatenate, (at, items, places, sizes))
            for b in range(0, len(at), 50_000):
                part = slice(b, b + 50_000)
                rows = batch.select(["doc", "component", "open"]).take(pa.array(at[part]))
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(c[part], pa.int64()) for c in (sizes, items, places)]], names)

    names = ["doc", "component", "open", "size", "item", "place"]
    return sets.mapInArrow(run, "doc long, component long, open boolean, size long, item long, place long")


def _met(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components, one of them open, that share an item early enough to reach the threshold."""
    a = rare.where("open").select([F.col(c).alias(f"a_{c}") for c in ("doc", "component", "size", "place")] + ["item"])
    b = rare.select([F.col(c).alias(f"b_{c}") for c in ("doc", "component", "size", "place")] + ["item"])
    both = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    enough = both * (100 + percent) >= (F.col("a_size") + F.col("b_size")) * percent
    met = a.join(b, "item").where((F.col("a_component") != F.col("b_component")) & enough)
    return met.select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b")).distinct()


def _crowded(classes: DataFrame) -> DataFrame:
    """(doc, component, open) of the documents in regions of several components and over ``NEAR`` + 1 documents.

    Open are those outside the largest component of such a region.
    """
    placed = _entries(classes).select("doc", "component", "tree", F.substring("order", 1, 2 * BASE).alias("region"))
    counts = placed.groupBy("tree", "region", "component").agg(F.count("*").alias("m"))
    # Saved, so that the join is one of two plain exchanges and Spark can split a crowded region's partition.
    mains = save(counts.groupBy("tree", "region").agg(F.sum("m").alias("n"), F.count("*").alias("parts"), F.max_by("component", F.struct("m", "component")).alias("main")).where(f"parts > 1 and n > {NEAR + 1}"))
    return placed.join(mains, ["tree", "region"]).groupBy("doc").agg(F.first("component").alias("component"), F.bool_or(F.col("component") != F.col("main")).alias("open"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    signed = save(signatures(docs, width))
    known = signed.where("set_key is not null and doc_id is not null")
    classes = save(known.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.min("signature").alias("signature"), F.min("sketch").alias("sketch")))
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high").select("doc_id")
    links = known.join(save(several), "doc_id", "left_semi").select("doc_id", "set_key").join(classes, "set_key").select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).distinct()

    def placed(reached: DataFrame) -> DataFrame:
        return classes.join(reached, F.col("doc") == F.col("node"), "left").select("doc", F.coalesce("component", "doc").alias("component"), "signature", "sketch")

    tested = save(neighbours(classes.withColumn("component", F.col("doc")), far(percent), every=False))
    links = save(links.union(confirm(tested, docs, width, percent)))
    reached = save(components(links))
    for step in ("neighbours", "crowded regions"):
        now = save(placed(reached))
        found = neighbours(now, far(percent), every=True) if step == "neighbours" else _met(prefixes(save(_sets(docs, _crowded(now), width)), percent), percent)
        more = save(found.join(tested, ["a", "b"], "left_anti"))
        new = save(confirm(more, docs, width, percent))
        tested = tested.union(more)
        discard(now)
        if not new.isEmpty():
            links = links.union(new)
            reached = save(components(links))
    found = classes.join(reached, F.col("doc") == F.col("node"), "left").select(F.col("set_key").alias("class_key"), F.coalesce("component", "doc").alias("class_id"))
    out = signed.join(found, F.col("set_key") == F.col("class_key"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
