"""Shared parts: saved intermediates, word hashing over whole Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.sources.staged import discard, save

#: Bytes of text that one vectorised pass works on (some ten arrays of eight bytes for each, which a worker keeps); longer
#: texts form a pass of their own.
PASS_BYTES = 1 << 19


def small_batches(spark: SparkSession) -> None:
    """Arrow batches small enough that a batch of long texts fits a worker: limits above these are lowered, for the session."""
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 8 << 20)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def free(columns: list[str], *names: str) -> list[str]:
    """Helper columns' names, made longer until they aren't among ``columns``."""
    return [next(n + "_" * k for k in range(len(columns) + 1) if n + "_" * k not in columns) for n in names]


# --- hashing -------------------------------------------------------------------------------------


def splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values from a seed (SplitMix64)."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTES = splitmix(256, 0xC0FFEE)
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PASS_BYTES)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range of ``buf``; equal bytes give equal hashes wherever they stand."""
    return sequence_hashes(_BYTES[buf], starts, ends)


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each range of hashed ``values``; equal ranges give equal hashes wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down[: len(values)], out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))


class Texts:
    """Texts of one pass, joined: their bytes, and where each begins and ends."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.n, self.ends = len(texts), np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.buf = np.frombuffer(b"".join(texts), np.uint8)

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes for which ``is_word`` holds: starts, ends, and for each text where its first run is in them."""
        on = is_word[self.buf]
        first = np.zeros(len(on) + 1, bool)
        first[self.starts] = True
        before = np.concatenate([[False], on[:-1]]) if len(on) else on
        starts = np.flatnonzero(on & (~before | first[:-1]))
        after = np.concatenate([on[1:], [False]]) if len(on) else on
        ends = np.flatnonzero(on & (~after | first[1:])) + 1
        return starts, ends, np.append(np.searchsorted(starts, self.starts), len(starts))


def passes(batch: pa.RecordBatch, column: str = "text", most: int = PASS_BYTES) -> Iterator[tuple[slice, list[bytes | None]]]:
    """Slices of a batch whose texts are of at most ``most`` bytes together, or one text."""
    values = batch.column(column)
    if not pa.types.is_binary(values.type) and not pa.types.is_large_binary(values.type):
        values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
    texts, at, size = [], 0, 0
    for i, value in enumerate(values):
        text = value.as_py()
        n = len(text or b"")
        if texts and size + n > most:
            yield slice(at, i), texts
            texts, at, size = [], i, 0
        texts.append(text)
        size += n
    if texts:
        yield slice(at, len(values)), texts


# --- shingles ------------------------------------------------------------------------------------

#: Words are runs of anything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles (A-Z lower-cased).

    With fewer words the whole sequence is one shingle; without words, or null, the set is empty.
    """
    t = Texts([x or b"" for x in texts])
    t.buf = LOWER[t.buf]
    starts, ends, first = t.words(NOT_SPACE)
    words = range_hashes(t.buf, starts, ends)
    joined = words[: max(0, len(words) - width + 1)].copy()
    for k in range(1, width):
        joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(joined)])
    sets = []
    for i in range(t.n):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            own = joined[a : b - width + 1]
        elif b > a:
            own = words[a : a + 1]
            for h in words[a + 1 : b]:
                own = mix(own * np.uint64(0x9E3779B97F4A7C15) + h)
            own = mix(own + np.uint64(b - a))
        else:
            own = words[:0]
        sets.append(np.unique(own))
    return sets


# --- connected components ------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that its links reach.

    Alternating large-star and small-star steps; each shrinks every tree, all groupings are minima (combined
    before the shuffle), and each round is saved, so lost executors repeat one round at most.
    """
    spark = edges.sparkSession
    links = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = links.union(links.select("v", "u"))
        # Saved, so that the join is one of two plain exchanges and Spark can split a hub's partition.
        low_saved = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low_saved, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        last, links = (links, low_saved), save(small.where("u <> v").distinct())
        discard(*last)
        n, nodes = links.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes and links.join(links.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break  # every node has one link, and that to a root
    roots = links.select(F.col("v").alias("u"), "v").distinct()
    return links.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
