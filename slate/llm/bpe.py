"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each match of the pre-split pattern is merged on its own: leaves hold the rank of the pair that begins at a byte
position, inner nodes the smallest rank below, so the next merge (the leftmost of least rank) is found from the root
down, and a merge updates two or three leaves, each in logarithmic time. A match of n bytes costs n log n whatever it
holds. Short matches of a pass that are new are merged side by side, a tree for each in one array. Matches
repeat, so a bounded cache keeps what the latest ones encode to.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import cache
from itertools import filterfalse
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.llm.common import passes, small_batches

#: Bytes of text whose new matches are merged side by side.
PASS_BYTES = 1 << 21
#: Matches in each of the two generations that a worker remembers, and the longest it remembers.
CACHE, CACHED_CHARS = 200_000, 64
NONE = 1 << 60


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: always the leftmost pair of least rank merges next."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    level = [get(piece[i : i + 2], NONE) for i in range(n - 1)]
    size = 1 << max(0, n - 2).bit_length()
    level += [NONE] * (size - len(level))
    levels = [level]
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        levels.append(level)
    tree = [NONE]  # the least rank below each node: the root is 1, leaves are from size on
    for level in reversed(levels):
        tree += level

    def put(k: int, rank: int) -> None:
        tree[k] = rank
        while k > 1:
            other = tree[k ^ 1]
            if other < rank:
                rank = other
            k >>= 1
            if tree[k] == rank:
                return
            tree[k] = rank

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) < NONE:
        k = 1
        while k < size:
            k <<= 1
            if tree[k] != least:
                k += 1
        i = k - size
        j = after[i]
        end = after[i] = after[j]
        if j < n - 1:
            put(size + j, NONE)
        if end < n:
            before[end] = i
            put(k, get(piece[i : after[end]], NONE))
        else:
            put(k, NONE)
        if (h := before[i]) >= 0:
            put(size + h, get(piece[h:end], NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Merger:
    """The same merges for many short matches at once: row by row a segment tree, all of them updated together."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()] or [0], np.int64)
        self.bytes = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of matches that have no more than ``size`` bytes, a power of two."""
        m, sizes = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        size = max(2, 1 << (int(sizes.max()) - 1).bit_length())
        place = np.arange(size + 1)
        inside = place[:size] < sizes[:, None]
        token = np.zeros((m, size + 1), np.int64)  # the last column stands for what is beyond the ends
        token[:, :size][inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.minimum(np.broadcast_to(place + 1, (m, size + 1)), sizes[:, None])
        after[after == sizes[:, None]] = size
        before = np.broadcast_to(place - 1, (m, size + 1)).copy()
        before[:, 0] = size
        tree = np.full((m, 2 * size), NONE)
        row, at = np.nonzero(place[:size] < sizes[:, None] - 1)
        tree[row, size + at] = self.pair_ranks(token[row, at], token[row, at + 1])
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        live = np.arange(m)
        while True:
            live = live[tree[live, 1] < NONE]
            if not len(live):
                break
            least = tree[live, 1]
            k = np.ones(len(live), np.int64)
            while k[0] < size:
                k *= 2
                k += tree[live, k] != least
            i = k - size
            j = after[live, i]
            end, head = after[live, j], before[live, i]
            after[live, i], before[live, end], token[live, i] = end, i, least
            token[live, j], before[live, 0] = -1, size
            leaves = np.stack([j, i, head])
            new = np.stack([np.full(len(live), NONE), np.where(end < size, self.pair_ranks(least, token[live, end]), NONE), np.where(head < size, self.pair_ranks(token[live, head], least), NONE)])
            leaves[2] = np.where(head < size, head, i)
            new[2] = np.where(head < size, new[2], new[1])
            k = leaves + size
            tree[live, k] = new
            while k[0, 0] > 1:
                k >>= 1
                tree[live, k] = np.minimum(tree[live, 2 * k], tree[live, 2 * k + 1])
        kept = (token[:, :size] >= 0) & inside
        flat, counts = token[:, :size][kept].tolist(), kept.sum(axis=1)
        ends = np.cumsum(counts)
        return [flat[b - c : b] for b, c in zip(ends.tolist(), counts.tolist(), strict=True)]


class Codec:
    """Encoder and decoder by the ranks of a vocabulary file (base64 token and rank on each line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern)
        self.names = [str(rank) for rank in range(len(self.tokens))]
        self.merger = Merger(self.ranks)
        self.known: dict[str, tuple[int, str]] = {}
        self.older: dict[str, tuple[int, str]] = {}

    def piece(self, match: str) -> tuple[int, str]:
        """Of one match: how many ids, and the ids in decimal joined by spaces."""
        found = self.known.get(match)
        if found is None:
            found = self.older.get(match)
            if found is None:
                found = self._entry(merge(match.encode(), self.ranks))
            if len(match) <= CACHED_CHARS:
                self._keep(match, found)
        return found

    def learn(self, matches: set[str]) -> None:
        """Encode at once the short ones of these matches that aren't remembered."""
        groups: dict[int, list[str]] = {}
        for match in matches:
            if match not in self.known:
                if (found := self.older.get(match)) is not None:
                    self._keep(match, found)
                elif len(match) <= 16:
                    raw = match.encode()
                    if raw in self.ranks:
                        self.piece(match)
                    elif len(raw) <= 32:
                        groups.setdefault((len(raw) - 1).bit_length(), []).append(match)
        for group in groups.values():
            for a in range(0, len(group), 4096):
                part = group[a : a + 4096]
                for match, ids in zip(part, self.merger.merge([x.encode() for x in part]), strict=True):
                    self._keep(match, self._entry(ids))

    def _entry(self, ids: list[int]) -> tuple[int, str]:
        return len(ids), " ".join([self.names[i] for i in ids])

    def _keep(self, match: str, found: tuple[int, str]) -> None:
        if len(self.known) >= CACHE:
            self.older, self.known = self.known, {}
        self.known[match] = found

    def encode(self, text: str) -> list[int]:
        return [int(i) for m in self.split.findall(text) for i in self.piece(m)[1].split()]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids and decoded.

    ``path`` is read by each executor, as the tokenizer libraries' own files are: it must exist on every machine.
    A null text counts as empty and gives no ids; bytes that are not UTF-8 are read as U+FFFD.
    """

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for at, texts in passes(batch, most=PASS_BYTES):
                out = []
                split = [own.split.findall((text or b"").decode("utf-8", "replace")) for text in texts]
                new: set[str] = set()
                for matches in split:
                    new.update(filterfalse(own.known.__contains__, matches))
                own.learn(new)
                for matches in split:
                    found = list(map(own.known.get, matches))
                    if None in found:
                        found = [f or own.piece(m) for f, m in zip(found, matches, strict=True)]
                    joined = " ".join(map(itemgetter(1), found))
                    ids = list(map(int, joined.split()))
                    decoded = own.decode(ids)
                    digests = (hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    out.append((len(ids), *digests, *((ids, decoded.decode("utf-8", "replace")) if with_ids else ())))
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([doc_ids[at.start : at.stop], *[pa.array(c, t) for c, t in zip(columns, types, strict=False)]], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
