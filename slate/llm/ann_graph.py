"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Equal vectors are one node that carries its smallest ids (k + 1 of them: no answer can need more). Nodes are dealt
to shards of about ``SHARD`` by a hash of the id. A shard's graph is grown in batches: greedy beam searches from
the medoid over the graph so far propose neighbours for the batch, relaxed-distance pruning (a candidate goes if
``alpha`` times its distance to a kept neighbour is below its distance to the node) keeps at most ``DEGREE`` diverse
edges, and reverse edges are added, pruned by the same rule once a node has more than ``ROOM``; a second round repeats
this with the whole graph.

A task holds one shard's graph and streams the queries past it, so memory is bounded by the shard. Every query
searches every shard and the shards' answers are merged: work grows as queries times shards, which is what the
statement of the search asks for, and a search scores some 3,000 nodes of a full shard. Graphs hold single precision;
scores are cosines in double precision on the original vectors, summed from the first component to the last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slate.llm.common import save
from slate.llm.vectors import keyed, matrix, unit

SHARD, DEGREE, ROOM, ALPHA, BATCH = 16384, 32, 48, 1.2, 512
#: Nodes that a search keeps in the first and second round of building, and when a graph is asked; nodes opened in one step.
FIRST_BEAM, BUILD_BEAM, BEAM, STEP = 24, 48, 96, 8
_BLOCK = 256


class Graph:
    """Directed neighbour graph over unit vectors; -1 fills the edge lists. ``scored`` counts similarities computed."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, room: int = ROOM, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7):
        self.x, self.degree, self.room, self.beam, self.scored = np.ascontiguousarray(x, np.float32), degree, room, beam, 0
        n = len(x)
        self.edges = np.full((n, room), -1, np.int32)
        self.held = np.zeros(n, np.int64)
        self.entry = int((self.x @ self.x.mean(axis=0)).argmax())
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        for relax in (1.0, alpha):
            at = 1 if relax == 1.0 else 0
            while at < n:
                size = min(BATCH, max(1, at) if relax == 1.0 else BATCH)
                self._insert(order[at : at + size], relax)
                at += size

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        """Beam search of many queries at once: ids, best first; -1 where fewer were reached."""
        m, n, q = len(q), len(self.x), np.ascontiguousarray(q, np.float32)
        beam = max(beam, STEP)
        ids, sims, done = np.full((m, beam), -1, np.int32), np.full((m, beam), -np.inf, np.float32), np.ones((m, beam), bool)
        seen = np.zeros(m * (n + 1), np.int32)  # by query and node; node n stands for edges that aren't there
        ids[:, 0], sims[:, 0], done[:, 0] = self.entry, q @ self.x[self.entry], False
        seen[np.arange(m)[:, None] * (n + 1) + [self.entry, n]] = 1
        live = np.arange(m)
        while len(live := live[~done[live].all(axis=1)]):
            own = np.where(done[live], -np.inf, sims[live])
            pick = np.argpartition(-own, STEP - 1, axis=1)[:, :STEP]
            near = self.edges[np.take_along_axis(ids[live], pick, axis=1)]
            near[np.take_along_axis(own, pick, axis=1) == -np.inf] = -1
            near = near.reshape(len(live), -1)
            done[live[:, None], pick] = True
            place = live[:, None] * (n + 1) + np.where(near < 0, n, near)
            row, col = np.nonzero(seen[place] == 0)
            place, turn = place[row, col], np.arange(1, len(row) + 1, dtype=np.int32)
            seen[place] = turn
            once = seen[place] == turn  # of a node that several opened nodes lead to, one
            row, node = row[once], near[row[once], col[once]]
            got = np.einsum("ij,ij->i", q[live[row]], self.x[node])
            self.scored += len(got)
            better = got > sims[live].min(axis=1)[row]
            row, node, got = row[better], node[better], got[better]
            if not len(row):
                continue
            count = np.bincount(row, minlength=len(live))
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            new_ids, new_sims = np.full((len(live), count.max()), -1, np.int32), np.full((len(live), count.max()), -np.inf, np.float32)
            new_ids[row, place], new_sims[row, place] = node, got
            every = (np.concatenate(pair, axis=1) for pair in ((ids[live], new_ids), (sims[live], new_sims), (done[live], new_ids < 0)))
            all_ids, all_sims, all_done = every
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], done[live] = (np.take_along_axis(v, best, axis=1) for v in (all_ids, all_sims, all_done))
        return np.take_along_axis(ids, np.argsort(-sims, axis=1, kind="stable"), axis=1)

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray, relax: float) -> np.ndarray:
        """Diverse neighbours of each node out of its candidates (-1: none)."""
        candidates = np.where(candidates == nodes[:, None], -1, candidates)
        order = np.sort(candidates, axis=1)
        again = np.concatenate([np.zeros((len(nodes), 1), bool), order[:, 1:] == order[:, :-1]], axis=1)
        candidates = np.where(again, -1, order)
        y = self.x[candidates]
        away = 2 - 2 * np.einsum("bd,bcd->bc", self.x[nodes], y)
        away[candidates < 0] = np.inf
        rank = np.argsort(away, axis=1, kind="stable")
        candidates, away, y = np.take_along_axis(candidates, rank, 1), np.take_along_axis(away, rank, 1), np.take_along_axis(y, rank[:, :, None], 1)
        between = 2 - 2 * y @ y.transpose(0, 2, 1)
        usable = candidates >= 0
        out = np.full((len(nodes), self.room), -1, np.int32)
        every = np.arange(len(nodes))
        for k in range(self.degree):
            pick = usable.argmax(axis=1)
            some = usable[every, pick]
            if not some.any():
                break
            out[some, k] = candidates[every, pick][some]
            usable &= ~((relax * relax * between[every, pick] <= away) & some[:, None])
            usable[every, pick] = False
        return out

    def _set(self, nodes: np.ndarray, edges: np.ndarray) -> None:
        self.edges[nodes], self.held[nodes] = edges, (edges >= 0).sum(axis=1)

    def _insert(self, nodes: np.ndarray, relax: float) -> None:
        found = self.search(self.x[nodes], min(self.beam, FIRST_BEAM) if relax == 1.0 else self.beam)
        self._set(nodes, self._prune(nodes, np.concatenate([found, self.edges[nodes]], axis=1), relax))
        row, col = np.nonzero(self.edges[nodes] >= 0)
        source, target = nodes[row], self.edges[nodes][row, col]
        while len(target):  # nodes without room are pruned, then take more
            new = ~(self.edges[target] == source[:, None]).any(axis=1)
            source, target = source[new], target[new]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            heads, begin, count = np.unique(target, return_index=True, return_counts=True)
            at = self.held[target] + np.arange(len(target)) - np.repeat(begin, count)
            fits = at < self.room
            self.edges[target[fits], at[fits]] = source[fits]
            self.held[heads] = np.minimum(self.held[heads] + count, self.room)
            source, target = source[~fits], target[~fits]
            full = np.unique(target)
            for b in range(0, len(full), _BLOCK):
                self._set(full[b : b + _BLOCK], self._prune(full[b : b + _BLOCK], self.edges[full[b : b + _BLOCK]], relax))


def cosines(y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``y`` with that of ``q``, every sum taken from the first component to the last."""
    dot, own, other = np.zeros(len(y)), np.zeros(len(y)), np.zeros(len(y))
    for k in range(y.shape[1]):
        dot, own, other = dot + y[:, k] * q[:, k], own + y[:, k] * y[:, k], other + q[:, k] * q[:, k]
    return dot / (np.sqrt(own) * np.sqrt(other))


def _search_shards(dim: int, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("node", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def answer(shard, query_ids, q):
        nodes, ids, x, graph = shard
        near = graph.search(unit(q), max(BEAM, 2 * k + 2))[:, : 2 * k + 2]
        row, col = np.nonzero(near >= 0)
        at = near[row, col]
        columns = [query_ids[row], nodes[at], cosines(x[at], q[row]), [ids[j] for j in at.tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def build(parts):
        nodes, ids, packed = ([v for p in parts for v in p[c]] for c in range(3))
        x = matrix(packed, dim)
        return np.array(nodes, np.int64), ids, x, Graph(unit(x))

    def run(batches):
        at, parts, shard = None, [], None
        for batch in batches:
            shards, is_query = np.array(batch.column("shard")), np.array(batch.column("is_query"), bool)
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shards)], strict=True):
                if a == b:
                    continue
                if shards[a] != at:
                    at, parts, shard = shards[a], [], None
                part = batch.slice(a, b - a)
                if not is_query[a]:
                    parts.append([part.column(c).to_pylist() for c in ("id", "ids", "vector")])
                elif parts:
                    shard = shard or build(parts)
                    for c in range(0, len(part), BATCH):
                        some = part.slice(c, BATCH)
                        yield answer(shard, np.array(some.column("id"), np.int64), matrix(some.column("vector").to_pylist(), dim))

    return run


def search(vectors: DataFrame, queries: Column, k: int = 5, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found to each row that ``queries`` selects, itself excepted.

    Ties go to the smaller vec_id. Vectors that take no part (see ``vectors.keyed``) and rows without vec_id neither
    ask nor answer. A repeated vec_id with one vector counts once.
    """
    rows = save(keyed(vectors).where("key is not null and vec_id is not null"))
    by_key = Window.partitionBy("key").orderBy("vec_id")
    few = rows.select("key", "vec_id").distinct().withColumn("r", F.row_number().over(by_key)).where(F.col("r") <= k + 1)
    few = few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = save(rows.groupBy("key").agg(F.min("vector").alias("vector")).join(few, "key").select(F.col("ids")[0].alias("id"), "ids", "vector"))
    n, width = nodes.agg(F.count("*"), F.max(F.octet_length("vector"))).first()
    n_shards = max(1, -(-n // shard))
    asked = rows.where(queries).select(F.col("vec_id").alias("id"), "vector").dropDuplicates(["id", "vector"])
    # Shards of equal size to a row: numbers along a hash order would need a sort; a hash gives them to within a few percent.
    stored = nodes.select(F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"), "id", "ids", "vector")
    copies = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(True).alias("is_query"), "id", F.lit(None).cast("array<long>").alias("ids"), "vector")
    dealt = stored.union(copies).repartitionById(n_shards, "shard").sortWithinPartitions("shard", "is_query")
    found = dealt.mapInArrow(_search_shards((width or 8) // 8, k), "query_id long, node long, score double, ids array<long>")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
