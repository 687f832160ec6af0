"""Mixing sources to target weights with soft membership.

A softmax classifier learned from the labelled table (a bounded sample of it: ``SAMPLE`` rows) gives every document
posteriors over domains. Document rates r >= 0 (r >= 1 in domains that are to stay whole) are fitted so that the expected tokens of each domain,
sum of r * tokens * posterior, match the targets: weighted least squares by projected gradient. A step needs one
sum over all documents for each domain and pair of domains, which Spark makes; the gradient is scaled by 1/tokens and by the inverse of the second
moments of the documents whose rates can move, so a document's rate follows from its posteriors and the short list of past residuals. Tasks replay that list instead of keeping state,
so nothing is lost with an executor, and the driver holds a number for each domain and step.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.llm.common import LOWER, NOT_SPACE, Texts, free, passes, range_hashes, save, small_batches

BITS, SAMPLE, TRAINING, CLOSE = 16, 4000, 80, 1e-4
#: Steps without a nearer fit (by a hundredth) after which targets count as out of reach.
PATIENCE = 25
DAMPING = 0.01
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def _features(texts: list[bytes | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each text of a pass: the distinct buckets of its words and of its runs of other signs, and its word count."""
    t = Texts([x or b"" for x in texts])
    t.buf = LOWER[t.buf]
    kinds = []
    for mask in (IS_WORD, NOT_SPACE & ~IS_WORD):
        starts, ends, first = t.words(mask)
        kinds.append(((range_hashes(t.buf, starts, ends) >> np.uint64(64 - BITS)).astype(np.uint16), first))
    buckets = [np.unique(np.concatenate([h[f[i] : f[i + 1]] for h, f in kinds])) for i in range(t.n)]
    _, _, first = t.words(NOT_SPACE)
    return buckets, np.diff(first)


def _scores(buckets: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's buckets, over the root of their number, and the last row of ``w``."""
    sizes = np.fromiter(map(len, buckets), np.int64, len(buckets))
    flat = np.concatenate([*buckets, np.zeros(1, np.uint16)])
    sums = np.add.reduceat(w[flat], np.minimum(np.cumsum(sizes) - sizes, len(flat) - 1), axis=0)
    return np.where(sizes[:, None] > 0, sums, 0) / np.sqrt(np.maximum(sizes, 1))[:, None] + w[-1]


def classifier(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Domains and weights (buckets + 1 x domains) learned from ``labelled`` (doc_id, domain) and the documents' texts."""
    named = labelled.where("doc_id is not null and domain is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("domain").alias("domain"))
    named = save(named)
    n = named.count()
    chosen = named.where((F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) / (1 << 20)) < min(1.0, sample / max(n, 1)))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(chosen, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "domain")

    def run(batches):
        for batch in batches:
            domains = batch.column("domain")
            for at, texts in passes(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at.start : at.stop], domains[at.start : at.stop], pa.array([b.tobytes() for b in _features(texts)[0]], pa.binary())], ["doc_id", "domain", "buckets"])

    small_batches(docs.sparkSession)
    got = sorted(rows.mapInArrow(run, "doc_id long, domain string, buckets binary").collect())
    names = sorted({r["domain"] for r in got})
    if not names:
        return ["all"], np.zeros(((1 << BITS) + 1, 1))
    buckets = [np.frombuffer(r["buckets"], np.uint16) for r in got]
    sizes = np.fromiter(map(len, buckets), np.int64, len(buckets))
    flat, row = np.concatenate(buckets), np.repeat(np.arange(len(got)), sizes)
    y = np.eye(len(names))[[names.index(r["domain"]) for r in got]]
    w, mean, square = np.zeros((3, (1 << BITS) + 1, len(names)))
    for step in range(1, TRAINING + 1):  # Adam
        error = (softmax(_scores(buckets, w)) - y) / len(got)
        scaled = (error / np.sqrt(np.maximum(sizes, 1))[:, None])[row]
        slope = 1e-7 * w
        for k in range(len(names)):
            slope[:-1, k] += np.bincount(flat, weights=scaled[:, k], minlength=1 << BITS)
        slope[-1] += error.sum(axis=0)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return names, w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def posteriors(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, posterior) of every document; an empty or null text has no tokens and the prior's posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in passes(batch):
                buckets, n = _features(texts)
                yield pa.RecordBatch.from_arrays([ids[at.start : at.stop], pa.array(n, pa.int64()), pa.array(list(softmax(_scores(buckets, w))), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "posterior"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("posterior")
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


def replay(p: np.ndarray, residuals: list[np.ndarray], whole: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps so far, and whether each is above its least value: 1 where the likeliest domain is in ``whole``, else 0."""
    rate = np.ones(len(p))
    least = np.isin(p.argmax(axis=1), whole).astype(np.float64)
    for residual in residuals:
        rate = np.maximum(least, rate - p @ residual)
    return rate, rate > least


def fit_rates(soft: DataFrame, targets: np.ndarray, whole: tuple[int, ...] = ()) -> tuple[list[np.ndarray], float]:
    """Residuals of all steps, and how far off the worst domain still is.

    ``targets`` are expected tokens by domain, over all tokens. Steps go on until all are met to within ``CLOSE``, or until
    ``PATIENCE`` steps bring the worst one no nearer: then no rates meet them.
    """
    k = len(targets)

    def sums(residuals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Tokens of each domain, second moments of the documents that can move and of all, all tokens."""

        def run(batches):
            reached, free, every, tokens = np.zeros(k), np.zeros((k, k)), np.zeros((k, k)), 0.0
            for batch in batches:
                p, n = _matrix(batch), np.array(batch.column("n_tokens"), np.float64)
                rate, moves = replay(p, residuals, whole)
                reached = reached + (rate * n) @ p
                free, every, tokens = free + (p * (n * moves)[:, None]).T @ p, every + (p * n[:, None]).T @ p, tokens + n.sum()
            flat = np.concatenate([reached, free.ravel(), every.ravel(), [tokens]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["at", "value"])

        rows = soft.select("n_tokens", "posterior").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        flat = np.zeros(k + 2 * k * k + 1)
        for r in rows:
            flat[r["at"]] = r["value"]
        return flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : -1].reshape(k, k), flat[-1]

    residuals: list[np.ndarray] = []
    best, waited = np.inf, 0
    while True:
        reached, free, every, tokens = sums(residuals)
        off = float(np.abs(reached / tokens - targets).max()) if tokens else 0.0
        best, waited = (off, 0) if off < 0.99 * best else (best, waited + 1)
        if off <= CLOSE or waited >= PATIENCE:
            return residuals, off
        # All documents weigh in a little, so that a step isn't long where few can move.
        moments = free + DAMPING * every if residuals else every
        residuals.append(np.linalg.pinv(moments / tokens, rcond=1e-10, hermitian=True) @ (reached / tokens - targets))


def _total(soft: DataFrame, wanted: np.ndarray, whole: tuple[int, ...]) -> float:
    """The least total, over all tokens, at which documents of ``whole`` domains keep rates of 1 and the shares ``wanted`` are met.

    Documents of a domain count by their mean posterior: once each where they are whole, then as often as the rest needs.
    """
    k = len(wanted)
    sums = [F.sum(F.col("n_tokens") * F.col("posterior")[i]).alias(str(i)) for i in range(k)]
    rows = soft.groupBy((F.array_position("posterior", F.array_max("posterior")) - 1).alias("domain")).agg(*sums).collect()
    tokens = np.zeros((k, k))
    for r in rows:
        tokens[r["domain"]] = [r[str(i)] or 0.0 for i in range(k)]
    have = tokens / max(tokens.sum(), 1)
    used = np.flatnonzero((wanted > 0) & (have.sum(axis=1) > 0))
    if not len(used):
        return 1.0
    means = have[used] / have[used].sum(axis=1, keepdims=True)
    turn = np.linalg.pinv(means[:, used].T)
    per_total, taken = turn @ wanted[used], turn @ have[list(whole)][:, used].sum(axis=0)
    return max([1.0, *(float(v / u) for u, v in zip(per_total, taken, strict=True) if u > 0)])


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], whole: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_tokens, domain (likeliest), posterior (array, by domain name), rate, off.

    off is how far the worst domain's expected tokens are from their target, over all tokens: at most ``CLOSE``, or
    more (and a warning) where no rates meet the targets.
    Domains that ``targets`` doesn't name aim at nothing; targets of domains that no label has are left out, and the
    rest add up to all tokens, or to so many that documents whose likeliest domain is in ``whole`` keep rates of 1 at least. Without labels all documents are of one domain and all rates are 1. Rows of equal
    texts have equal rates; rows without doc_id take part.
    """
    names, weights = classifier(docs, labelled)
    wanted = np.array([targets.get(n, 0.0) for n in names])
    wanted = wanted / wanted.sum() if wanted.sum() > 0 else np.full(len(names), 1 / len(names))
    soft = save(posteriors(docs, weights))
    kept = tuple(i for i, n in enumerate(names) if n in whole)
    if kept:
        wanted = wanted * _total(soft, wanted, kept)
    residuals, off = fit_rates(soft, wanted, kept)
    if off > CLOSE:
        warnings.warn(f"no rates meet the targets: a domain is {off:.4f} of all tokens off", stacklevel=2)

    def run(batches):
        for batch in batches:
            p = _matrix(batch)
            rate, _ = replay(p, residuals, kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array([names[i] for i in p.argmax(axis=1)], pa.string()), batch.column("posterior"), pa.array(rate), pa.array(np.full(len(p), off))], ["doc_id", "n_tokens", "domain", "posterior", "rate", "off"])

    return soft.mapInArrow(run, "doc_id long, n_tokens long, domain string, posterior array<double>, rate double, off double")


def copies(rate, doc_id):
    """Whole copies whose expectation over documents is the rate: its floor, and one more by a hash of doc_id."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), doc_id), F.lit(1 << 20)) / (1 << 20)
    return F.floor(rate + chance).cast("int")


def apply_mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], whole: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with every row as many times as its rate asks for (none, one or more). Columns are kept.

    Rows of one doc_id have the largest rate of its texts. Rows without doc_id stay as they are. Null and empty texts
    have no tokens and a rate from the prior.
    """
    own, of, rate, copy = free(docs.columns, "__id", "__of", "__rate", "__copy")
    rates = mix(docs.where("doc_id is not null"), labelled, targets, whole).groupBy(F.col("doc_id").alias(of)).agg(F.max("rate").alias(rate))
    joined = docs.withColumn(own, F.col("doc_id").cast("long")).join(rates, F.col(own) == F.col(of), "left")
    times = copies(F.coalesce(rate, F.lit(1.0)), F.coalesce(own, F.lit(0)))
    return joined.withColumn(copy, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select(*[F.col(f"`{c}`") for c in docs.columns])
