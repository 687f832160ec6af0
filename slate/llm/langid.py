"""Language ID as inference of a mixture: EM gives each document's language proportions.

A language is a distribution over hashed byte trigrams of lower-cased text, learned from a bounded sample of labelled
documents (about ``SAMPLE`` a language, chosen by a hash of doc_id; trigram counts are summed by Spark). A document's
trigrams are drawn from a mixture of languages; EM finds the proportions, and the set of languages is pruned from the
least one on while the likelihood, less ``PENALTY * log(trigrams)`` for each language, does not fall.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slate.llm.common import LOWER, passes, small_batches

BUCKETS, SAMPLE, PENALTY = 4096, 2000, 2.0
#: Rounds of EM at first and after a language left; above so many languages all but the largest leave at once, if the likelihood allows it.
ROUNDS, AGAIN, FEW = 12, 5, 8
_LETTER = regex.compile(r"\p{L}")


def trigrams(text: bytes) -> np.ndarray:
    """Counts of the hashed byte trigrams of a text, with a blank before and after it."""
    b = LOWER[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.float32)
    codes = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return np.bincount((codes * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=BUCKETS).astype(np.float32)


def learn(docs: DataFrame, labelled: Column, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """All languages that occur, and the smoothed trigram distribution of each (languages x buckets).

    Rows without text or lang teach nothing; of repeated rows each counts.
    """
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return [], np.zeros((0, BUCKETS))
    share = F.element_at(F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, sample / r["count"]))]), F.col("lang"))
    drawn = (F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / (1 << 20)) < share

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, texts in passes(batch):
                for lang, text in zip(langs[at], texts, strict=True):
                    sums[lang] = sums.get(lang, 0) + trigrams(text).astype(np.float64)
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(total[some], pa.float64())], ["lang", "bucket", "n"])

    small_batches(docs.sparkSession)
    sums = rows.where(drawn).mapInArrow(run, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    found = np.array(sums.column("lang").to_pylist(), object)
    names = sorted(set(found))
    table = np.full((len(names), BUCKETS), 0.5)
    if names:
        table[np.searchsorted(np.array(names, object), found), np.array(sums.column("bucket"))] += np.array(sums.column("n"))
    return names, table / table.sum(axis=1, keepdims=True)


def _em(counts: np.ndarray, like: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds of EM, and the log-likelihood that they reach."""
    n = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        share = share * ((counts / np.maximum(share @ like, 1e-30)) @ like.T) / n
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
    return share, (counts * np.log(np.maximum(share @ like, 1e-30))).sum(axis=1)


def mixtures(counts: np.ndarray, like: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of each document (rows of ``counts``), zero for languages not in its set."""
    m, k = len(counts), len(like)
    share, fit = _em(counts, like, np.full((m, k), 1 / k, np.float32), ROUNDS)
    cost = penalty * np.log(np.maximum(counts.sum(axis=1), 2))
    if k > FEW:
        few = np.where(share >= np.partition(share, k - FEW, axis=1)[:, [k - FEW]], share, 0)
        few, fits = _em(counts, like, few / few.sum(axis=1, keepdims=True), AGAIN)
        better = fits + cost * (share > 0).sum(axis=1) >= fit + cost * (few > 0).sum(axis=1)
        share[better], fit[better] = few[better], fits[better]
    live = np.arange(m)
    for _ in range(k - 1):
        live = live[(share[live] > 0).sum(axis=1) > 1]
        if not len(live):
            break
        fewer = share[live]
        least = np.where(fewer > 0, fewer, np.inf).argmin(axis=1)
        fewer[np.arange(len(live)), least] = 0
        fewer /= fewer.sum(axis=1, keepdims=True)
        fewer, fits = _em(counts[live], like, fewer, AGAIN)
        better = fits + cost[live] >= fit[live]
        live = live[better]
        share[live], fit[live] = fewer[better], fits[better]
    return share


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score, languages): the largest proportion's language, that proportion, and the whole set.

    ``und`` with score 0 and no languages where the text is null or has no letter, or nothing was learned. Ties go to
    the language that sorts first. Rows are judged one by one: repeated rows get equal answers.
    """
    names, table = model
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))  # 16 KB a language

    def run(batches):
        like = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in passes(batch):
                lettered = [bool(names) and t is not None and bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts]
                rows = np.flatnonzero(lettered)
                pred, score, sets = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
                for a in range(0, len(rows), 64):
                    part = rows[a : a + 64]
                    share = mixtures(np.stack([trigrams(texts[i]) for i in part]), like)
                    for i, own in zip(part, share, strict=True):
                        best = int(own.argmax())
                        pred[i], score[i] = names[best], min(1.0, float(own[best]))
                        sets[i] = [n for n, s in zip(names, own, strict=True) if s > 0]
                yield pa.RecordBatch.from_arrays([ids[at.start : at.stop], pa.array(pred), pa.array(score), pa.array(sets, pa.list_(pa.string()))], ["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>")


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from (a null doc_id is one of them)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of every document.

    A null or empty text is ``und``; a row without doc_id counts as held out; repeated rows get equal answers; an
    empty table gives none.
    """
    found = predict(docs, learn(docs, ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")


def accepted(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """``docs`` without those that have no language, or none that makes up ``least`` of them. Columns are kept.

    Null texts and those without a letter go; rows without doc_id and repeated rows are judged like any other. Without
    languages to learn from all go.
    """
    names, table = learn(docs, ~held_out(F.col("doc_id")))
    columns, schema = docs.columns, docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def run(batches):
        like = shared.value
        for batch in batches:
            for at, texts in passes(batch):
                keep = np.array([bool(names) and t is not None and bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts])
                rows = np.flatnonzero(keep)
                for a in range(0, len(rows), 64):
                    part = rows[a : a + 64]
                    keep[part] = mixtures(np.stack([trigrams(texts[i]) for i in part]), like).max(axis=1) >= least
                yield batch.slice(at.start, at.stop - at.start).select(columns).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
