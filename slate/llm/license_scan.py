"""License scans by a positional index of rare words.

A template is a licence's text, or a notice, with mandatory key phrases. Of each key phrase the highest-IDF words (document
frequencies over the whole corpus; ``FILED`` words a template, one a phrase at least) are filed with their positions. A
file's words are looked up there: each posting says where in the file its phrase would begin, and the postings of a phrase
are intersected by that beginning. As every filed word belongs to a mandatory phrase, no copy is lost by it. What is left must hold all words
of the phrase; a template's phrases must stand in their order, each at its distance from the first to within ``SLACK``
words; and of the template's words at least ``COVER`` must be there, in the places that the phrase before them gives, or
in a long text at least in their order. The three base
phrases are templates that are their own key phrase: all their places are found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.llm.common import LOWER, Texts, passes, range_hashes, small_batches
from slate.llm.license_texts import NOTICES, WHOLE

FILED, COVER, SLACK = 4, 0.8, 24
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


def phrase(label: str, text: str, base: bool = False) -> Template:
    """A template that is its own key phrase."""
    return Template(label, text, (text,), base)


BASE = (phrase("cc-by", "cc by", True), phrase("gpl", "general public license", True), phrase("reserved", "all rights reserved", True))
OWN = tuple(Template(*t) for t in WHOLE) + tuple(phrase(*t) for t in NOTICES)


def _hashes(text: str) -> np.ndarray:
    return _words([text.encode()])[0]


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    t = Texts([x or b"" for x in texts])
    t.buf = LOWER[t.buf]
    starts, ends, first = t.words(IS_WORD)
    return range_hashes(t.buf, starts, ends), first


def document_frequencies(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """In how many texts each of the sorted word hashes occurs."""

    def run(batches):
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for _, texts in passes(batch):
                hashes, first = _words(texts)
                at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                hit = np.flatnonzero(words[at] == hashes)
                doc = np.searchsorted(first, hit, side="right") - 1
                total += np.bincount(np.unique(doc * len(words) + at[hit]) % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words)), pa.int32()), pa.array(total)], ["word", "n"])

    out = np.zeros(len(words), np.int64)
    small_batches(docs.sparkSession)
    for r in docs.select(F.col("text").cast("string")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


@dataclass(frozen=True)
class _Key:
    """A mandatory phrase: its words, its place in the template, and (word in the index, place in the phrase) of those filed."""

    words: np.ndarray
    place: int
    filed: tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class _Plan:
    words: np.ndarray
    keys: tuple[_Key, ...]


def _index(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[np.ndarray, list[_Plan]]:
    """The sorted words that are filed, and where each template has them."""
    hashed = [(_hashes(t.text), [_hashes(k) for k in t.keys]) for t in templates]
    vocabulary = np.unique(np.concatenate([k for _, keys in hashed for k in keys]))
    df = dict(zip(vocabulary.tolist(), document_frequencies(docs, vocabulary).tolist(), strict=True))
    rare: list[list[tuple[np.ndarray, int, list[int]]]] = []
    for own, keys in hashed:
        rows, after = [], 0
        for key in keys:
            place = next(k for k in range(after, len(own) - len(key) + 1) if (own[k : k + len(key)] == key).all())
            after = place + len(key)
            rows.append((key, place, sorted(range(len(key)), key=lambda k, key=key: (df[int(key[k])], k))))
        rare.append([(key, place, order[: max(1, FILED // len(keys))]) for key, place, order in rows])
    index = np.unique(np.array([key[k] for rows in rare for key, _, order in rows for k in order], np.uint64))
    at = {int(h): i for i, h in enumerate(index)}
    return index, [_Plan(own, tuple(_Key(key, place, tuple((at[int(key[k])], k) for k in order)) for key, place, order in rows)) for (own, _), rows in zip(hashed, rare, strict=True)]


def _placed(i: int, plan: _Plan, found: list[np.ndarray], hashes: np.ndarray, first: np.ndarray):
    """Places of a template whose phrases stand at ``found``: one phrase after the other, near where the first says."""
    starts, keep = [found[0]], np.ones(len(found[0]), bool)
    for key, places in zip(plan.keys[1:], found[1:], strict=True):
        wanted = starts[0] + key.place - plan.keys[0].place
        at = np.searchsorted(places, wanted)
        low, high = places[np.maximum(at - 1, 0)], places[np.minimum(at, len(places) - 1)]
        nearest = np.where(np.abs(low - wanted) <= np.abs(high - wanted), low, high)
        keep &= (np.abs(nearest - wanted) <= SLACK) & (nearest > starts[-1])
        starts.append(nearest)
    starts = [s[keep] for s in starts]
    doc = np.searchsorted(first, starts[0], side="right") - 1
    by = np.maximum(np.searchsorted([k.place for k in plan.keys], np.arange(len(plan.words)), side="right") - 1, 0)
    spots = np.stack(starts, axis=1)[:, by] + np.arange(len(plan.words)) - np.array([k.place for k in plan.keys])[by]
    inside = (spots >= first[doc][:, None]) & (spots < first[doc + 1][:, None])
    share = (inside & (hashes[np.clip(spots, 0, len(hashes) - 1)] == plan.words)).mean(axis=1)
    for s, d, c in zip(starts[0] - plan.keys[0].place, doc, share, strict=True):
        if c < COVER and len(plan.words) > SLACK:  # a longer text with words put in or left out
            c = _in_order(plan.words, hashes[max(first[d], s - SLACK) : min(first[d + 1], s + len(plan.words) + SLACK)])
        if c >= COVER:
            yield i, int(d), int(s - first[d]), float(c)


def _in_order(words: np.ndarray, window: np.ndarray) -> float:
    """Share of the words that the window has in their order (longest common subsequence)."""
    best = np.zeros(len(window) + 1, np.int64)
    for w in words:
        found = best.copy()
        found[1:] = np.maximum(best[1:], best[:-1] + (window == w))
        best = np.maximum.accumulate(found)
    return best[-1] / len(words)


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + OWN) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of all base phrases; first_word and last_word are their smallest and largest starts in
    words from 0, null without any. Labels are distinct, sorted and joined by commas, empty without any. score is the
    best share of a labelled template's words found in place (1 for base phrases), 0 without labels. A null text
    counts as empty; rows are judged one by one.
    """
    index, plans = _index(docs, templates)

    def look_up(hashes: np.ndarray, first: np.ndarray):
        """(template, document, start, share of its words in place) of every place that passes."""
        at = np.minimum(np.searchsorted(index, hashes), len(index) - 1)
        hit = np.flatnonzero(index[at] == hashes)
        word = at[hit]
        there = set(np.unique(word).tolist())
        for i, plan in enumerate(plans):
            found = []
            for key in plan.keys:
                if not there.issuperset(w for w, _ in key.filed):
                    break
                starts = None
                for w, offset in key.filed:
                    begins = hit[word == w] - offset
                    starts = begins if starts is None else np.intersect1d(starts, begins, assume_unique=True)
                starts = starts[(starts >= 0) & (starts + len(key.words) <= len(hashes))]
                starts = starts[first[np.searchsorted(first, starts, side="right")] >= starts + len(key.words)]
                for k, h in enumerate(key.words):
                    starts = starts[hashes[starts + k] == h]
                if not len(starts):
                    break
                found.append(starts)
            else:
                yield from _placed(i, plan, found, hashes, first)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in passes(batch):
                hashes, first = _words(texts)
                n = len(texts)
                starts, base_labels, labels, score = [[] for _ in range(n)], [set() for _ in range(n)], [set() for _ in range(n)], [0.0] * n
                for i, d, s, c in look_up(hashes, first) if len(hashes) else ():
                    labels[d].add(templates[i].label)
                    score[d] = max(score[d], c)
                    if templates[i].base:
                        starts[d].append(s)
                        base_labels[d].add(templates[i].label)
                columns = [
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(map(len, starts), pa.int64()),
                    pa.array([min(s, default=None) for s in starts], pa.int64()),
                    pa.array([max(s, default=None) for s in starts], pa.int64()),
                    pa.array([",".join(sorted(v)) for v in base_labels]),
                    pa.array([",".join(sorted(v)) for v in labels]),
                    pa.array(score),
                ]
                yield pa.RecordBatch.from_arrays([ids[at.start : at.stop], *columns], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
