"""Substring dedup by content-defined chunks of words: a rolling hash sets where chunks begin, digests find what repeats.

A passage is a run of ``WORDS`` or more whole words that another document has too, whatever white space is between them.
A window of ``WORDS`` words has one seed, the smallest rolling hash of ``SEED`` words in a row within it, so equal windows have
equal seeds wherever they stand. Neighbouring windows of one seed form a chunk, some 13 windows long. Three steps, each
grouped by digest and combined before the shuffle, decide without error but for equal 64-bit digests:

1. A seed that one document has alone ends here. If all documents with a seed have one and the same chunk, it repeats.
2. Of the other chunks, those that an earlier document has whole repeat there.
3. Chunks that no earlier document has whole, but whose seed has others, are opened: each of their windows is compared.

So a passage reaches to its first and last word, and every window of it stands whole in one other document. The smallest
doc_id that has a window keeps it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.llm.common import NOT_SPACE, Texts, free, passes, range_hashes, save, sequence_hashes, small_batches, splitmix

WORDS, SEED = 51, 26  # over 50 words; a window holds as many seeds as a seed holds words
LONG = 150
_SIGN = (splitmix(256, 0x6EA4) & np.uint64(0xFFFF)).astype(np.int64)
_SHIFT = 31  # place = start << 31 | length


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a pass, and for each text where its first word is in them.

    Words are runs of anything but white space; each ideograph and kana is one. Runs of over ``LONG`` bytes without white
    space are parted by the characters in them, every three bytes or so.
    """
    starts, ends, _ = t.words(NOT_SPACE)
    buf, inner = t.buf, np.zeros(len(t.buf) + 3, bool)
    lead = np.flatnonzero((buf >= 0xE3) & (buf <= 0xE9))  # three bytes each
    inner[lead] = inner[lead + 3] = True
    for k in np.flatnonzero(ends - starts > LONG):
        a, b = starts[k] + 4, ends[k]
        one, two, three, four = (buf[a - i : b - i] for i in (1, 2, 3, 4))
        parted = ((_SIGN[one] + 3 * _SIGN[two] // 2) % 3 == 0) | ((one == three) & (two == four))
        inner[a:b] |= parted & (buf[a:b] & 0xC0 != 0x80)
    inner = inner[: len(buf)] & NOT_SPACE[buf]
    inner[starts] = False
    cuts = np.flatnonzero(inner)
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.append(np.searchsorted(starts, t.starts), len(starts))


def _chunk_pass(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """Of the texts of a pass: seed, digest, text number, start in its text, length of every chunk."""
    t = Texts([x or b"" for x in texts])
    starts, ends, first = words(t)
    if len(starts) < WORDS:
        return (*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 3)
    hashes = range_hashes(t.buf, starts, ends)
    at = np.arange(len(starts) - SEED + 1)
    seeds = sequence_hashes(hashes, at, at + SEED)
    for far in (1, 2, 4, 8, SEED - 16):  # the smallest of SEED neighbours
        seeds = np.minimum(seeds[:-far], seeds[far:])
    number = np.repeat(np.arange(t.n), np.diff(first))
    whole = number[: len(seeds)] == number[WORDS - 1 :]
    same = whole[1:] & whole[:-1] & (seeds[1:] == seeds[:-1])
    begin = np.flatnonzero(whole & ~np.concatenate([[False], same]))
    last = np.flatnonzero(whole & ~np.concatenate([same, [False]])) + WORDS
    return seeds[begin], sequence_hashes(hashes, begin, last), number[begin], starts[begin] - t.starts[number[begin]], ends[last - 1] - starts[begin]


def _rows(*columns: np.ndarray, names: list[str]):
    for i in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000].view(np.int64)) for c in columns], names)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's digest, which tells rows of one doc_id apart."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    return rows.withColumn("text_id", F.xxhash64("text"))


def chunks(keyed: DataFrame) -> DataFrame:
    """(seed, digest, doc_id, text_id, place) of every chunk of every text; place holds start and length in bytes."""

    def run(batches):
        for batch in batches:
            ids, text_ids = (np.array(batch.column(c), np.int64) for c in ("doc_id", "text_id"))
            for at, texts in passes(batch):
                seed, digest, number, start, length = _chunk_pass(texts)
                yield from _rows(seed, digest, ids[at][number], text_ids[at][number], (start << _SHIFT) | length, names=["seed", "digest", "doc_id", "text_id", "place"])

    small_batches(keyed.sparkSession)
    return keyed.mapInArrow(run, "seed long, digest long, doc_id long, text_id long, place long")


def _windows(opened: DataFrame) -> DataFrame:
    """(digest, doc_id, text_id, place) of every window of the chunks at ``places``."""
    mask = (1 << _SHIFT) - 1

    def run(batches):
        for batch in batches:
            ids, text_ids, places = batch.column("doc_id"), batch.column("text_id"), batch.column("places")
            for at, texts in passes(batch):
                t = Texts([x or b"" for x in texts])
                starts, ends, _ = words(t)
                hashes = range_hashes(t.buf, starts, ends)
                for k in range(t.n):
                    place = np.array(places[at.start + k].as_py(), np.int64)
                    a, b = np.searchsorted(starts, t.starts[k] + (place >> _SHIFT)), np.searchsorted(ends, t.starts[k] + (place >> _SHIFT) + (place & mask))
                    n = b + 1 - a - (WORDS - 1)
                    i = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    own = (starts[i] - t.starts[k] << _SHIFT) | (ends[i + WORDS - 1] - starts[i])
                    doc, text = (np.full(len(i), c[at.start + k].as_py(), np.int64) for c in (ids, text_ids))
                    yield from _rows(sequence_hashes(hashes, i, i + WORDS), doc, text, own, names=["digest", "doc_id", "text_id", "place"])

    return opened.mapInArrow(run, "digest long, doc_id long, text_id long, place long")


def _merged(found: list[tuple[int, int, int]]):
    """(start, end, document that has most of it first, all first documents) of each row of overlapping (start, end, first)."""
    start = end = 0
    sizes: dict[int, int] = {}
    for a, b, first in [*sorted(found), (1 << 62, 1 << 62, 0)]:
        if a >= end:
            if sizes:
                yield start, end, max(sizes, key=lambda f: (sizes[f], -f)), sorted(sizes)
            start, end, sizes = a, a, {}
        sizes[first] = sizes.get(first, 0) + max(0, b - end)
        end = max(end, b)


def _spans(batches):
    mask = (1 << _SHIFT) - 1
    for batch in batches:
        out = []
        for doc, text, places, firsts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_id", "places", "firsts")), strict=True):
            found = [(p >> _SHIFT, (p >> _SHIFT) + (p & mask), f) for p, f in zip(places, firsts, strict=True)]
            for kept in (False, True):
                out += [(doc, text, *span, kept) for span in _merged([x for x in found if (x[2] == doc) == kept])]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "text_id", "start_byte", "end_byte", "first_doc_id", "first_doc_ids", "kept"])


def _found(docs: DataFrame) -> DataFrame:
    """The rows of ``repeated_spans``, with text_id."""
    keyed, key = _keyed(docs), ["doc_id", "text_id"]
    ends = F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
    cut = save(chunks(keyed))
    seeds = save(cut.groupBy("seed").agg(*ends, (F.min("digest") < F.max("digest")).alias("mixed")).where("first < last").drop("last"))
    hits = save(cut.join(seeds, "seed").drop("seed"))
    mixed = hits.where("mixed").drop("first", "mixed")
    whole = save(mixed.join(save(mixed.groupBy("digest").agg(*ends)), "digest").drop("digest"))
    places = whole.where("first = doc_id").groupBy(*key).agg(F.collect_set("place").alias("places"))
    windows = save(_windows(keyed.join(places, key)))
    parts = windows.join(save(windows.groupBy("digest").agg(*ends).where("first < last").drop("last")), "digest")
    columns = [*key, "place", "first"]
    found = hits.where("not mixed").select(columns).union(whole.where("first < last").select(columns)).union(parts.select(columns))
    by_doc = found.groupBy(*key).agg(F.collect_set(F.struct("place", "first")).alias("h")).select(*key, F.col("h.place").alias("places"), F.col("h.first").alias("firsts"))
    return by_doc.mapInArrow(_spans, "doc_id long, text_id long, start_byte long, end_byte long, first_doc_id long, first_doc_ids array<long>, kept boolean")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per passage that repeats across documents, its first place included.

    doc_id, start_byte, end_byte (in the text's UTF-8 bytes), first_doc_id (the document that is the first to have most
    of it), first_doc_ids (those of all its windows), kept (no earlier document has it). What isn't kept is kept in an
    earlier document. Passages that overlap are one row, but kept and other ones are apart and may overlap. Null texts and
    rows without doc_id have none; a passage in two rows of one doc_id alone doesn't repeat.
    """
    return _found(docs).drop("text_id")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of every document but the first that has them.

    A document that is left without any word goes. Cuts never part a UTF-8 character. Rows are cut by doc_id and text, so
    that rows of one doc_id with other texts are cut each by its own spans; null texts and rows without doc_id stay as they are.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column(held).to_pylist()):
                if not spans:
                    continue
                raw, at, left = texts[i].encode(), 0, []
                for a, b in sorted((s["start_byte"], s["end_byte"]) for s in spans):
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    if a > at:
                        left.append(raw[at:a])
                    at = max(at, b)
                left.append(raw[at:])
                texts[i] = b" ".join(x for x in left if x).decode()
            kept = pa.array([t is None or s is None or bool(t.strip()) for t, s in zip(texts, batch.column(held).to_pylist(), strict=True)])
            out = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))
            yield out.select(columns).filter(kept)

    columns = docs.columns
    doc, text, held = free(columns, "__doc_id", "__text_id", "__spans")
    spans = _found(docs).where("not kept").groupBy(F.col("doc_id").alias(doc), F.col("text_id").alias(text)).agg(F.collect_list(F.struct("start_byte", "end_byte")).alias(held))
    joined = docs.join(spans, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text)), "left").drop(doc, text)
    return joined.mapInArrow(run, docs.schema)
