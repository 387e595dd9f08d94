"""Repeated passages, found by difference-cover anchors.

Of each document only the windows of WINDOW - PERIOD + 1 words that start at a cover position modulo PERIOD are hashed:
{0, 1, 3, 9} holds every difference modulo 13, so two equal passages of WINDOW words, wherever they start, have cover
positions at equal offsets below 13, and the windows there, which lie within the passages, meet. Around anchors that
meet, the passages are compared in full: in stretches first, cut where the content says so, so that what is copied
at length needs one row a stretch; then, in stretches that are the first of their kind, passage by passage.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, runs_of, sub_batches, window_hashes, word_hashes

PERIOD, COVER = 13, (0, 1, 3, 9)
#: A stretch has so many passages on average.
STRETCH = 16
#: Rows that repeat a doc_id with another text are told apart by so many bits of the text's hash, beside the start.
TAG_BITS, TAG_MASK = 15, 0x7FFF
#: Anchors meet under so many bits, which is what is shuffled most; one that meets another by chance costs a comparison.
ANCHOR_MASK = np.uint64(2**48 - 1)
#: Texts are worked on in batches of so many bytes.
BATCH_BYTES = 16 << 20
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def words_and_hashes(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    split = [t.split() for t in texts]
    hashes, at = word_hashes([w for ws in split for w in ws]), 0
    for ws in split:
        yield ws, hashes[at : at + len(ws)]
        at += len(ws)


def compressed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, body, tag, size): what documents are shuffled as, each text compressed by itself."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        bodies = pa.array((zlib.compress(t.as_py(), 1) for t in texts), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), bodies, batch.column(2), pc.binary_length(texts)], ["doc_id", "body", "tag", "size"])


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of compressed_rows cut so that their texts, not only what they are compressed to, have bounded bytes."""
    for batch in batches:
        for low, high in runs_of(batch.column(3).to_numpy(), BATCH_BYTES):
            yield batch.slice(low, high - low)


def texts_of(bodies: pa.Array) -> Iterable[bytes]:
    """The texts of compressed_rows, one at a time."""
    return (zlib.decompress(body.as_py()) for body in bodies)


def anchor_rows(size: int) -> Callable:
    """(key, doc_id, ref): ref holds the position and whether the batch alone shows that the anchor is repeated.

    Of equal anchors in a batch, the first goes to its key and the others, known to be repeated, to keys of their own:
    a passage that a third of all documents share brings a key one row for each batch.
    """
    short = size - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, places, k = [], [], [], 0
            for texts in sub_batches(batch.column(1).cast(pa.binary()).to_pylist()):
                for _, words in words_and_hashes(texts):
                    if len(words) >= size:
                        at = (np.arange(0, len(words) - short + 1, PERIOD)[:, None] + COVER).ravel()
                        at = at[at <= len(words) - short]
                        keys.append(window_hashes(words, short, FACTORS[0])[at])
                        docs.append(np.full(len(at), k))
                        places.append(at)
                    k += 1
            if not keys:
                continue
            key, doc, place = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
            order = np.argsort(key, kind="stable")
            equal = key[order[1:]] == key[order[:-1]]
            later, known = order[1:][equal], np.zeros(len(key), bool)
            known[later] = True
            known[order[:-1][equal]] = True
            key[later] = mixed(key[later] ^ (doc[later].astype(np.uint64) << np.uint64(40)) ^ place[later].astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
            ref = place << 1 | known
            for a in range(0, len(key), 500_000):
                part = slice(a, a + 500_000)
                yield pa.RecordBatch.from_arrays([pa.array((key[part] & ANCHOR_MASK).view(np.int64)), batch.column(0).take(pa.array(doc[part])), pa.array(ref[part])], ["key", "doc_id", "ref"])

    return run


def tags_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)


def own_spans(spans: pa.ListScalar, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the spans that belong to the row with this tag; spans of length 0 say nothing."""
    if not spans.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ref, length = (np.asarray(spans.values.field(name)).astype(np.int64) for name in ("ref", "length"))
    own = ((ref & TAG_MASK) == tag) & (length > 0)
    return ref[own] >> TAG_BITS, length[own]


def passage_hashes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return window_hashes(words, size, FACTORS[0]), window_hashes(words, size, FACTORS[1])


def stretch_rows(size: int) -> Callable:
    """(c1, c2, doc_id, ref, length): the passages around repeated anchors, in stretches with a digest of all their hashes.

    Of equal stretches in a batch, the earliest goes to its key; the others, which can't be first anywhere, go to keys
    of their own and have a negative length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found, at, tags, k = [], batch.column(4), tags_of(batch), 0
            for texts in sub_batches(texts_of(batch.column(1))):
                for _, words in words_and_hashes(texts):
                    n = len(words) - size + 1
                    change = np.zeros(max(0, n) + 1, np.int64)
                    place = np.unique(np.asarray(at[k].values))
                    place = place[place < n + PERIOD - 1]  # a row with the same id may be longer
                    k += 1
                    if not len(place):
                        continue
                    np.add.at(change, np.maximum(place - (PERIOD - 1), 0), 1)
                    np.add.at(change, np.minimum(place, n - 1) + 1, -1)
                    near = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                    h1, h2 = passage_hashes(words, size)
                    h1, h2 = h1[near], h2[near]
                    cut = (h1 % np.uint64(STRETCH)) == 0
                    cut[0] = True
                    cut[1:] |= near[1:] != near[:-1] + 1
                    begin = np.flatnonzero(cut)
                    length = np.diff(np.append(begin, len(near)))
                    inner = (np.arange(len(near)) - np.repeat(begin, length)).astype(np.uint64) * np.uint64(FACTORS[1]) + np.uint64(1)
                    c1, c2 = (mixed(np.add.reduceat(mixed(h + inner), begin) + length.astype(np.uint64)) for h in (h1, h2))
                    found.append((c1, c2, np.full(len(begin), k - 1), near[begin] << TAG_BITS | tags[k - 1], length))
            if found:
                c1, c2, doc, ref, length = map(np.concatenate, zip(*found, strict=True))
                rank = pc.rank(batch.column(0), tiebreaker="dense").to_numpy().astype(np.int64)[doc]
                order = np.lexsort((ref, rank, c2, c1))
                opens = np.append(True, (c1[order[1:]] != c1[order[:-1]]) | (c2[order[1:]] != c2[order[:-1]]))
                leader = np.empty(len(order), np.int64)  # rows stay in their order: neighbours share most bytes
                leader[order] = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
                later = (rank != rank[leader]) | (ref >> TAG_BITS != ref[leader] >> TAG_BITS)
                c1 = np.where(later, mixed(c1 ^ (doc.astype(np.uint64) << np.uint64(40)) ^ ref.astype(np.uint64)), c1)
                length, names = np.where(later, -length, length).astype(np.int32), batch.column(0).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), names, pa.array(ref), pa.array(length)], ["c1", "c2", "doc_id", "ref", "length"])

    return run


def passage_rows(size: int) -> Callable:
    """(h1, h2, doc_id, ref): the passages of some stretches, with 64 and 20 bits of hash.

    Of equal passages in a batch, the earliest goes to its key; the others, which can't be first anywhere, go to keys of
    their own and have a negative h2: a line that a third of all documents share brings a key one row for each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found, spans, tags, k = [], batch.column(4), tags_of(batch), 0
            for texts in sub_batches(texts_of(batch.column(1))):
                for _, words in words_and_hashes(texts):
                    h1, h2 = passage_hashes(words, size)
                    start, length = own_spans(spans[k], tags[k])
                    at = np.repeat(start - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
                    found.append((h1[at].view(np.int64), (h2[at] >> np.uint64(44)).astype(np.int32), np.full(len(at), k), at << TAG_BITS | tags[k]))
                    k += 1
            if found:
                h1, h2, doc, ref = map(np.concatenate, zip(*found, strict=True))
                rank = pc.rank(batch.column(0), tiebreaker="dense").to_numpy().astype(np.int64)[doc]
                order = np.lexsort((ref >> TAG_BITS, rank, h2, h1))
                opens = np.append(True, (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]]))
                leader = np.empty(len(order), np.int64)  # rows stay in their order: neighbours share most bytes
                leader[order] = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
                later = (rank != rank[leader]) | (ref >> TAG_BITS != ref[leader] >> TAG_BITS)
                h1 = np.where(later, mixed(h1.view(np.uint64) ^ (doc.astype(np.uint64) << np.uint64(40)) ^ ref.astype(np.uint64)).view(np.int64), h1)
                h2 = np.where(later, -1, h2).astype(np.int32)
                for a in range(0, len(h1), 500_000):
                    part = slice(a, a + 500_000)
                    yield pa.RecordBatch.from_arrays([pa.array(h1[part]), pa.array(h2[part]), batch.column(0).take(pa.array(doc[part])), pa.array(ref[part])], ["h1", "h2", "doc_id", "ref"])

    return run


def removal_rows(size: int, keep_text: bool) -> Callable:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            spans, tags, k, rows = batch.column(4), tags_of(batch), 0, []
            for texts in sub_batches(texts_of(batch.column(1))):
                for text in texts:
                    words, gone = text.split(), 0
                    n = len(words)
                    start, length = own_spans(spans[k], tags[k])
                    if len(start):
                        change = np.zeros(n + 1, np.int64)
                        np.add.at(change, start, 1)
                        np.add.at(change, start + length + size - 1, -1)
                        stay = np.cumsum(change[:-1]) == 0
                        gone = n - int(stay.sum())
                        words = [w for w, s in zip(words, stay, strict=True) if s]
                    kept = b" ".join(words)
                    rows.append((n, gone, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "surrogatepass")] * keep_text))
                    k += 1
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.string()] * keep_text]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names)

    return run


def first_of(*keys: str) -> Column:
    """Whether a row starts at the smallest (doc_id, start) of the rows with its keys; reads a hot key row by row."""
    order = Window.partitionBy(*keys).orderBy("doc_id", "ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = lambda ref: F.shiftright(ref, TAG_BITS)
    return (F.first("doc_id").over(order) == F.col("doc_id")) & (start(F.first("ref").over(order)) == start(F.col("ref")))


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): every row of df without the words of repeated passages.

    A passage is `window` (over 12) consecutive words, split at ASCII white space and otherwise unchanged, of one
    document. Each word goes that a passage covers whose words also start earlier: in a document with a smaller
    doc_id, or in the same one earlier. Passages are judged on the input. Kept words are joined by one space. Null texts have no
    words. Rows without doc_id lose nothing and make nothing go. Rows with equal doc_id count as one document: none
    makes the other's words go at the same place. Extra columns are dropped. Passages are equal if 84 bits of hash
    are. All steps are one plan over one exchange of the documents, compressed, which its three joins share.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")
    kind = df.schema[doc_id].dataType.simpleString()
    name = F.col(doc_id) if doc_id == "doc_id" else F.col(doc_id).alias("doc_id")  # an alias that renames nothing would keep the exchange from being shared
    every = df.select(name, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text").bitwiseAND(TAG_MASK).cast("short"))
    docs = every.where("doc_id is not null")
    packed = lambda rows: rows.mapInArrow(compressed_rows, f"doc_id {kind}, body binary, tag short, size int")
    held = packed(docs)
    span, spans = F.struct("ref", "length"), "array<struct<ref:bigint,length:int>>"

    anchors = docs.select("doc_id", "text").mapInArrow(anchor_rows(window), f"key long, doc_id {kind}, ref long")
    same = Window.partitionBy("key").orderBy("key")
    twice = anchors.withColumn("n", F.row_number().over(same)).withColumn("next", F.lead(F.lit(1)).over(same)).where((F.col("ref").bitwiseAND(1) == 1) | (F.col("n") > 1) | F.col("next").isNotNull())
    twice = twice.groupBy("doc_id").agg(F.collect_list(F.shiftright("ref", 1).cast("int")).alias("at"))
    around = held.join(twice, "doc_id").select("doc_id", "body", "tag", "size", "at")

    stretches = around.mapInArrow(stretch_rows(window), f"c1 long, c2 long, doc_id {kind}, ref long, length int").withColumn("first", first_of("c1", "c2") & (F.col("length") > 0))
    fresh = stretches.where("first").groupBy("doc_id").agg(F.collect_list(span).alias("spans"))
    passages = held.join(fresh, "doc_id").select("doc_id", "body", "tag", "size", "spans").mapInArrow(passage_rows(window), f"h1 long, h2 int, doc_id {kind}, ref long")
    again = passages.withColumn("first", first_of("h1", "h2") & (F.col("h2") >= 0)).where("not first").select("doc_id", "ref", F.lit(1).alias("length"))

    # an empty span for each document makes this an inner join too, which reads the same exchange
    none = docs.select("doc_id", F.lit(0).cast("long").alias("ref"), F.lit(0).alias("length"))
    gone = stretches.where("not first").select("doc_id", "ref", F.abs("length").alias("length")).union(again).union(none).groupBy("doc_id").agg(F.collect_list(span).alias("spans"))
    judged = held.join(gone, "doc_id").select("doc_id", "body", "tag", "size", "spans")
    judged = judged.union(packed(every.where("doc_id is null")).select("doc_id", "body", "tag", "size", F.lit(None).cast(spans)))
    return judged.mapInArrow(removal_rows(window, keep_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)
