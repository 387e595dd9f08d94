"""Packing documents into token sequences with minimum bin slack.

Documents are cut into full windows and a remainder. How often each remaining length occurs is a table of at most
`capacity` rows whatever the corpus, and all windows are chosen from it: each takes the longest length left and, by
subset sums held as bits of an integer, the multiset of other lengths that comes closest to the capacity; the same
multiset is used as often as the counts allow, so a length runs out with each choice and a few thousand choices
fill any number of windows. Pieces then find their place by their rank among the pieces of equal length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, runs_of
from .tokens import UNSURE, load_tokenizer


def fill(lengths: dict[int, int], gap: int) -> dict[int, int]:
    """Counts of the lengths (of which `lengths` has so many) whose total comes closest to the gap without passing it."""
    mask, stages, reached = (1 << (gap + 1)) - 1, [], 1
    for length in sorted((n for n in lengths if n <= gap), reverse=True):
        left, step = min(lengths[length], gap // length), 1
        while left and not reached >> gap & 1:
            take = min(step, left)
            stages.append((reached, length, take))
            reached |= reached << (take * length) & mask
            left, step = left - take, step * 2
        if reached >> gap & 1:
            break
    total, chosen = reached.bit_length() - 1, {}
    for before, length, take in reversed(stages):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return chosen


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(counts of lengths in a window, windows filled so), until every length is used up."""
    left, plan = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fill({n: c for n, c in left.items() if c}, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.append((chosen, times))
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """For each length and window kind: the ranks placed there, how many in a window, and where they begin."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            k = chosen[length]
            first = used.get(length, 0)
            used[length] = first + k * times
            rows.append((length, first, used[length], k, sequence, offset))
            offset += k * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first_rank", "end_rank", "in_window", "first_sequence", "first_offset"]).astype("int64")


#: The fixed pattern by which such a tokenizer cuts: letters, single digits and runs of other marks stay apart.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = ".,;:!?"
#: Letters before which and after which a tokenizer cuts marks off, and which don't change by their neighbours.
LETTERS = pa.array([c for c in map(chr, range(0x250)) if c.isalpha()])
#: Stands between words that are encoded together.
BETWEEN, TOGETHER = ";", 128
#: Bytes of the texts whose words a task tells apart at once, and of those whose ids it makes at once (or one longer
#: text). The first are looked up by their distinct words, which are fewer the more texts there are; the arrays of the
#: second take some twenty times as much.
RUN_BYTES, PART_BYTES = 8_000_000, 1_000_000


def cuts_at_marks(tokenizer) -> bool:
    """Whether a tokenizer lower-cases, changes nothing else of ASCII words, and cuts by CUT."""
    found = json.loads(tokenizer.to_str())
    norms = found["normalizer"] or {}
    steps = [n["type"] for n in norms.get("normalizers", [norms] if norms else [])]
    cut = found["pre_tokenizer"] or {}
    first = cut.get("pretokenizers", [cut])[0]
    return "Lowercase" in steps and {*steps} <= {"NFC", "Replace", "Lowercase"} and first.get("type") == "Split" and first.get("pattern") == {"Regex": CUT}


def heads_and_marks(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """What words are encoded as: without the marks at their ends, lower-cased where that is sure, and those marks."""
    head = pc.utf8_rtrim(words, characters=MARKS)
    cut = pc.and_(pc.less(pc.binary_length(head), pc.binary_length(words)), pc.is_in(pc.utf8_slice_codeunits(head, start=-1), value_set=LETTERS))
    marks = pc.struct_field(pc.extract_regex(words.filter(cut), f"(?P<marks>[{MARKS}]*)$"), "marks")
    head = pc.if_else(cut, head, words)
    return pc.if_else(pc.ascii_is_alpha(head), pc.ascii_lower(head), head), pc.replace_with_mask(pa.repeat("", len(words)), cut, marks)


def stretches(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of a pool one after the other."""
    total = np.cumsum(size)
    return pool[np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)]


class KnownWords:
    """The ids of words, those of at most `most` words kept from call to call.

    Arrays hold them, some forty bytes a word: Python workers live on, Spark keeps more of them than there are cores,
    and what they keep counts in the executor's memory during all that follows. When there are too many, the half
    that was asked for most often stays, by counts that are halved each time.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int, longest: int = 48):
        self.encode, self.most, self.longest = encode, most, longest
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.sizes, self.asked = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where those of each word begin and how many they are."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = at < 0
        self.asked[at[~unknown]] += 1
        new = words.filter(pa.array(unknown))
        ids, sizes = self.encode(new.to_pylist())
        at[unknown] = len(self.words) + np.arange(len(new))
        ids, sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        starts = np.cumsum(sizes) - sizes
        self.keep(new, ids, starts, sizes)
        return ids, starts[at], sizes[at]

    def keep(self, new: pa.Array, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        asked = np.concatenate([self.asked, np.ones(len(new), np.int32)])
        asked[len(self.words) :][pc.greater(pc.utf8_length(new), self.longest).to_numpy(zero_copy_only=False)] = 0
        words, stay = pa.concat_arrays([self.words, new]), np.flatnonzero(asked)
        if len(stay) > self.most:
            stay = np.sort(stay[np.argsort(-asked[stay], kind="stable")[: self.most // 2]])
            asked = (asked + 1) // 2
        if len(stay) < len(words):
            words, asked, ids, sizes = words.take(pa.array(stay)), asked[stay], stretches(ids, starts[stay], sizes[stay]), sizes[stay]
        self.words, self.ids, self.sizes, self.asked = words, ids, sizes, asked


class WordIds:
    """Ids of texts by their white-space separated words.

    Holds for tokenizers that drop white space and never join over it, such as word_bpe_49k.json. Of a tokenizer that
    cuts_at_marks, words are encoded in two parts, so that a word costs once however it is written and whatever mark
    follows.
    """

    def __init__(self, tokenizer, end_id: int, most: int = 400_000):
        self.tokenizer, self.end_id, self.cuts = tokenizer, end_id, cuts_at_marks(tokenizer)
        self.between = tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.known = KnownWords(self.encode, most)

    def encode_alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has; words go together, with a mark between that is one id."""
        out, groups = [(np.zeros(0, "<u4"), np.zeros(0, np.int64))], [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for k in range(0, len(groups), TOGETHER):  # what is found is large until it is an array
            some = groups[k : k + TOGETHER]
            for group, found in zip(some, self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, "<u4")
                at = np.flatnonzero(ids == self.between[0])
                if len(self.between) != 1 or len(at) != len(group) - 1:  # a word holds that id itself
                    out.append(self.encode_alone(group))
                else:
                    out.append((np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1))
        flat, sizes = zip(*out, strict=True)
        return np.concatenate(flat), np.concatenate(sizes)

    def of_texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of some texts at a time, their ids one after the other, each with the end id, and how many each has."""
        unsure = pc.match_substring_regex(texts, UNSURE.pattern)
        whole = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") for t in texts.filter(unsure).to_pylist()]
        split = pc.utf8_split_whitespace(pc.if_else(unsure, BETWEEN, texts))  # any word: texts that are unsure are one, whose ids follow
        offsets, coded = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
        offsets, which, distinct = offsets - offsets[0], coded.indices.to_numpy().copy(), coded.dictionary
        del split, coded
        which[offsets[:-1][unsure.to_numpy(zero_copy_only=False)]] = len(distinct) + 1 + np.arange(len(whole))
        pool, sizes = self.of_words(distinct)
        pool = np.concatenate([pool, np.array([self.end_id], "<u4"), *whole])
        sizes = np.concatenate([sizes, [1], np.fromiter(map(len, whole), np.int64, len(whole))])
        starts = np.cumsum(sizes) - sizes
        for low, high in runs_of(pc.binary_length(texts).to_numpy(zero_copy_only=False), PART_BYTES):
            ends = offsets[low + 1 : high + 1] - offsets[low]
            words = np.insert(which[offsets[low] : offsets[high]], ends, len(distinct))  # each text ends with the end id
            size = sizes[words]
            yield stretches(pool, starts[words], size), np.diff(np.cumsum(size)[ends + np.arange(len(ends))], prepend=0)

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        heads, marks = (x.dictionary_encode() for x in (heads_and_marks(words) if self.cuts else (words, pa.repeat("", len(words)))))
        ids, starts, sizes = self.known.lookup(pa.concat_arrays([heads.dictionary, marks.dictionary]))
        parts = np.column_stack([heads.indices.to_numpy(), len(heads.dictionary) + marks.indices.to_numpy()])
        return stretches(ids, starts[parts].ravel(), sizes[parts].ravel()), sizes[parts].sum(axis=1)


@lru_cache(maxsize=1)
def word_ids(tokenizer_path: str, end_id: int) -> WordIds:
    """One for all tasks of a Python worker, so that common words are encoded once a worker; what it holds is bounded."""
    return WordIds(load_tokenizer(tokenizer_path), end_id)


def cut_documents(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, doc_id: str, text: str, keep_ids: bool) -> DataFrame:
    """Pieces of at most `capacity` ids, each with its rank among its task's pieces of the same length."""
    kind, names = df.schema[doc_id].dataType.simpleString(), ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank", *["ids"] * keep_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ranks, task = word_ids(tokenizer_path, end_id), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            first = 0
            for low, high in runs_of(pc.binary_length(texts).to_numpy(zero_copy_only=False), RUN_BYTES):
                for flat, sizes in words.of_texts(texts.slice(low, high - low)):
                    n = -(-sizes // capacity)  # every document has a piece, since it has an end
                    doc = np.repeat(np.arange(len(sizes)), n)
                    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                    length = np.minimum(sizes[doc] - start, capacity)
                    ends = np.cumsum(length)
                    rank, crc = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
                    for k, (a, b, size) in enumerate(zip((ends - length).tolist(), ends.tolist(), length.tolist(), strict=True)):
                        crc[k], rank[k] = zlib.crc32(flat[a:b]), ranks[size]
                        ranks[size] += 1
                    columns = [batch.column(0).take(pa.array(first + doc)), *map(pa.array, (start, length, crc, sizes[doc], np.full(len(doc), task, np.int32), rank))]
                    if keep_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.view(np.int32))))
                    first += len(sizes)
                    yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task int, rank long" + ", ids array<int>" * keep_ids
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def pack_documents(
    df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True, scratch: Scratch | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids.

    A document is its ids and end_id, so null and empty texts are one id. It is cut at multiples of capacity; the
    remainders share sequences. Rows are documents: repeated rows and ids, and null ids, each get pieces of their own.
    No rows give no pieces; remainders of equal length are placed in the order of their tasks' rows. Extra columns are dropped. Only the histogram of lengths (at most capacity rows) reaches
    the driver, and only the table of places that follows from it is broadcast; neither grows with the corpus.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    pieces = scratch.write(cut_documents(df, tokenizer_path, capacity, end_id, doc_id, text, keep_ids), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    placed = spark.createDataFrame(places(plan_windows(counts, capacity)), "length long, first_rank long, end_rank long, in_window long, first_sequence long, first_offset long")
    ranked = pieces.join(starts, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    at = F.col("rank") - F.col("first_rank")
    inside = (ranked["length"] == placed["length"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    return ranked.join(F.broadcast(placed), inside).select(
        "doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(at / F.col("in_window"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + at % F.col("in_window") * ranked["length"]).cast("long").alias("offset"),
        *["ids"] * keep_ids,
    )
