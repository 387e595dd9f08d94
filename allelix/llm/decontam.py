"""Benchmark decontamination: training passages are queries to a BM25 index of the test items, with block-max WAND.

The index keeps, of every term and of every block of items that has it, the largest weight. A passage's terms of least
weight that fall short of the threshold together can't bring an item there alone: their blocks are skipped, but for those
that the other terms reach with a chance left. The sums of a block's largest weights bound what its items can score, and
WAND runs in the few blocks whose bound reaches the threshold, skipping items by the same bounds. Nothing that reaches
the threshold is missed. All of a batch's passages go through these steps at once.

Scores are shares: what a passage scores with an item over what the item's own text scores with it, so one threshold
holds for all items. A passage that holds an item's words has 1, wherever else its words come from.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, sub_batches

TERM = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+")


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


@dataclass(frozen=True)
class Settings:
    k1: float = 1.2
    b: float = 0.75
    #: Passages that score less than this share of an item's own score aren't looked at.
    least_score: float = 0.6
    #: Share of the word triples of an item's question, and of its answer, that a passage must hold; of a part of at most
    #: short_part words, the share of its words that stand there in order counts too. A question of at most joined_part
    #: words is judged with the words of the answer next to it, short_tail in all; such an answer must stand behind the
    #: question's end, at most `gap` words on, half of its words at least, each as it is or spelled about so.
    least_overlap: float = 0.6
    gram: int = 3
    short_part: int = 12
    joined_part: int = 2
    short_tail: int = 8
    gap: int = 3
    least_alike: float = 0.75
    #: Items in a block.
    block: int = 4
    #: Passages have at least so many words; for items that are longer than half of that, it is doubled until they aren't.
    least_passage: int = 128
    #: Distinct items in an index, and bytes of their texts; with more, there are several, and each sees all passages.
    most_items: int = 50_000
    most_bytes: int = 16_000_000


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The last sentence with words answers the ones before; of a single sentence, the last third does."""
    sentences = [t for t in map(terms_of, SENTENCE_END.split((text or "").strip())) if t]
    if len(sentences) > 1:
        return [t for s in sentences[:-1] for t in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def grams(words: list[str], size: int) -> set[tuple[str, ...]]:
    size = min(size, len(words))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if size else set()


def short_parts(question: list[str], answer: list[str], settings: Settings) -> list[list[str] | None]:
    """What stands for the question and for the answer where shares of words in order count; None where they don't."""
    short = [part if settings.gram <= len(part) <= settings.short_part else None for part in (question, answer)]
    begin = (question + answer)[: settings.short_tail]
    # of fewer words, a changed one leaves too little to tell an item by
    if 0 < len(question) <= settings.joined_part and len(begin) > settings.gram + 1:
        short[0] = begin
    return short


def alike(a: str, b: str, least: float) -> bool:
    return a == b or (min(len(a), len(b)) > 3 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= least)


def common_in_order(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def answer_behind(question: list[str], answer: list[str], words: list[str], settings: Settings) -> float:
    """The share of a brief answer's words behind where the question ends: where its last words stand in order best."""
    tail = question[-settings.gram :]
    ends = [(common_in_order(tail, words[max(0, e - len(tail) - 1) : e]), e) for e in range(1, len(words) + 1) if words[e - 1] in tail]
    best = max((n for n, _ in ends), default=0)
    if best < min(2, len(tail)):
        return 0.0
    found = 0
    for n, e in ends:
        if n == best:
            near = words[e : e + len(answer) + settings.gap]
            found = max(found, sum(any(alike(a, w, settings.least_alike) for w in near) for a in answer))
    return found / len(answer)


def share_in_order(part: list[str], words: list[str], least: float) -> float:
    """The largest share of part that stands in order within a stretch of words that is two words longer; 0 if below least."""
    known, n = set(part), len(part)
    at = [k for k, w in enumerate(words) if w in known]
    most, need = 0, least * n - 1e-9
    for i, begin in enumerate(at):
        stretch = [words[k] for k in at[i : i + n + 2] if k < begin + n + 2]
        if len(stretch) < need or len(stretch) <= most:
            continue
        row = [0] * (n + 1)  # the longest common subsequence with each beginning of part
        for w in stretch:
            last = 0
            for j, p in enumerate(part):
                last, row[j + 1] = row[j + 1], last + 1 if w == p else max(row[j + 1], row[j])
        most = max(most, row[n])
    return most / n if most >= need else 0.0


class Postings:
    """Of a term: for each block that has it, item numbers in order, their shares, and the largest share."""

    def __init__(self):
        self.blocks: dict[int, tuple[list[int], list[float]]] = {}

    def add(self, block: int, item: int, share: float) -> None:
        items, shares = self.blocks.setdefault(block, ([], []))
        items.append(item)
        shares.append(share)


def half_passage(n: int, settings: Settings) -> int:
    """Half the passage length for an item of n words, whatever other items there are."""
    half = max(1, settings.least_passage // 2)
    while half < n:
        half *= 2
    return half


class Index:
    """Inverted index of test items (id, text), which should share a half_passage; frequencies: of how many items each of their terms is part, among `total` items."""

    def __init__(self, items: list[tuple[object, str]], frequencies: dict[str, int], total: int, mean_length: float, settings: Settings):
        self.settings, self.ids = settings, [i for i, _ in items]
        self.parts = [[grams(part, settings.gram) for part in question_and_answer(text)] for _, text in items]
        self.short = [short_parts(*question_and_answer(text), settings) for _, text in items]
        self.brief = [(q, a) if 0 < len(a) <= settings.joined_part and q else None for q, a in (question_and_answer(text) for _, text in items)]
        split = [terms_of(text) for _, text in items]
        self.half = half_passage(max(map(len, split), default=0), settings)
        weights: list[dict[str, float]] = []
        for words in split:
            norm = settings.k1 * (1 - settings.b + settings.b * len(words) / max(mean_length, 1e-9))
            counts: dict[str, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            weights.append({w: log(1 + (total - frequencies[w] + 0.5) / (frequencies[w] + 0.5)) * n * (settings.k1 + 1) / (n + norm) for w, n in counts.items()})
        found: dict[str, Postings] = {}
        for k, weight in enumerate(weights):
            own = sum(weight.values())
            for w, x in weight.items():
                found.setdefault(w, Postings()).add(k // settings.block, k, x / own)
        self.vocabulary = {w: k for k, w in enumerate(found)}
        self.postings = list(found.values())
        self.n_blocks = -(-len(items) // settings.block)
        # the blocks of all terms one after the other, and the largest share in each
        sizes = [len(p.blocks) for p in self.postings]
        self.first_block = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.block_number = np.array([b for p in self.postings for b in p.blocks], np.int64)
        self.block_most = np.array([max(shares) for p in self.postings for _, shares in p.blocks.values()])
        self.block_key = np.repeat(np.arange(len(sizes)), sizes) * self.n_blocks + self.block_number
        self.term_most = np.maximum.reduceat(self.block_most, self.first_block[:-1]) if sizes else np.zeros(0)
        #: Blocks whose bound no passage needed so far, counted once for each passage.
        self.skipped = 0

    def passage_terms(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages and their distinct known terms as pairs sorted by passage, and the first passage of each document.

        codes: term numbers of documents one after the other (unknown terms are -1), which begin at starts. Passages
        are two half-passages long and begin at each half of a document.
        """
        known = np.flatnonzero(codes >= 0)
        doc = np.searchsorted(starts, known, "right") - 1
        at, half = known - starts[doc], self.half
        sizes = np.diff(np.append(starts, len(codes)))
        first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-sizes // half)))]).astype(np.int64)
        pair = doc.astype(np.int64) * (len(self.postings) + 1) + codes[known]
        order = np.argsort(pair, kind="stable")
        before = np.full(len(known), -1)  # where the document has the same term before
        same = pair[order[1:]] == pair[order[:-1]]
        before[order[1:][same]] = at[order[:-1][same]]
        k = at // half
        here, back = before < k * half, (before < (k - 1) * half) & (k > 0)
        passage = np.concatenate([first[doc[here]] + k[here], first[doc[back]] + k[back] - 1])
        term = np.concatenate([codes[known[here]], codes[known[back]]])
        order = np.argsort(passage, kind="stable")
        return passage[order], term[order], first

    def hopeful(self, passage: np.ndarray, term: np.ndarray, most_entries: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray]]:
        """(passage, block, terms of the passage) wherever the block's bound reaches the threshold; of pairs sorted by passage.

        Runs of passages with at most most_entries blocks of essential terms (but for a single passage) are held at once.
        """
        if not len(passage):
            return
        least, share = self.settings.least_score - 1e-9, self.term_most[term]
        order = np.lexsort((share, passage))  # of each passage, terms of little weight first
        passage, term, share = passage[order], term[order], share[order]
        opens = np.append(True, passage[1:] != passage[:-1])
        total = np.cumsum(share)
        before = np.maximum.accumulate(np.where(opens, total - share, 0.0))
        essential = total - before >= least
        owner, starts = np.cumsum(opens) - 1, np.append(np.flatnonzero(opens), len(passage))
        rest = np.bincount(owner, np.where(essential, 0.0, share))
        sizes = np.where(essential, self.first_block[term + 1] - self.first_block[term], 0)
        reach = np.cumsum(np.add.reduceat(sizes, starts[:-1]))
        self.skipped += int((self.first_block[term + 1] - self.first_block[term]).sum() - sizes.sum())
        low = 0
        while low < len(starts) - 1:
            high = max(low + 1, int(np.searchsorted(reach, (reach[low - 1] if low else 0) + most_entries, "right")))
            a, b = starts[low], starts[high]
            yield from self._bounded(passage[a:b], term[a:b], (total - before - share)[a:b], owner[a:b] - low, sizes[a:b], starts[low:high] - a, rest[low:high], least)
            low = high

    def _bounded(self, passage: np.ndarray, term: np.ndarray, below: np.ndarray, owner: np.ndarray, sizes: np.ndarray, starts: np.ndarray, rest: np.ndarray, least: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """What hopeful gives for some whole passages, whose terms come by their largest weights; below: those of all lesser terms together."""
        entry = np.repeat(self.first_block[term] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        cells, every = np.repeat(owner, sizes) * self.n_blocks + self.block_number[entry], len(starts) * self.n_blocks
        if every <= 4 * len(cells):
            cell, bound = np.arange(every), np.bincount(cells, self.block_most[entry], every)
        else:
            cell, inverse = np.unique(cells, return_inverse=True)
            bound = np.bincount(inverse, self.block_most[entry], len(cell))
        chance = (bound > 0) & (bound + rest[cell // self.n_blocks] >= least)
        cell, bound = cell[chance], bound[chance]
        which, block = cell // self.n_blocks, cell % self.n_blocks
        # the terms left are added from the weightiest on, as long as they can matter
        at = (starts + np.bincount(owner, sizes == 0, len(starts)).astype(np.int64) - 1)[which]
        ends = np.append(starts[1:], len(passage))
        while len(which):
            done = at < starts[which]
            for k in np.flatnonzero(done & (bound >= least)).tolist():
                w = which[k]
                yield int(passage[starts[w]]), int(block[k]), term[starts[w] : ends[w]]
            which, block, bound, at = which[~done], block[~done], bound[~done], at[~done]
            key = term[at].astype(np.int64) * self.n_blocks + block
            found = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            bound = bound + np.where(self.block_key[found] == key, self.block_most[found], 0.0)
            chance = bound + below[at] >= least
            which, block, bound, at = which[chance], block[chance], bound[chance], at[chance] - 1

    def search(self, terms: np.ndarray, block: int) -> list[tuple[int, float]]:
        """All items of a block (number, score) whose score reaches the threshold, by WAND over the terms' postings there."""
        least, found = self.settings.least_score - 1e-9, []
        lists = [self.postings[t].blocks[block] for t in terms.tolist() if block in self.postings[t].blocks]
        cursors = [[items, shares, max(shares), 0] for items, shares in lists]
        while cursors:
            cursors.sort(key=lambda c: c[0][c[3]])
            reach, pivot = 0.0, None
            for c in cursors:
                reach += c[2]
                if reach >= least:
                    pivot = c[0][c[3]]
                    break
            if pivot is None:
                break  # what is left can't reach the threshold
            if cursors[0][0][cursors[0][3]] == pivot:
                here = [c for c in cursors if c[0][c[3]] == pivot]
                score = sum(c[1][c[3]] for c in here)
                if score >= least:
                    found.append((pivot, score))
                for c in here:
                    c[3] += 1
            else:
                for c in cursors:
                    while c[3] < len(c[0]) and c[0][c[3]] < pivot:
                        c[3] += 1
            cursors = [c for c in cursors if c[3] < len(c[0])]
        return found

    def matches(self, split: list[list[str]]) -> list[dict[int, tuple[float, float, float, int]]]:
        """For the terms of each text, the items that it leaks: number to score, question overlap, answer overlap and first word."""
        code = self.vocabulary.get
        codes = np.fromiter((code(w, -1) for words in split for w in words), np.int64)
        starts = np.concatenate([[0], np.cumsum([len(w) for w in split])])[:-1].astype(np.int64)
        found: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in split]
        passage, term, first = self.passage_terms(codes, starts)
        for which, block, terms in self.hopeful(passage, term):
            hits = self.search(terms, block)
            if not hits:
                continue
            doc = int(np.searchsorted(first, which, "right")) - 1
            begin = (which - int(first[doc])) * self.half
            words, least = split[doc][begin : begin + 2 * self.half], self.settings.least_overlap
            held = grams_of_all(words, self.settings.gram)
            for item, score in hits:
                overlap = [sum(g in held for g in part) / len(part) if part else 1.0 for part in self.parts[item]]
                if min(overlap) < least:
                    overlap = [o if o >= least or not short else max(o, share_in_order(short, words, least)) for o, short in zip(overlap, self.short[item], strict=True)]
                if self.brief[item] and overlap[0] >= least:
                    overlap[1] = answer_behind(*self.brief[item], words, self.settings)
                if overlap[0] >= least and overlap[1] >= (0.5 if self.brief[item] else least) and (item not in found[doc] or score > found[doc][item][0]):
                    found[doc][item] = (score, *overlap, begin)
        return found


class Indexes:
    """An index for each passage length that the items ask for, searched as one."""

    def __init__(self, items: list[tuple[object, str]], frequencies: dict[str, int], total: int, mean_length: float, settings: Settings):
        bands: dict[int, list[tuple[object, str]]] = {}
        for item, text in items:
            bands.setdefault(half_passage(len(terms_of(text)), settings), []).append((item, text))
        self.bands = [Index(held, frequencies, total, mean_length, settings) for _, held in sorted(bands.items())]
        self.ids = [i for band in self.bands for i in band.ids]

    def matches(self, texts: list[str]) -> list[dict[int, tuple[float, float, float, int]]]:
        """As those of the indexes, with numbers that go through them all."""
        split, first = [terms_of(t) for t in texts], 0
        out: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in texts]
        for band in self.bands:
            for found, more in zip(out, band.matches(split), strict=True):
                found.update((first + item, values) for item, values in more.items())
            first += len(band.ids)
        return out


def grams_of_all(words: list[str], size: int) -> set[tuple[str, ...]]:
    """Of every length up to size, since parts shorter than size are one gram."""
    return set().union(*(grams(words, k) for k in range(1, size + 1)))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def indexes(items: DataFrame, settings: Settings, text: str = "text") -> Iterator[tuple[Indexes, bool]]:
    """One after the other, indexes of all distinct item texts with words, whose ids are text keys, and whether more follow.

    Frequencies and lengths are those of all items, passages those of each item. Equal texts are indexed once, however
    many items have them; an index holds about most_items of them and most_bytes, or a single longer one, and that is
    what the driver holds and broadcasts at a time.
    """
    named = items.select(F.coalesce(F.col(text), F.lit("")).alias("text"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(len(w := terms_of(t)), list(dict.fromkeys(w))) for t in batch["text"]], columns=["n", "terms"])

    terms = named.mapInPandas(split, "n long, terms array<string>").where("n > 0")
    total, mean = terms.agg(F.count("*"), F.avg("n")).first()
    if not total:
        return
    once = named.distinct()
    distinct, size = once.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, ceil(distinct / settings.most_items), ceil(size / settings.most_bytes))
    for k in range(blocks):
        block = once.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).select(text_key(F.col("text")).alias("key"), "text")
        held = [(r["key"], r["text"]) for r in block.collect() if terms_of(r["text"])]
        own = items.sparkSession.createDataFrame([(w,) for w in {w for _, t in held for w in terms_of(t)}], "term string")
        counted = terms.select(F.explode("terms").alias("term")).join(own, "term").groupBy("term").count()
        yield Indexes(held, {r["term"]: r["count"] for r in counted.collect()}, total, mean, settings), k + 1 < blocks


def find_leaks(
    docs: DataFrame, items: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): every test item that a document leaks.

    Every passage of every document is a query. An overlap is the share of a part's triples or, where that falls short
    for a short part, of its words in order, so one changed word doesn't hide it. An answer of one or two words must stand
    behind the question's end, one of its words at least, and be spelled about so: a question alone, or with another
    answer, is no leak, whatever words it shares with the answer. Score is the best passage's (of
    passages that tie, the first's), first_word where that passage begins. Null and empty texts leak nothing; items without
    words can't be leaked; repeated rows and ids give rows each, and so do items with equal texts. Rows without ids are
    searched too. No items or no documents give no rows. Texts of any length are searched whole, in passages; extra
    columns, whatever their names, are dropped. Documents aren't shuffled. Where the items need several indexes, what
    each finds is written before the next is built.
    """
    kinds = (docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString())
    values = "score double, question_overlap double, answer_overlap double, first_word long"
    out = None
    for index, more in indexes(items, settings, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k, rows = 0, []
                for texts in sub_batches(batch.column(1).to_pylist()):
                    for found in shared.value.matches(texts):
                        rows += [(k, shared.value.ids[item], *values) for item, values in found.items()]
                        k += 1
                if rows:
                    at, *columns = zip(*rows, strict=True)
                    arrays = [batch.column(0).take(pa.array(at)), pa.array(columns[0]), *[pa.array(c, t) for c, t in zip(columns[1:], [pa.float64()] * 3 + [pa.int64()], strict=True)]]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_key", "score", "question_overlap", "answer_overlap", "first_word"])

        found = docs.select(F.col(doc_id), F.col(text)).mapInArrow(search, f"doc_id {kinds[0]}, item_key string, {values}")
        if more or out is not None:
            scratch = scratch or Scratch(docs.sparkSession)
            found = scratch.write(found, "leaks")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, {values}")
    names = items.select(F.col(item_id).alias("item_id"), text_key(F.col(item_text)).alias("item_key"))
    return out.join(names, "item_key").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word")


def drop_leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text: str = "text", item_text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs without those that leak a test item, by the rules of find_leaks; all columns and other rows stay as they are.

    Rows are judged one by one, so repeated rows go or stay together and null ids do no harm. Null and empty texts stay,
    texts of any length are searched whole, no items or no documents change nothing, and no column is added, so names
    can't clash. Where the items need several indexes, what each leaves is written before the next is built.
    """
    kept = docs
    for index, more in indexes(items, settings, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        kept = kept.where(~leaks_of(shared)(F.coalesce(F.col(text), F.lit(""))))
        if more:
            scratch = scratch or Scratch(docs.sparkSession)
            kept = scratch.write(kept, "without leaks")
            shared.unpersist()
    return kept


def leaks_of(shared: Broadcast) -> Callable[[Column], Column]:
    """Whether texts leak an item of the broadcast index."""

    @F.pandas_udf("boolean")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([bool(found) for texts in sub_batches(batch) for found in shared.value.matches(texts)], dtype=bool)
        give_back()

    return leaks
