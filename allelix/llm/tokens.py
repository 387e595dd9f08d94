"""Token counts of whole texts, huge ones in overlapping chunks that are spliced where both agree.

A byte-level BPE tokenizer first cuts a text into pre-tokens by one left-to-right scan that remembers nothing:
from a pre-token boundary on, the scan depends on what follows alone. So a position at which two overlapping
chunks both begin a pre-token is a boundary of the whole text too (by induction over chunks), and from there on the
later chunk's tokens are the whole text's. The scan looks a few characters ahead and special strings have a bounded
length, hence a boundary closer than MARGIN to an end of a chunk that isn't the text's proves nothing.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sub_batches, without

MARGIN = 64

#: White space and the word after it. White space after a non-space always begins a pre-token, so units are independent.
UNIT = re.compile(r"\s*\S+|\s+")
#: Characters that Python and the tokenizer's patterns may class differently; texts with them are encoded in one piece.
UNSURE = re.compile("[\x1c-\x1f\x85\u180e]")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Chunk:
    """A stretch of a text, encoded by itself with offsets, which are looked at only around its overlaps."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        self.found = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.size = start, end, len(self.found)

    def begins(self, token: int) -> bool:
        """Whether a token is the first of its pre-token; special strings are pre-tokens by themselves."""
        word = self.found.token_to_word(token)
        return token == 0 or word is None or word != self.found.token_to_word(token - 1)

    def place(self, token: int) -> int:
        return self.start + self.found.token_to_chars(token)[0]

    def token_at(self, at: int) -> int | None:
        """The token that begins a pre-token at this place of the text."""
        token = self.found.char_to_token(at - self.start) if self.start <= at < self.end else None
        return token if token is not None and self.place(token) == at and self.begins(token) else None


def common_boundary(left: Chunk, right: Chunk, after: int) -> tuple[int, int, int] | None:
    """The last position past `after` where both chunks begin a pre-token, far enough from the left chunk's end, and their tokens there."""
    for token in range(left.size - 1, -1, -1):
        at = left.place(token)
        if at <= after or at < right.start:
            return None
        if at <= left.end - MARGIN and left.begins(token) and (theirs := right.token_at(at)) is not None:
            return at, token, theirs
    return None


def count_spliced(tokenizer, text: str, chunk_chars: int, overlap_chars: int) -> tuple[int, int, int]:
    """Tokens of a text, chunks that it took, and how often an overlap had to be widened."""
    total, chunks, widened = 0, 1, 0
    sure, counted = 0, 0  # a proven boundary and the left chunk's token there; what stands before it has been counted
    left = Chunk(tokenizer, text, 0, min(len(text), chunk_chars))
    while left.end < len(text):
        overlap, met = overlap_chars, None
        while met is None:
            begin = left.end - overlap
            if begin <= sure:  # the overlap has reached the last proven boundary: start over from it
                right = Chunk(tokenizer, text, sure, min(len(text), left.end + max(chunk_chars, overlap)))
                met = sure, counted, 0
            else:
                right = Chunk(tokenizer, text, begin, min(len(text), left.end + chunk_chars - min(overlap_chars, chunk_chars // 2)))
                met = common_boundary(left, right, sure)
            chunks += 1
            if met is None:
                overlap, widened = overlap * 2, widened + 1
        sure, end, next_counted = met
        total += end - counted
        left, counted = right, next_counted
    return total + left.size - counted, chunks, widened


class UnitCache:
    """What is known of units of text, in two generations: units seen since the last change of generation and before.

    Rare units go with their generation and common ones are carried over, so memory is bounded and little is encoded
    twice. Python workers live on, and Spark keeps more of them than there are cores: one that outlives its task must be small.
    """

    def __init__(self, encode: Callable[[list[str]], list], most: int = 600_000, longest: int = 48):
        self.encode, self.most, self.longest = encode, most, longest
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def lookup(self, split: list[list[str]]) -> Callable[[str], object]:
        """A function that gives the value of any unit in the lists."""
        if len(self.young) > self.most // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        # only what is asked for is walked through, never what is held
        wanted, new, long = [u for u in set().union(*split) if u not in young], [], {}
        for unit in wanted:
            if unit in old:
                young[unit] = old[unit]
            else:
                new.append(unit)
        for k in range(0, len(new), 10_000):
            part = new[k : k + 10_000]
            values = self.encode(part)
            self.young.update(zip(part, values, strict=True))
        for unit in new:
            if len(unit) > self.longest:
                long[unit] = self.young.pop(unit)
        if not long:
            return self.young.__getitem__
        return lambda unit: self.young[unit] if unit in self.young else long[unit]


class UnitCounts:
    """Counts of the tokens of texts by their units."""

    def __init__(self, tokenizer, most: int = 600_000):
        self.cache = UnitCache(lambda units: list(map(len, tokenizer.encode_batch_fast(units, add_special_tokens=False))), most)

    def totals(self, texts: list[str]) -> list[int]:
        split = [[text] if UNSURE.search(text) else UNIT.findall(text) for text in texts]
        count = self.cache.lookup(split)
        return [sum(map(count, units)) for units in split]


def count_tokens(
    df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512, chunk_chars: int = 4_096, overlap_chars: int = 256
) -> DataFrame:
    """Every row of df with n_bytes, n_tokens, over_limit (n_tokens > limit), n_chunks and n_widened.

    Null and empty texts have no bytes and no tokens. Rows are judged one by one: repeated rows and ids stay, null ids
    do no harm, and a column of df with an output's name is replaced. tokenizer_path: a tokenizers .json file of the
    byte-level kind that every executor can read. Texts of over chunk_chars characters are encoded in overlapping
    chunks with offsets, however long they are. Nothing is shuffled; an empty table gives no rows.
    """
    if not 2 * MARGIN <= overlap_chars < chunk_chars:
        raise ValueError("overlap_chars must be from 128 to below chunk_chars")

    @F.pandas_udf("n_tokens long, n_chunks int, n_widened int")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = load_tokenizer(tokenizer_path)
        short = UnitCounts(tokenizer)
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for texts in sub_batches(batch):
                sizes = iter(short.totals([t for t in texts if len(t) <= chunk_chars]))
                rows += [(next(sizes), 1, 0) if len(t) <= chunk_chars else count_spliced(tokenizer, t, chunk_chars, overlap_chars) for t in texts]
            yield pd.DataFrame(rows, columns=["n_tokens", "n_chunks", "n_widened"])

    own = ["n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"]
    rest = without(df, own)
    return df.select(*rest, F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), counted(F.coalesce(text, F.lit(""))).alias("_counted")).select(
        *rest, "n_bytes", "_counted.n_tokens", (F.col("_counted.n_tokens") > limit).alias("over_limit"), "_counted.n_chunks", "_counted.n_widened"
    )
