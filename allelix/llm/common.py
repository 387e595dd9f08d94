"""Helpers that several operators share: tables, scratch space, word splitting."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere are runs without ASCII white space; bytes.split() splits exactly there.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only, whatever the locale or other letters."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sub_batches(texts: Iterable[str | bytes | None], most_chars: int = 1_000_000) -> Iterator[list]:
    """Runs of texts, or of their bytes, of bounded total length, so that a batch of long texts needs little memory at once."""
    held: list[str | bytes] = []
    chars = 0
    for text in texts:
        text = "" if text is None else text
        if held and chars + len(text) > most_chars:
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield held


def give_back() -> None:
    """Give back the pages that this process has freed: Python workers live on through the stages that follow a task."""
    pa.system_memory_pool().release_unused()


def runs_of(sizes: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to at most so much, or of one row."""
    low, total = 0, np.cumsum(sizes)
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")))
        yield low, high
        low = high


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="allelix-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder; written tables cut lineage and survive lost executors.

    release(), or the end of a with statement, deletes them: operators do so with what their result doesn't read. What
    is left goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self.release)

    def path(self, label: str) -> str:
        return f"{self.root}/{re.sub(r'[^A-Za-z0-9]+', '_', label)}-{uuid.uuid4().hex[:8]}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        to = self.path(label)
        df.write.parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def release(self) -> None:
        atexit.unregister(self.release)
        context = self.spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            return
        path = context._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of df but for those named (in any case): an operator's own columns replace clashing ones."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every Python process."""
    if not words:
        return np.zeros(0, np.uint64)
    held = np.empty(len(words), object)
    held[:] = words
    return pd.util.hash_array(held, categorize=False)


def mixed(values: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on each bit of the (unsigned 64-bit) value."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def window_hashes(words: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Mixed hashes of all windows of `size` consecutive word hashes, by position of their first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, size):
        total *= np.uint64(factor)
        total += words[k : k + n]
    return mixed(total)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Runs of whole groups of rows with equal keys, of batches of rows sorted by them, with each row's group number; about so many rows at once."""
    held: list[pd.DataFrame] = []
    size = 0

    def numbered(frame: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(frame), bool)
        for k in keys:
            values = frame[k].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.cumsum(change)

    for batch in batches:
        for at in range(0, len(batch), rows):
            held.append(batch.iloc[at : at + rows])
            size += len(held[-1])
            if size < rows:
                continue
            frame = pd.concat(held, ignore_index=True)
            numbers = numbered(frame)
            whole = int(np.searchsorted(numbers, numbers[-1]))  # the last group may go on
            if whole:
                yield frame.iloc[:whole], numbers[:whole]
            held, size = [frame.iloc[whole:]], len(frame) - whole
    if size:
        frame = pd.concat(held, ignore_index=True)
        yield frame, numbered(frame)
