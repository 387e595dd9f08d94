"""From raw documents to packed training sequences, in five stages over tables that are written in between."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm import decontam, near_dups, packing, quality, secret_scan
from allelix.llm.common import Scratch, table
from allelix.runtime import prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(df: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The documents in the column `row` of df, whose text is that in the column `text`; n_chars follows where the text changed."""
    own = lambda c: F.col("row").getField(c)
    changed = ~F.col(text).eqNullSafe(own("text"))
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(text)).otherwise(own("n_chars")).cast(docs.schema["n_chars"].dataType)
    return df.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])


def _rows(docs: DataFrame) -> DataFrame:
    """Documents as (row, text), so that no column of theirs meets one of an operator."""
    return docs.select(F.struct("*").alias("row"), "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failed lines.

    Null and empty texts have no words and go. A text of any length is judged whole, by itself: repeated rows and ids,
    and texts that tie, go or stay alike, and null ids do no harm. An empty table stays empty. All columns but text and
    n_chars (which follows where the text changed) come back as they are, also those named like an output of the rules.
    """
    return _with_text(quality.judge_quality(_rows(docs)).where("kept"), docs, "cleaned")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Rows with equal id and text are one document; rows that repeat an id with other texts are judged by their texts, and
    of near copies with one id the text with the smallest hash stays. Rows without id stay, and so do null and empty
    texts, which are like nothing. Texts of any length count whole; an empty table stays empty; all columns come back as
    they are, whatever their names.
    """
    return near_dups.drop_near_duplicates(docs, scratch=Scratch(prepare(spark)))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the table benchmark.

    Each row is judged by itself: repeated rows and ids go or stay alike, null ids do no harm. Null and empty texts leak
    nothing and stay; texts of any length are searched whole. Without items, or without documents, nothing changes. All
    columns come back as they are, whatever their names.
    """
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"), scratch=Scratch(prepare(spark)))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked.

    Null and empty texts have none and stay; texts of any length are scanned whole, row by row, so repeated rows and ids
    come out alike and null ids do no harm. Overlapping secrets are masked together. An empty table stays empty. All
    columns but text and n_chars (which follows where the text changed) come back as they are, whatever their names.
    """
    return _with_text(secret_scan.scan_secrets(_rows(docs)), docs, "redacted")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, in sequences of at most 2048.

    Null and empty texts are their end id alone; texts of any length are cut at multiples of 2048. Each row is a document
    of its own: repeated rows and ids, and null ids, each get pieces. Of pieces of one length, any may come first. No
    documents give no pieces. Extra columns are dropped.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True, scratch=Scratch(prepare(spark)))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", packed_sequences),
]

#: The stages' rules aren't ones that SQL can express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents: the last one's pieces, as packed_sequences has them.

    Each result but the last is written to the shared folder and read again; it goes when the next one has been written.
    What stands in the stages' docstrings holds for nulls, empty and very long texts, ties, repeated rows, empty tables
    and extra columns, which pass all stages but the last.
    """
    prepare(spark)
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        between = Scratch(spark)
        docs = between.write(stage(spark, docs, sf_dir), name)
        if held is not None:
            held.release()
        held = between
    return STAGES[-1][1](spark, docs, sf_dir)
