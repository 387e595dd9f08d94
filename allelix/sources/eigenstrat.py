"""Eigenstrat files: genotype lines meet their markers by line number, over files that are read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import eigenstrat_genotypes


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, line) of a text file, or of a folder's files in the order of their names, from 0 on; empty lines at the end count like others.

    Lines are counted by split first, which gives where each split's numbers begin; a row for each split passes through
    one task. Within a split numbers follow the order of reading.
    """
    raw = spark.read.text(path).select("value", F.struct("_metadata.file_name", "_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    counts = raw.groupBy("split").agg(F.count("*").alias("lines"), F.min("id").alias("first"))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("split", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("begin"))
    return raw.join(begins, "split").select((F.col("begin") + F.col("id") - F.col("first")).alias("number"), F.col("value").alias("line"))


def read_eigenstrat(spark: SparkSession, genotypes: str, markers: str, individuals: str) -> DataFrame:
    """(marker, chrom, position, individual, dosage) of the three files (or folders of their parts): reference alleles 0, 1 or 2, null where missing.

    Markers are the first words of a .snp file's lines, individuals those of an .ind file's. A genotype line of another
    length than there are individuals, too few or too many genotype lines, and other characters raise an error when rows
    are read. An .ind file is a cohort's, so the driver reads it.
    """
    names = [r["line"].split()[0] for r in numbered_lines(spark, individuals).where("trim(line) <> ''").orderBy("number").collect()]
    fields = F.split(F.trim("line"), r"\s+")
    known = numbered_lines(spark, markers).where("trim(line) <> ''").select("number", F.get(fields, F.lit(0)).alias("marker"), F.get(fields, F.lit(1)).alias("chrom"), F.get(fields, F.lit(3)).cast("long").alias("position"))
    rows = numbered_lines(spark, genotypes).where("line <> ''").join(known, "number", "full")
    few = F.concat(F.lit("too few genotype lines: none for marker "), F.col("marker"))
    many = F.concat(F.lit("too many genotype lines: no marker for line "), (F.col("number") + 1).cast("string"))
    # a row that lacks either side must not be dropped before it is seen, so the error is part of the line itself
    line = F.when(F.col("line").isNull(), F.raise_error(few)).when(F.col("marker").isNull(), F.raise_error(many)).otherwise(F.col("line"))
    checked = rows.select(F.struct("marker", "chrom", "position").alias("marker"), line.alias("line"))
    return eigenstrat_genotypes(checked, names).select("marker.marker", "marker.chrom", "marker.position", "individual", "dosage")
