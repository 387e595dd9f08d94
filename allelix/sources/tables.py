"""Variants and genotypes derived from the synthetic order tables, by fixed arithmetic, so that any engine can rebuild them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import lookup
from .dataset import Dataset


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant_id, project_id, run_name, callset_id, individual, population, gt, dp): parts are variants, suppliers modulo 20 individuals, two runs."""
    raw = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pk"), (F.col("l_suppkey") % 20).alias("ind"), (F.col("l_linenumber") % 2 + 1).alias("run"))
    raw = raw.agg(F.sum("l_linenumber").alias("s"), F.sum(F.col("l_quantity").cast("int")).alias("dp"))
    h = "(pk * 37 + ind * (11 + pk % 5) + (pk % 7) * (ind % 3) * 3 + CASE WHEN s % 13 = 0 THEN 5 ELSE 0 END) % 10"
    return raw.selectExpr(
        "concat('v', cast(pk as string)) AS variant_id", "1 AS project_id", "concat('run', cast(run as string)) AS run_name", "cast(ind * 2 + run as int) AS callset_id",
        "concat('ind', cast(ind as string)) AS individual", "concat('pop', cast(ind % 3 as string)) AS population",
        f"CASE WHEN s % 11 = 0 THEN NULL WHEN {h} < 4 THEN '0/0' WHEN {h} < 7 THEN '0/1' ELSE '1/1' END AS gt", "cast(dp as int) AS dp",
    )


def of_ploidy(spark: SparkSession, sf_dir: str, ploidy: int) -> DataFrame:
    """Genotypes as `genotypes` gives them, but of so many alleles each, the third one too where a variant has three; half of the diploid ones are phased."""
    raw = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pk"), (F.col("l_suppkey") % 20).alias("ind"), (F.col("l_linenumber") % 2 + 1).alias("run")).agg(F.sum("l_linenumber").alias("s"), F.sum(F.col("l_quantity").cast("int")).alias("dp"))
    known = read(spark, sf_dir, "part").selectExpr("p_partkey AS pk", "CASE WHEN p_type = 'PROMO' THEN 3 ELSE 2 END AS n")
    h = "(pk * 37 + ind * (11 + pk % 5) + (pk % 7) * (ind % 3) * 3 + CASE WHEN s % 13 = 0 THEN 5 ELSE 0 END)"
    separator = "CASE WHEN (pk + ind) % 2 = 0 THEN '|' ELSE '/' END" if ploidy == 2 else "'/'"
    return raw.join(known, "pk").selectExpr(
        "concat('v', cast(pk as string)) AS variant_id", "1 AS project_id", "concat('run', cast(run as string)) AS run_name", "cast(ind * 2 + run as int) AS callset_id",
        "concat('ind', cast(ind as string)) AS individual", "concat('pop', cast(ind % 3 as string)) AS population",
        f"CASE WHEN s % 11 = 0 THEN NULL ELSE array_join(transform(sequence(0, {ploidy - 1}), c -> cast(({h} + c * c * (ind % 3 + 1)) % n as string)), {separator}) END AS gt", "cast(dp as int) AS dp",
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant_id, type, chrom, start_site, end_site, alleles); some are unplaced, some have three alleles."""
    return (
        read(spark, sf_dir, "part")
        .selectExpr(
            "concat('v', cast(p_partkey as string)) AS variant_id",
            "CASE p_type WHEN 'ECONOMY' THEN 'INDEL' WHEN 'PROMO' THEN 'MIXED' ELSE 'SNP' END AS type",
            "CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE concat('chr', cast(p_size % 4 + 1 as string)) END AS chrom",
            "CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE (p_partkey * 7919) % 100000 + 1 END AS start_site",
            "CASE p_type WHEN 'PROMO' THEN array('A', 'G', 'T') ELSE array('A', 'G') END AS alleles",
        )
        .withColumn("end_site", F.col("start_site") + F.when(F.col("type") == "SNP", 0).otherwise(3))
        .select("variant_id", "type", "chrom", "start_site", "end_site", "alleles")
    )


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(individual, population), a row each, without reading genotypes."""
    found = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("ind")).distinct()
    return found.selectExpr("concat('ind', cast(ind as string)) AS individual", "concat('pop', cast(ind % 3 as string)) AS population")


def callsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(callset_id, sample_id, individual): each individual has a sample for each run."""
    found = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("ind"), (F.col("l_linenumber") % 2 + 1).alias("run")).distinct()
    return found.selectExpr("cast(ind * 2 + run as int) AS callset_id", "concat('ind', cast(ind as string), '_run', cast(run as string)) AS sample_id", "concat('ind', cast(ind as string)) AS individual")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant_id, qual, filters, info) of the placed variants: not filtered, passed, or with two filters; some with a flag."""
    placed = variants(spark, sf_dir).where("start_site is not null")
    return placed.selectExpr(
        "variant_id", "cast(start_site % 400 / 4.0D as double) AS qual",
        "CASE start_site % 3 WHEN 0 THEN cast(null as array<string>) WHEN 1 THEN cast(array() as array<string>) ELSE array('q10', 'LowQual') END AS filters",
        "named_struct('AF', cast((start_site % 90 + 10) / 100.0D as double), 'DB', start_site % 2 = 0, 'NS', cast(CASE WHEN start_site % 5 > 0 THEN start_site % 20 END as int), 'SZ', array(cast(start_site % 7 as int), cast(null as int))) AS info",
    )


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant_id, synonym) of every third variant."""
    return read(spark, sf_dir, "part").where("p_partkey % 3 = 0").selectExpr("concat('v', cast(p_partkey as string)) AS variant_id", "concat('rs', cast(p_partkey as string)) AS synonym")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant_id, info) of the variants: an annotation each, of a gene and an effect."""
    return variants(spark, sf_dir).selectExpr(
        "variant_id", "map('ANN', concat_ws('|', 'G', CASE WHEN type = 'INDEL' THEN 'frameshift_variant' ELSE 'missense_variant' END, 'HIGH', CASE WHEN start_site % 2 = 0 THEN 'geneA' ELSE 'geneB' END)) AS info"
    )


def dataset(spark: SparkSession, sf_dir: str, **more) -> Dataset:
    """All of the above as one project; more: what else it has, or has in another form."""
    found = {"variants": variants(spark, sf_dir), "genotypes": genotypes(spark, sf_dir), "people": individuals(spark, sf_dir), "callsets": callsets(spark, sf_dir)}
    return Dataset(**(found | more))


def eigenstrat_genotypes(lines: DataFrame, individuals: list[str]) -> DataFrame:
    """(marker, individual, dosage) of lines (marker, line) with a character for each individual: reference alleles 0, 1 or 2, 9 is missing (null).

    Lines of another length, or with other characters, raise an error when they are read.
    """
    n = len(individuals)
    checked = F.when((F.length("line") == n) & F.col("line").rlike("^[0129]*$"), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("not a genotype line of the right length: "), "line")))
    cells = lines.select("marker", F.posexplode(F.split(checked, "")).alias("k", "code")).where("code <> ''")
    return cells.join(lookup(lines.sparkSession, list(enumerate(individuals)), "k int, individual string"), "k").select("marker", "individual", F.when(F.col("code") != "9", F.col("code").cast("int")).alias("dosage"))
