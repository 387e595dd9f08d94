"""Windows over positions, and statistics of the variants in them; all windows of a chart come from one aggregation."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotypes import allele_indexes, dosage_by_order, is_heterozygous, middle_code


class Bins:
    """Windows [start, start + size) over [low, high], the last one closed; one window if low equals high, none if it is beyond."""

    def __init__(self, low: int, high: int, intervals: int):
        self.low, self.high = low, high
        self.count = 0 if high < low else max(1, min(high - low, max(1, intervals)))
        self.size = max(1, ceil((high - low) / self.count)) if self.count else 1

    def of(self, site: Column) -> Column:
        number = F.least(F.floor((site - self.low) / self.size), F.lit(self.count - 1))
        return (self.low + number * self.size).cast("long")

    def spine(self, like: DataFrame) -> DataFrame:
        return like.sparkSession.range(self.low, self.low + self.count * self.size, self.size).select(F.col("id").alias("bin_start"))

    def binned(self, variants: DataFrame) -> DataFrame:
        return variants.where(F.col("start_site").between(self.low, self.high)).select("variant_id", self.of(F.col("start_site")).alias("bin_start"))

    def filled(self, found: DataFrame) -> DataFrame:
        return self.spine(found).join(found, "bin_start", "left")


def density(variants: DataFrame, bins: Bins) -> DataFrame:
    """(bin_start, variants): how many variants; none is 0."""
    found = bins.binned(variants).groupBy("bin_start").agg(F.count("*").alias("variants"))
    return bins.filled(found).select("bin_start", F.coalesce("variants", F.lit(0)).alias("variants"))


def per_variant(resolved: DataFrame, ploidy: int = 2) -> DataFrame:
    """Per variant: called individuals, dosage and heterozygotes; needs no shuffle after resolution. Haploid dosages compare with 1, others with 0/1."""
    called = resolved.where("gt is not null")
    return called.groupBy("variant_id").agg(F.count("*").alias("called"), F.sum(dosage_by_order(F.col("gt"), middle_code(ploidy))).alias("dosage"), F.sum(is_heterozygous(F.col("gt")).cast("int")).alias("het"))


def in_bins(variants: DataFrame, resolved: DataFrame, bins: Bins, ploidy: int = 2) -> DataFrame:
    return bins.binned(variants).join(per_variant(resolved, ploidy), "variant_id", "left")


def minor_allele_frequency(variants: DataFrame, resolved: DataFrame, bins: Bins, ploidy: int = 2) -> DataFrame:
    """(bin_start, maf) in per cent: the mean over variants with calls; null without."""
    return maf_of(in_bins(variants, resolved, bins, ploidy), bins)


def maf_of(sites: DataFrame, bins: Bins) -> DataFrame:
    """The same of sites (bin_start, called, dosage)."""
    share = F.try_divide(50 * F.col("dosage"), F.col("called"))
    found = sites.groupBy("bin_start").agg(F.avg(F.when(share <= 50, share).otherwise(100 - share)).alias("mean"))
    return bins.filled(found).select("bin_start", F.least("mean", 100 - F.col("mean")).alias("maf"))


def missing_data(variants: DataFrame, resolved: DataFrame, bins: Bins, n_individuals: int) -> DataFrame:
    """(bin_start, missing) in per cent of variants times individuals; null without variants."""
    return missing_of(in_bins(variants, resolved, bins), bins, n_individuals)


def missing_of(sites: DataFrame, bins: Bins, n_individuals: int) -> DataFrame:
    """The same of sites (bin_start, called)."""
    cells = F.count("*") * n_individuals
    found = sites.groupBy("bin_start").agg(F.try_divide(100 * (cells - F.coalesce(F.sum("called"), F.lit(0))), cells).alias("missing"))
    return bins.filled(found).select("bin_start", "missing")


def heterozygosity(variants: DataFrame, resolved: DataFrame, bins: Bins) -> DataFrame:
    """(bin_start, heterozygosity) in per cent: the mean over variants with calls of their share of heterozygotes."""
    return heterozygosity_of(in_bins(variants, resolved, bins), bins)


def heterozygosity_of(sites: DataFrame, bins: Bins) -> DataFrame:
    """The same of sites (bin_start, called, het)."""
    found = sites.groupBy("bin_start").agg((100 * F.avg(F.try_divide("het", "called"))).alias("heterozygosity"))
    return bins.filled(found).select("bin_start", "heterozygosity")


def field_mean(variants: DataFrame, genotypes: DataFrame, bins: Bins, field: str) -> DataFrame:
    """(bin_start, mean): the integer quotient of the sum of a FORMAT field over all callsets by how many have it; 0 without."""
    found = bins.binned(variants).join(genotypes.select("variant_id", field), "variant_id").groupBy("bin_start").agg(F.sum(field).alias("total"), F.count(field).alias("n"))
    return bins.filled(found).select("bin_start", F.when(F.col("n") > 0, F.floor(F.col("total") / F.col("n"))).otherwise(0).cast("long").alias("mean"))


def fst(variants: DataFrame, resolved: DataFrame, bins: Bins, textbook: bool = False) -> DataFrame:
    """(bin_start, fst): the ratio of summed variance components between populations, by Weir and Cockerham; null without data.

    Every allele up to the largest of a variant counts in every population, absent ones with frequency 0; variants with
    data in one population are skipped. textbook: divide all of n_c by r - 1; else its correction alone, which differs
    for three populations or more.
    """
    codes = resolved.where("gt is not null").groupBy("variant_id", "population", "gt").agg(F.count("*").alias("n"))
    cells = codes.groupBy("variant_id", "population").agg(F.collect_list(F.struct("gt", "n")).alias("counts"))
    sites = bins.binned(variants).join(cells.groupBy("variant_id").agg(F.collect_list("counts").alias("cells")), "variant_id")
    return fst_of(sites, bins, textbook)


def fst_of(sites: DataFrame, bins: Bins, textbook: bool = False) -> DataFrame:
    """The same of sites (variant_id, bin_start, cells), where cells has, of each population with calls, structs (gt, n)."""
    gts = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.transform(c, lambda g: g["gt"]))))
    sized = sites.where(F.size("cells") > 1).withColumn("top", F.array_max(F.flatten(F.transform(gts, allele_indexes)))).withColumn("r", F.size("cells").cast("double"))
    count = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, g: s + g["n"] * f(g["gt"]))
    cells = F.transform(
        "cells",
        lambda c: F.struct(
            count(c, lambda gt: F.lit(1)).alias("n"),
            F.transform(F.sequence(F.lit(0), "top"), lambda a: count(c, lambda gt: F.size(F.filter(allele_indexes(gt), lambda x: x == a)))).alias("alleles"),
            F.transform(F.sequence(F.lit(0), "top"), lambda a: count(c, lambda gt: F.when(is_heterozygous(gt) & F.array_contains(allele_indexes(gt), a), 1).otherwise(0))).alias("hets"),
        ),
    )
    grid = sized.withColumn("cells", cells).select("variant_id", "bin_start", "r", "cells", F.explode(F.sequence(F.lit(0), "top")).alias("allele"))
    of = lambda c, name: F.get(c[name], F.col("allele"))
    total = lambda f: F.aggregate("cells", F.lit(0.0), lambda s, c: s + f(c))
    p = lambda c: of(c, "alleles") / (2 * c["n"])
    sums = grid.select(
        "variant_id", "bin_start", "r", total(lambda c: c["n"]).alias("t"), total(lambda c: c["n"] * c["n"]).alias("nn"), total(lambda c: c["n"] * p(c)).alias("np"),
        total(lambda c: c["n"] * p(c) * p(c)).alias("npp"), total(lambda c: of(c, "hets")).alias("nh"),
    )
    c = F.col
    base = sums.select("variant_id", "bin_start", "r", "t", (c("t") / c("r")).alias("n"), ((c("t") - c("nn") / c("t")) / (c("r") - 1) if textbook else c("t") - (c("nn") / c("t")) / (c("r") - 1)).alias("nc"), F.least(c("np") / c("t"), F.lit(1.0)).alias("p"), (c("nh") / c("t")).alias("h"), "npp")
    base = base.withColumn("s2", (c("npp") - c("t") * c("p") * c("p")) / (c("n") * (c("r") - 1)))
    spread = c("p") * (1 - c("p")) - c("s2") * (c("r") - 1) / c("r")
    parts = base.select(
        "variant_id", "bin_start",
        F.try_divide(c("n"), c("nc")).alias("ratio"),
        (c("s2") - F.try_divide(spread - c("h") / 4, c("n") - 1)).alias("inner"),
        F.try_divide(c("n") * (spread - c("h") * (2 * c("n") - 1) / (4 * c("n"))), c("n") - 1).alias("b"),
        (c("h") / 2).alias("c"),
    ).select("bin_start", (c("ratio") * c("inner")).alias("a"), "b", "c").where("a is not null and b is not null")
    found = parts.groupBy("bin_start").agg(F.try_divide(F.sum("a"), F.sum(c("a") + c("b") + c("c"))).alias("fst"))
    return bins.filled(found).select("bin_start", "fst")


def tajima_d(variants: DataFrame, resolved: DataFrame, bins: Bins, n_individuals: int) -> DataFrame:
    """(bin_start, segregating_sites, tajima_d): sites with exactly two alleles among the called; D is null without any, or without individuals."""
    codes = resolved.where("gt is not null").groupBy("variant_id", "gt").agg(F.count("*").alias("n"))
    counts = codes.groupBy("variant_id").agg(F.collect_list(F.struct("gt", "n")).alias("counts"))
    return tajima_d_of(bins.binned(variants).join(counts, "variant_id"), bins, n_individuals)


def tajima_d_of(sites: DataFrame, bins: Bins, n_individuals: int) -> DataFrame:
    """The same of sites (bin_start, counts), where counts has structs (gt, n)."""
    alleles = F.array_distinct(F.flatten(F.transform("counts", lambda g: allele_indexes(g["gt"]))))
    of = lambda a: F.aggregate("counts", F.lit(0).cast("long"), lambda s, g: s + g["n"] * F.size(F.filter(allele_indexes(g["gt"]), lambda x: x == a)))
    segregating = sites.withColumn("n", F.transform(alleles, of)).where(F.size("n") == 2)
    most, every = F.array_max("n"), F.get("n", F.lit(0)) + F.get("n", F.lit(1))
    k = most / every * (1 - most / every)
    found = segregating.groupBy("bin_start").agg(F.count("*").alias("s"), F.sum(k).alias("k"))
    n = 2 * n_individuals
    if n < 2:
        return bins.filled(found).select("bin_start", F.coalesce("s", F.lit(0)).alias("segregating_sites"), F.lit(None).cast("double").alias("tajima_d"))
    a1, a2 = sum(1 / i for i in range(1, n)), sum(1 / i**2 for i in range(1, n))
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1, c2 = b1 - 1 / a1, b2 - (n + 2) / (a1 * n) + a2 / a1**2
    e1, e2 = c1 / a1, c2 / (a1**2 + a2)
    s = F.col("s")
    d = F.try_divide(F.col("k") * 2 * n / (n - 1) - s / a1, F.sqrt(F.abs(e1 * s + e2 * s * (s - 1))))
    return bins.filled(found).select("bin_start", F.coalesce("s", F.lit(0)).alias("segregating_sites"), d.alias("tajima_d"))
