"""Variant filters, and filters on the genotypes of groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotypes import dosage_by_order, is_heterozygous, is_homozygous_reference, is_homozygous_variant, middle_code, natural_key
from ..plans.requests import ChartRequest, Group, SearchRequest
from ..runtime import lookup
from .resolution import coherent, same_codes


def type_filter(types: tuple[str, ...]) -> Column:
    return F.col("type").isin(*types)


def sequence_filter(sequences: tuple[str | None, ...]) -> Column:
    named = [s for s in sequences if s]
    parts = ([F.col("chrom").isin(*named)] if named else []) + ([F.col("chrom").isNull()] if len(named) < len(sequences) else [])
    return reduce(or_, parts)


def position_filter(start: int, end: int, only_snps: bool) -> Column:
    """Variants that start in [start, end], and, unless all are SNPs, those that only reach into it; -1 is no bound."""
    parts = []
    if start >= 0:
        inside = F.col("start_site") >= start
        parts.append(inside if only_snps else inside | (F.col("end_site") >= start))
    if end >= 0:
        parts.append(F.col("start_site") <= end)
    return reduce(and_, parts)


def allele_count_filter(counts: tuple[int, ...]) -> Column:
    return F.size("alleles").isin(*counts)


def biallelic() -> Column:
    return F.size("alleles") < 3


def filter_variants(variants: DataFrame, request: SearchRequest, ids: DataFrame | None = None) -> DataFrame:
    """The variants (variant_id, type, chrom, start_site, end_site, alleles) that pass; ids: those to keep, as a table of variant_id."""
    parts = []
    if request.variant_types:
        parts.append(type_filter(request.variant_types))
    if request.sequences:
        parts.append(sequence_filter(request.sequences))
    if request.start >= 0 or request.end >= 0:
        parts.append(position_filter(request.start, request.end, set(request.variant_types) == {"SNP"}))
    if request.allele_counts:
        parts.append(allele_count_filter(request.allele_counts))
    if isinstance(request, ChartRequest):
        parts += chart_parts(request)
    found = variants.where(reduce(and_, parts)) if parts else variants
    if request.variant_ids:
        found = found.join(lookup(variants.sparkSession, [(i,) for i in dict.fromkeys(request.variant_ids)], "variant_id string"), "variant_id", "left_semi")
    return found.join(ids.select("variant_id").distinct(), "variant_id", "left_semi") if ids is not None else found


def chart_parts(request: ChartRequest) -> list[Column]:
    parts = []
    if request.displayed_sequence is not None:
        parts.append(F.col("chrom") == request.displayed_sequence)
    if request.displayed_type is not None:
        parts.append(F.col("type") == request.displayed_type)
    if request.range_min >= 0:
        parts.append(F.col("start_site") >= request.range_min)
    if request.range_max >= 0:
        parts.append(F.col("start_site") <= request.range_max)
    return parts


def filter_chart(variants: DataFrame, request: ChartRequest) -> DataFrame:
    """Of variants that are chosen already, those that a chart shows."""
    parts = chart_parts(request)
    return variants.where(reduce(and_, parts)) if parts else variants


def filter_runs(genotypes: DataFrame, request: SearchRequest) -> DataFrame:
    """Genotypes of the projects, and of the (project, run) pairs if any are named."""
    if request.projects:
        genotypes = genotypes.where(F.col("project_id").isin(*request.projects))
    if request.runs:
        genotypes = genotypes.where(reduce(or_, [(F.col("project_id") == p) & (F.col("run_name") == r) for p, r in request.runs]))
    return genotypes


def filter_annotations(variant_runs: DataFrame, request: SearchRequest) -> DataFrame:
    """variant_id of the variants with an annotation (info: ANN, CSQ or EFF) that names one of the genes, and one of the effects."""
    found = variant_runs.select("variant_id", F.concat_ws(",", *[F.col("info")[k] for k in ("ANN", "CSQ", "EFF")]).alias("notes"))
    notes = F.split("notes", ",")
    fits = lambda names: F.exists(notes, lambda n: F.arrays_overlap(F.split(n, r"[|&(]"), F.array(*map(F.lit, names))))
    for names in (request.gene_names, request.variant_effects):
        if names:
            found = found.where(fits(names))
    return found.select("variant_id").distinct()


def filter_fields(genotypes: DataFrame, group: Group) -> DataFrame:
    """Genotypes with a FORMAT field (a column) below the group's least value, or without it, become missing."""
    low = [F.coalesce(F.col(f) < least, F.lit(True)) for f, least in group.field_thresholds.items()]
    return genotypes.withColumn("gt", F.when(~reduce(or_, low), F.col("gt"))) if low else genotypes


def of_group(genotypes: DataFrame, group: Group) -> DataFrame:
    if not group.individuals:
        return genotypes
    return genotypes.join(lookup(genotypes.sparkSession, [(i,) for i in dict.fromkeys(group.individuals)], "individual string"), "individual", "left_semi")


def group_statistics(resolved: DataFrame, n_individuals: int) -> DataFrame:
    """Per variant: n called, n_distinct and n_mode genotypes, missing, heterozygosity and maf in per cent, hom_ref and hom_var counts."""
    called = resolved.where("gt is not null")
    by_code = called.groupBy("variant_id", "gt").agg(F.count("*").alias("n"))
    per = by_code.groupBy("variant_id").agg(
        F.sum("n").alias("n_called"), F.count("*").alias("n_distinct"), F.max("n").alias("n_mode"),
        F.min_by("gt", F.struct(-F.col("n"), "gt")).alias("mode"),
        F.sum(F.when(is_heterozygous(F.col("gt")), F.col("n")).otherwise(0)).alias("n_het"),
        F.sum(F.when(is_homozygous_reference(F.col("gt")), F.col("n")).otherwise(0)).alias("n_hom_ref"),
        F.sum(F.when(is_homozygous_variant(F.col("gt")), F.col("n")).otherwise(0)).alias("n_hom_var"),
        F.sum(dosage_by_order(F.col("gt")) * F.col("n")).alias("dosage"),
    )
    share = F.try_divide(50 * F.col("dosage"), F.col("n_called"))
    return per.select(
        "*", F.try_divide(100 * (n_individuals - F.col("n_called")), F.lit(n_individuals)).alias("missing"), F.try_divide(100 * F.col("n_het"), F.col("n_called")).alias("heterozygosity"), F.least(share, 100 - share).alias("maf")
    )


def pattern_holds(pattern: str, most_same_ratio: float = 100, of: Callable[[str], Column] = F.col) -> Column:
    """Over group_statistics, by the names that `of` takes; a variant without called genotypes fits nothing but Any."""
    n, distinct = of("n_called"), of("n_distinct")
    return {
        "Any": F.lit(True),
        "Not all the same": distinct > 1,
        "All or mostly the same": F.try_divide(100 * of("n_mode"), n) >= most_same_ratio,
        "All different": distinct == n,
        "Not all different": distinct < n,
        "All Homozygous Ref": of("n_hom_ref") == n,
        "Some Homozygous Ref": of("n_hom_ref") > 0,
        "All Homozygous Var": of("n_hom_var") == n,
        "Some Homozygous Var": of("n_hom_var") > 0,
    }[pattern]


def group_holds(group: Group, of: Callable[[str], Column] = F.col) -> Column:
    """Whether a group's conditions, but for discrimination, hold; variants without called genotypes fulfil none."""
    within = [of(c).between(*limits) for c, limits in (("missing", group.missing), ("heterozygosity", group.heterozygosity), ("maf", group.maf))]
    return reduce(and_, [of("n_called") > 0, pattern_holds(group.pattern, group.most_same_ratio, of), *within])


def filter_group(genotypes: DataFrame, group: Group, n_individuals: int) -> DataFrame:
    """variant_id of the variants whose genotypes in the group fulfil all its conditions."""
    stats = group_statistics(coherent(of_group(filter_fields(genotypes, group), group)), n_individuals)
    return stats.where(group_holds(group)).select("variant_id")


def group_counts(genotypes: DataFrame, groups: tuple[Group, ...], placed: bool = False) -> DataFrame:
    """(variant_id, counts, plain): for each group, in order, structs (gt, n) of what agrees for its individuals; plain: without regard to FORMAT fields.

    Membership is a mask of bits beside each genotype, from which a group's bit goes where a field is below its least
    value. One pass resolves the cells for all groups at once (and once for each that has least values), counts genotypes
    by group, and gathers the few counts of a variant: genotypes are shuffled once, whatever the number of groups.
    """
    if len(groups) > 62:
        raise ValueError("at most 62 groups")
    bit = lambda k: 1 << k
    everyone = sum(bit(k) for k, g in enumerate(groups) if not g.individuals)
    masks: dict[str, int] = {}
    for k, g in enumerate(groups):
        for i in dict.fromkeys(g.individuals):
            masks[i] = masks.get(i, 0) | bit(k)
    known = genotypes.where("gt is not null")
    if masks:
        members = lookup(genotypes.sparkSession, list(masks.items()), "individual string, mask long")
        known = known.join(members, "individual", "left" if everyone else "inner")
        known = known.withColumn("mask", F.coalesce("mask", F.lit(0)).bitwiseOR(F.lit(everyone)).cast("long"))
    else:
        known = known.withColumn("mask", F.lit(everyone).cast("long"))
    # which genotypes count: all of them, and for each group with least values its own
    valid = [F.lit(True)] + [~reduce(or_, [F.coalesce(F.col(f) < least, F.lit(True)) for f, least in g.field_thresholds.items()]) for g in groups if g.field_thresholds]
    judged = {k: 1 + n for n, k in enumerate(k for k, g in enumerate(groups) if g.field_thresholds)}
    cells = (known if placed else known.repartition("variant_id")).groupBy("variant_id", "individual", "mask")
    agreed, sums = [], []
    for n, v in enumerate(valid):
        more, gt = same_codes(F.when(v, F.col("gt")) if n else F.col("gt"), f"c{n}_")
        sums += more
        agreed.append(F.struct(F.lit(n).alias("judged"), gt.alias("gt")))
    each = cells.agg(*sums).select("variant_id", "mask", F.explode(F.array(*agreed)).alias("c")).where("c.gt is not null")
    own = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(bit(k)).cast("long")) != 0, 1).otherwise(0)).alias(f"n{k}") for k in range(len(groups))]
    codes = each.groupBy("variant_id", F.col("c.judged").alias("judged"), F.col("c.gt").alias("gt")).agg(*own)
    gathered = codes.groupBy("variant_id").agg(F.collect_list(F.struct("judged", "gt", *[f"n{k}" for k in range(len(groups))])).alias("all"))

    def counts(k: int, which: int) -> Column:
        return F.transform(F.filter("all", lambda c: (c["judged"] == which) & (c[f"n{k}"] > 0)), lambda c: F.struct(c["gt"].alias("gt"), c[f"n{k}"].alias("n")))

    return gathered.select("variant_id", F.array(*[counts(k, judged.get(k, 0)) for k in range(len(groups))]).alias("counts"), F.array(*[counts(k, 0) for k in range(len(groups))]).alias("plain"))


def all_groups_hold(groups: tuple[Group, ...], totals: list[int], counts: Column, plain: Column, ploidy: int = 2) -> Column:
    """Whether the conditions of all groups hold, from their counts of genotypes; totals: how many individuals each has."""
    parts = [F.lit(True)]
    for k, group in enumerate(groups):
        if group.pattern != "Any" or group.missing != (0, 100) or group.heterozygosity != (0, 100) or group.maf != (0, 50):
            parts.append(group_holds(group, statistics_of(counts[k], totals[k], ploidy).__getitem__))
        for other in group.apart_from:
            parts.append(mode_of(plain[k]) != mode_of(plain[other]))
    return F.coalesce(reduce(and_, parts), F.lit(False))


def mode_of(counts: Column) -> Column:
    """The most frequent genotype; the smaller code breaks ties."""
    return F.try_element_at(F.sort_array(F.transform(counts, lambda c: F.struct((-c["n"]).alias("rank"), c["gt"].alias("gt")))), F.lit(1))["gt"]


def statistics_of(counts: Column, n_individuals: int, ploidy: int = 2) -> dict[str, Column]:
    """What group_statistics gives, from counts: structs (gt, n) of a variant's genotypes."""
    total = lambda f: F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + F.coalesce(f(c), F.lit(0)).cast("long"))
    called, dosage = total(lambda c: c["n"]), total(lambda c: dosage_by_order(c["gt"], middle_code(ploidy)) * c["n"])
    het = total(lambda c: F.when(is_heterozygous(c["gt"]), c["n"]))
    share = F.try_divide(50 * dosage, called)
    return {
        "n_called": called, "called": called, "n_distinct": F.size(counts), "n_mode": F.array_max(F.transform(counts, lambda c: c["n"])), "mode": mode_of(counts),
        "n_het": het, "het": het, "n_hom_ref": total(lambda c: F.when(is_homozygous_reference(c["gt"]), c["n"])), "n_hom_var": total(lambda c: F.when(is_homozygous_variant(c["gt"]), c["n"])),
        "dosage": dosage, "missing": F.try_divide(100 * (n_individuals - called), F.lit(n_individuals)), "heterozygosity": F.try_divide(100 * het, called), "maf": F.least(share, 100 - share),
    }


def discriminate(genotypes: DataFrame, one: Group, other: Group) -> DataFrame:
    """variant_id of the variants whose most frequent genotype differs between two groups; the smaller code breaks ties."""
    found = group_counts(genotypes, (Group(individuals=one.individuals), Group(individuals=other.individuals)))
    return found.where(mode_of(F.col("plain")[0]) != mode_of(F.col("plain")[1])).select("variant_id")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one of two tables of the same columns that the other lacks."""
    return a.subtract(b).unionAll(b.subtract(a))


def marker_order(variants: DataFrame) -> DataFrame:
    """By sequence in natural order, then start and id; unplaced variants last."""
    return variants.orderBy(natural_key(F.col("chrom")).asc_nulls_last(), F.col("start_site").asc_nulls_last(), "variant_id")


def page(variants: DataFrame, request: SearchRequest) -> DataFrame:
    by = F.col(request.sort_by or "variant_id")
    return variants.orderBy(by.desc() if request.descending else by.asc(), "variant_id").offset(request.page * request.page_size).limit(request.page_size)


def default_range(variants: DataFrame) -> DataFrame:
    return variants.agg(F.min("start_site").alias("range_min"), F.max("start_site").alias("range_max"))
