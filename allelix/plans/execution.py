"""Requests carried out: which variants, which genotypes of which entities, and the charts of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genotypes import natural_key
from ..operators import filters, vectors, windows
from ..operators.resolution import coherent
from ..runtime import lookup, written
from ..sources.dataset import Dataset
from .requests import ChartRequest, FieldPlotRequest, Group, SearchRequest


def entities(data: Dataset, samples: bool) -> DataFrame:
    """(individual, population) of all entities: individuals, or samples with their individual's population."""
    if not samples:
        return data.people.select("individual", "population")
    return data.callsets.join(data.people, "individual").select(F.col("sample_id").alias("individual"), "population").distinct()


def ploidy_of(data: Dataset, request: SearchRequest) -> int:
    """The ploidy of the request's projects (all, if it names none); projects that differ raise an error."""
    projects = request.projects or tuple(data.ploidies)
    found = {data.ploidies.get(p, 2) for p in projects} or {2}
    if len(found) > 1:
        raise ValueError(f"Inconsistent ploidy levels among projects {', '.join(map(str, projects))}: {sorted(found)}")
    return found.pop()


def genotypes_of(data: Dataset, request: SearchRequest, samples: bool) -> DataFrame:
    """Genotypes of the request's projects and runs, with the entity they belong to as `individual`; callsets of no known entity are left out."""
    found = filters.filter_runs(data.genotypes, request)
    if not samples:
        return found
    return found.drop("individual").join(data.callsets.select("callset_id", F.col("sample_id").alias("individual")), "callset_id")


def members_of(data: Dataset, groups: tuple[Group, ...], samples: bool) -> DataFrame:
    """(individual, number, name) of groups of entities; a group without any named has them all, and no group is one of all."""
    every, parts = entities(data, samples).select("individual"), []
    for k, group in enumerate(groups or (Group(),)):
        own = lookup(data.people.sparkSession, [(i,) for i in dict.fromkeys(group.individuals)], "individual string") if group.individuals else every
        parts.append(own.select("individual", F.lit(k).alias("number"), F.lit(group.name or f"Group {k + 1}").alias("name")))
    return reduce(DataFrame.unionAll, parts)


def with_thresholds(genotypes: DataFrame, groups: tuple[Group, ...]) -> DataFrame:
    """Genotypes with FORMAT fields below what a group of theirs asks for become missing; those of several groups must meet what each asks for."""
    for k, group in enumerate(groups):
        if group.field_thresholds:
            low = filters.filter_fields(genotypes.withColumn("_all", F.col("gt")), group)
            if group.individuals:
                members = lookup(genotypes.sparkSession, [(i, True) for i in dict.fromkeys(group.individuals)], f"individual string, _in{k} boolean")
                low = low.join(members, "individual", "left").withColumn("gt", F.when(F.col(f"_in{k}"), F.col("gt")).otherwise(F.col("_all"))).drop(f"_in{k}")
            genotypes = low.drop("_all")
    return genotypes


def group_sizes(data: Dataset, request: SearchRequest, samples: bool) -> list[int]:
    """How many entities each group has."""
    total = entities(data, samples).select("individual").distinct().count() if any(not g.individuals for g in request.groups) else 0
    return [len(set(g.individuals)) or total for g in request.groups]


def selected_variants(data: Dataset, request: SearchRequest, samples: bool = False) -> DataFrame:
    """The variants that fulfil all of a request: their own filters, annotations, and each group's conditions on genotypes.

    Genotypes are only read for groups that filter on them, and only those of variants that pass the rest; one pass over
    them serves all groups. A packed table answers without any shuffle of genotypes where no FORMAT field is asked for.
    """
    packed = usable(data, request, samples)
    found = filters.filter_variants(data.variants if packed is None else packed.table, request)
    if request.gene_names or request.variant_effects:
        found = found.join(filters.filter_annotations(data.variant_runs, request), "variant_id", "left_semi")
    if request.filters_genotypes:
        holds = lambda counts, plain: filters.all_groups_hold(request.groups, group_sizes(data, request, samples), counts, plain, ploidy_of(data, request))
        if packed is not None:
            found = packed_counts(packed.where(found), request).where(holds(F.col("counts"), F.col("counts")))
        else:
            genotypes = genotypes_of(data, request, samples).join(found.select("variant_id"), "variant_id", "left_semi")
            counted = filters.group_counts(genotypes, request.groups, data.placed)
            found = found.join(counted.where(holds(F.col("counts"), F.col("plain"))).select("variant_id"), "variant_id", "left_semi")
    return found if packed is None else found.select(*[c for c in packed.table.columns if c != "runs"])


def usable(data: Dataset, request: SearchRequest, samples: bool) -> vectors.Packed | None:
    """The packed table, if it has what a request needs."""
    packed = data.packed
    if packed is None or packed.samples != samples or any(g.field_thresholds for g in request.groups):
        return None
    return packed


def packed_counts(packed: vectors.Packed, request: SearchRequest) -> DataFrame:
    """The packed table's rows with counts: for each group, structs (gt, n); a request without groups has one of all."""
    found = vectors.agreed(packed, request.projects, request.runs)
    masks = [packed.mask(g.individuals or None) for g in request.groups or (Group(),)]
    return found.withColumn("counts", F.array(*[vectors.counts_of(m) for m in masks]))


@dataclass(frozen=True)
class Selection:
    """Variants, genotypes (with `population`: the group, if there are several) and the entities in natural order."""

    variants: DataFrame
    genotypes: DataFrame
    names: list[str]
    populations: dict[str, str | None]


def selection(data: Dataset, request: SearchRequest, samples: bool = False, selected: DataFrame | None = None) -> Selection:
    """What a request chooses. Entities are a dimension that fits the driver; an entity of several groups counts once. selected: its variants, if they are known."""
    chosen = members_of(data, request.groups, samples).select("individual").distinct()
    people = entities(data, samples).join(chosen, "individual", "left_semi").orderBy(natural_key(F.col("individual"))).collect()
    populations = {r["individual"]: r["population"] for r in people}
    variants = selected_variants(data, request, samples) if selected is None else selected
    genotypes = genotypes_of(data, request, samples).join(chosen, "individual", "left_semi")
    return Selection(variants, with_thresholds(genotypes, request.groups), list(populations), populations)


def bins_of(data: Dataset, request: ChartRequest, variants: DataFrame) -> windows.Bins:
    """The request's windows; bounds that it leaves open are those of the variants."""
    low, high = request.range_min, request.range_max
    if low < 0 or high < 0:
        found = filters.default_range(variants).first()
        low, high = (found["range_min"] if low < 0 else low), (found["range_max"] if high < 0 else high)
    return windows.Bins(1, 0, 1) if low is None or high is None else windows.Bins(low, high, request.intervals)


def chart(data: Dataset, request: ChartRequest, statistic: str, samples: bool = False, selected: DataFrame | None = None) -> DataFrame:
    """A window statistic (one of STATISTICS) of what a request chooses; selected: its variants, if they are known already.

    Groups are pooled, but for fst, which compares them; without groups it compares populations. Statistics of genotypes
    take variants of at most two alleles and the genotypes that agree for an entity. Genotypes below a group's least
    values of FORMAT fields are missing, for means of fields too.
    """
    packed = usable(data, request, samples) if selected is None else None
    if packed is not None and statistic != "field_mean":
        return packed_chart(data, packed, request, statistic)
    variants = selected_variants(data, request, samples) if selected is None else filters.filter_chart(selected, request)
    if statistic == "density":
        return windows.density(variants, bins_of(data, request, variants))
    # entities are a dimension that the driver holds; as a lookup they meet genotypes where these are
    spark, members = data.people.sparkSession, [(r["individual"], r["name"]) for r in members_of(data, request.groups, samples).collect()]
    names = list(dict.fromkeys(i for i, _ in members))
    pooled = lookup(spark, [(i,) for i in names], "individual string")
    if statistic == "field_mean":
        field = request.vcf_field if isinstance(request, FieldPlotRequest) else "dp"
        found = with_thresholds(genotypes_of(data, request, samples).join(pooled, "individual", "left_semi"), request.groups)
        if any(g.field_thresholds for g in request.groups):
            found = found.where("gt is not null")
        return windows.field_mean(variants, found, bins_of(data, request, variants), field)
    variants = variants.where(filters.biallelic())
    bins = bins_of(data, request, variants)
    genotypes = with_thresholds(genotypes_of(data, request, samples), request.groups).join(variants.select("variant_id"), "variant_id", "left_semi")
    resolved = coherent(genotypes.join(pooled, "individual", "left_semi"), data.placed)
    if statistic == "fst" and request.groups:
        resolved = resolved.drop("population").join(lookup(spark, members, "individual string, population string"), "individual")
    if statistic == "maf":
        return windows.minor_allele_frequency(variants, resolved, bins, ploidy_of(data, request))
    return STATISTICS[statistic](variants, resolved, bins, lambda: len(names))


def packed_chart(data: Dataset, packed: vectors.Packed, request: ChartRequest, statistic: str) -> DataFrame:
    """A chart of packed genotypes: one table is read, and what is shuffled is sums by window."""
    variants = selected_variants(data, request, packed.samples)
    if statistic == "density":
        return windows.density(variants, bins_of(data, request, variants))
    bins = bins_of(data, request, variants.where(filters.biallelic()))
    rows = filters.filter_variants(packed.table, request)
    if request.filters_genotypes or request.gene_names or request.variant_effects:
        rows = rows.join(variants.select("variant_id"), "variant_id", "left_semi")
    rows = rows.where(filters.biallelic() & F.col("start_site").between(bins.low, bins.high)).withColumn("bin_start", bins.of(F.col("start_site")))
    found = vectors.agreed(packed.where(rows), request.projects, request.runs)
    if statistic == "fst":
        if request.groups:
            masks = [packed.mask(g.individuals or None) for g in request.groups]
        else:
            of: dict[str, list[str]] = {}
            for r in entities(data, packed.samples).collect():  # a row for each entity
                of.setdefault(r["population"], []).append(r["individual"])
            masks = [packed.mask(tuple(names)) for _, names in sorted(of.items(), key=str)]
        cells = F.filter(F.array(*[vectors.counts_of(m) for m in masks]), lambda c: F.size(c) > 0)
        return windows.fst_of(found.select("variant_id", "bin_start", cells.alias("cells")), bins)
    named = {i for g in request.groups for i in g.individuals}
    pooled = None if not request.groups or any(not g.individuals for g in request.groups) else tuple(sorted(named))
    n = len(packed.entities) if pooled is None else len(named & set(packed.entities))
    found = found.select("bin_start", vectors.counts_of(packed.mask(pooled)).alias("counts"))
    if statistic == "tajima_d":
        return windows.tajima_d_of(found, bins, n)
    stats = filters.statistics_of(F.col("counts"), n, ploidy_of(data, request))
    sites = found.select("bin_start", *[F.nullif(stats[c], F.lit(0)).alias(c) if c == "called" else stats[c].alias(c) for c in ("called", "dosage", "het")])
    if statistic == "maf":
        return windows.maf_of(sites, bins)
    return windows.missing_of(sites, bins, n) if statistic == "missing" else windows.heterozygosity_of(sites, bins)


def packed_dataset(data: Dataset, table: DataFrame | None = None, samples: bool = False) -> Dataset:
    """The dataset with its packed table: the one given, as `vectors.pack` made it, or one written now to the shared folder."""
    names = tuple(r["individual"] for r in entities(data, samples).select("individual").distinct().orderBy(natural_key(F.col("individual")), "individual").collect())
    if table is None:
        table = written(vectors.pack(data.variants, genotypes_of(data, SearchRequest(), samples), names), "packed genotypes")
    return replace(data, packed=vectors.Packed(table, names, samples))


STATISTICS: dict[str, Callable[[DataFrame, DataFrame, windows.Bins, Callable[[], int]], DataFrame] | None] = {
    "density": None,
    "field_mean": None,
    "maf": None,
    "missing": lambda variants, resolved, bins, n: windows.missing_data(variants, resolved, bins, n()),
    "heterozygosity": lambda variants, resolved, bins, n: windows.heterozygosity(variants, resolved, bins),
    "fst": lambda variants, resolved, bins, n: windows.fst(variants, resolved, bins),
    "tajima_d": lambda variants, resolved, bins, n: windows.tajima_d(variants, resolved, bins, n()),
}
