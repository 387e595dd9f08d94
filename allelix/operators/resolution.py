"""One genotype for each variant and individual, where several callsets may disagree."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotypes import allele_indexes, natural_key, packed_parts, unpacked_parts

CELL = ["variant_id", "individual", "population"]


def same_codes(gt: Column, prefix: str) -> tuple[list[Column], Column]:
    """Aggregates, named by the prefix, over the genotype codes of a cell, and the code over these: null where codes differ or none is called."""
    parts = packed_parts(gt)
    sums = [f(p).alias(f"{prefix}{name}{k}") for k, p in enumerate(parts) for name, f in (("first", F.min), ("last", F.max))]
    first, last = ([F.col(f"{prefix}{name}{k}") for k in range(len(parts))] for name in ("first", "last"))
    return sums, F.when(reduce(and_, [a == b for a, b in zip(first, last, strict=True)]), unpacked_parts(first))


def coherent(genotypes: DataFrame, placed: bool = False) -> DataFrame:
    """(variant_id, individual, population, gt) where all called genotypes agree; others are left out.

    Rows meet by variant, so that statistics by variant need no other shuffle. placed: they lie together already, as
    those of a table in buckets by variant do.
    """
    called = genotypes.where("gt is not null")
    sums, gt = same_codes(F.col("gt"), "")
    cells = (called if placed else called.repartition("variant_id")).groupBy(*CELL)
    return cells.agg(*sums).select(*CELL, gt.alias("gt")).where("gt is not null")


def gathered(genotypes: DataFrame, rule: Callable[[Column, tuple[str, ...]], dict[str, Column]], fields: tuple[str, ...] = (), key: tuple[str, ...] = ("individual", "population")) -> DataFrame:
    """(variant_id, cells): a row a variant, and in it, in order of the key, structs of the key's columns and what the rule makes of a cell.

    Rows meet once, by variant; all that follows takes place within the row, in time in proportion to it, but for sorting.
    rule: of `found`, the cell's structs (gt, n, fields) of the called genotypes, most frequent first, then by code; of a
    field, the largest value.
    """
    def begins(of: Column, same: tuple[str, ...]) -> Column:
        """Where stretches of structs that agree in some columns begin."""
        first = lambda i: (i == 0) | ~reduce(and_, [F.get(of, i - 1)[c].eqNullSafe(F.get(of, i)[c]) for c in same])
        return F.filter(F.sequence(F.lit(0), F.size(of) - 1), first)

    def by_code(calls: Column, at: Column) -> Column:
        def counted(i: Column, j: Column) -> Column:
            n, call = F.coalesce(F.get(at, j + 1), F.size(calls)) - i, F.get(calls, i)
            largest = lambda f: F.when(n == 1, call[f]).otherwise(F.array_max(F.transform(F.slice(calls, i + 1, n), lambda c: c[f])))
            called = F.when(call["gt"].isNull(), 0).otherwise(n)
            return F.struct(*[call[c].alias(c) for c in key], (-called).alias("rank"), call["gt"].alias("gt"), called.alias("n"), *[largest(f).alias(f) for f in fields])

        return F.sort_array(F.transform(at, counted))

    def by_cell(runs: Column, at: Column) -> Column:
        def cell(i: Column, j: Column) -> Column:
            found = F.filter(F.slice(runs, i + 1, F.coalesce(F.get(at, j + 1), F.size(runs)) - i), lambda r: r["n"] > 0)
            judged = lambda f: F.struct(*[F.get(runs, i)[c].alias(c) for c in key], *[x.alias(name) for name, x in rule(f, fields).items()])
            return named_once(found, judged)

        return F.transform(at, cell)

    calls = F.sort_array(F.collect_list(F.struct(*key, "gt", *fields)))
    runs = lambda calls: named_once(begins(calls, (*key, "gt")), lambda at: by_code(calls, at))
    cells = lambda runs: named_once(begins(runs, key), lambda at: by_cell(runs, at))
    # all in the aggregate: conditions on what follows from cells don't repeat any of it
    found = named_once(calls, lambda c: named_once(runs(c), cells))
    return genotypes.repartition("variant_id").groupBy("variant_id").agg(found.alias("cells"))


def named_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def most_frequent(found: Column, fields: tuple[str, ...]) -> dict[str, Column]:
    """A rule: the most frequent genotype, with its fields; null where two are equally frequent or none is called."""
    top, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    sure = F.coalesce(top["n"] != second["n"], F.lit(True))
    return {"gt": F.when(sure, top["gt"]), "conflict": F.size(found) > 1, **{f: F.when(sure, top[f]) for f in fields}}


def of_two_counts(found: Column, fields: tuple[str, ...]) -> dict[str, Column]:
    """A rule, that of BayPass: a single genotype, or the most frequent if the genotypes' counts take exactly two values."""
    accepted = (F.size(found) == 1) | (F.size(F.array_distinct(F.transform(found, lambda f: f["n"]))) == 2)
    return {"gt": F.when(accepted, F.get(found, F.lit(0))["gt"]), "conflict": F.size(found) > 1}


def cells_of(rows: DataFrame) -> DataFrame:
    """A row a cell, of gathered ones."""
    return rows.select("variant_id", F.explode_outer("cells").alias("c")).select("variant_id", "c.*")


def majority(genotypes: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """(variant_id, individual, population, gt, conflict, fields): the most frequent genotype; gt is null where two are equally frequent or none is called."""
    return cells_of(gathered(genotypes, most_frequent, fields))


def by_count_values(genotypes: DataFrame) -> DataFrame:
    """The BayPass rule: a single genotype, or the most frequent if the genotypes' counts take exactly two values."""
    return cells_of(gathered(genotypes, of_two_counts))


def dissimilar(resolved: DataFrame, exported: Column | None = None) -> DataFrame:
    """(ord, line) for each cell with dissimilar genotypes; resolved: cells with `name`, `ord` and the columns that `exported`, what a format writes, takes."""
    best = F.lit("Exporting most frequent") if exported is None else F.concat(F.lit("Exporting most frequent: "), exported.cast("string"))
    line = F.concat(F.lit("- Dissimilar genotypes found for variant "), "name", F.lit(", individual "), "individual", F.lit(". "), F.when(F.col("gt").isNull(), "Exporting as missing data").otherwise(best))
    return resolved.where("conflict").select(_cell_order(), line.alias("line"))


def many_alleles(resolved: DataFrame) -> DataFrame:
    """(ord, line) for each called genotype of over two alleles."""
    line = F.concat(F.lit("- More than 2 alleles found for variant "), "name", F.lit(", individual "), "individual", F.lit(". Exporting only the first 2 alleles."))
    return resolved.where(F.size(allele_indexes(F.col("gt"))) > 2).select(_cell_order(), line.alias("line"))


def multi_allelic(variants: DataFrame) -> DataFrame:
    """(ord, line) for each variant (name, ord, alleles) with over two known alleles."""
    line = F.concat(F.lit("- Variant "), "name", F.lit(" is multi-allelic. Make sure Eigenstrat genotype encoding specifications are suitable for you."))
    return variants.where(F.size("alleles") > 2).select("ord", line.alias("line"))


def _cell_order() -> Column:
    return F.concat("ord", F.lit(" "), natural_key(F.col("individual"))).alias("ord")
