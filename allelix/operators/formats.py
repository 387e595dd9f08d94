"""Lines of the exchange formats, from a marker table with one array of genotypes a variant; `exports` makes whole archives of them.

Marker-oriented formats are projections of that table. Individual-oriented ones turn it around with one shuffle of
cells by individual; `pieces` of a line (by sequence) keep rows bounded where a genome doesn't fit one string.
Every function returns (ord, line), or a column for the line's owner before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import floor, log10

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

from ..functions.genotypes import allele_indexes, allele_strings, natural_key, reference_code, vcf_quality, vcf_value
from ..runtime import lookup
from .matrix import dense, placed
from .resolution import gathered, most_frequent

#: Fixed names and numbers of the formats.
HAPMAP_HEADER = ("rs#", "alleles", "chrom", "pos", "strand", "assembly#", "center", "protLSID", "assayLSID", "panelLSID", "QCcode")
SEQUENCE_ONTOLOGY = {"SNP": "SO:0000694", "INDEL": "SO:1000032", "MIXED": "SO:0001059", "SYMBOLIC": "SO:0000109", "MNP": "SO:0001059"}


def site_table(variants: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Variants with `name`, the synonym or the id, and `ord` (natural order of place, then id)."""
    found = variants
    if synonyms is not None:
        found = found.join(synonyms.groupBy("variant_id").agg(F.min("synonym").alias("synonym")), "variant_id", "left")
    name = F.coalesce("synonym", "variant_id") if synonyms is not None else F.col("variant_id")
    return found.select(
        "variant_id", name.alias("name"), "type", "chrom", "start_site", "end_site", "alleles",
        F.concat(F.coalesce(natural_key(F.col("chrom")), F.lit("~")), F.lit(" "), F.lpad(F.coalesce("start_site", F.lit(0)).cast("string"), 20, "0"), F.lit(" "), "variant_id").alias("ord"),
    )


def marker_table(variants: DataFrame, resolved: DataFrame, individuals: list[str], synonyms: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """site_table with `gts`, all null where a variant has no genotypes, and arrays of more columns of the resolved genotypes.

    resolved: a row a cell, or a row a variant as `resolved_rows` gives them, which needs no further shuffle.
    """
    nothing = F.array_repeat(F.lit(None).cast("string"), len(individuals))
    table = placed(resolved, len(individuals), more) if "cells" in resolved.columns else dense(resolved, individuals, more)
    found = site_table(variants, synonyms).join(table, "variant_id", "left")
    return found.withColumns({c: F.coalesce(c, nothing) for c in ("gts", *more)})


def resolved_rows(genotypes: DataFrame, individuals: list[str], rule: Callable = most_frequent, fields: tuple[str, ...] = ()) -> DataFrame:
    """`resolution.gathered` of these individuals, by their numbers k: a row a variant, from one shuffle of genotypes."""
    numbers = lookup(genotypes.sparkSession, list(enumerate(individuals)), "k int, individual string")
    return gathered(genotypes.join(numbers, "individual").select("variant_id", "k", "gt", *fields), rule, fields, ("k",))


def chrom() -> Column:
    return F.coalesce("chrom", F.lit("0"))


def pos() -> Column:
    return F.coalesce("start_site", F.lit(0)).cast("string")


def headed(lines: DataFrame, *head: str) -> DataFrame:
    """Lines that sort before all others."""
    rows = [(f" {k:04d}", line) for k, line in enumerate(head)]
    return lines.sparkSession.createDataFrame(rows, "ord string, line string").unionAll(lines.select("ord", "line"))


def one_genotype(gt: Column, separator: str, missing: str, snp_separator: str | None = None) -> Column:
    """A genotype's alleles; SNPs may have a separator of their own."""
    named = allele_strings(gt, F.col("alleles"))
    text = F.array_join(named, separator)
    if snp_separator is not None:
        text = F.when(F.col("type") == "SNP", F.array_join(named, snp_separator)).otherwise(text)
    return F.coalesce(F.when(gt.isNotNull(), text), F.lit(missing))


def genotype_text(separator: str, missing: str, snp_separator: str | None = None) -> Column:
    """All genotypes' alleles."""
    return F.transform("gts", lambda g: one_genotype(g, separator, missing, snp_separator))


def hapmap(markers: DataFrame, individuals: list[str], assembly: str | None = None, columns: bool = True, indexes: bool = False, separator: bool = False, empty_missing: bool = False) -> DataFrame:
    """columns: with the fixed columns after the fourth; indexes: allele numbers; separator: also for SNPs; empty_missing: nothing in place of NN."""
    missing = "" if empty_missing else "NN"
    cells = F.transform("gts", lambda g: F.coalesce(g, F.lit(missing))) if indexes else genotype_text("/", missing, None if separator else "")
    fixed = [F.lit("+"), F.lit(assembly or "NA"), *[F.lit("NA")] * 5] if columns else []
    line = F.concat_ws("\t", "name", F.array_join("alleles", "/"), chrom(), pos(), *fixed, F.array_join(cells, "\t"))
    return headed(markers.select("ord", line.alias("line")), "\t".join([*(HAPMAP_HEADER if columns else ("variant", *HAPMAP_HEADER[1:4])), *individuals]))


def eigenstrat_genotypes(markers: DataFrame) -> DataFrame:
    return markers.select("ord", F.array_join(F.transform("gts", reference_code), "").alias("line"))


def eigenstrat_markers(markers: DataFrame) -> DataFrame:
    return markers.select("ord", F.concat_ws("\t", "name", chrom(), F.lit("0"), pos()).alias("line"))


def eigenstrat_individuals(people: DataFrame) -> DataFrame:
    """people: (individual, population)."""
    return people.select(natural_key(F.col("individual")).alias("ord"), F.concat_ws("\t", "individual", F.lit("U"), F.coalesce("population", F.lit("."))).alias("line"))


def population_counts(markers: DataFrame, populations: dict[str, str]) -> DataFrame:
    """The markers with `counts`: reference and other alleles of each population in order; only 0/0, 1/1 and pairs with one 0 count."""
    names = list(populations.values())
    of = sorted(set(names))
    where = [F.array(*[F.lit(k) for k, p in enumerate(names) if p == name]) for name in of]
    coded = markers.withColumn("_shares", F.transform("gts", allele_shares))
    # each genotype is read once; where there is one population, no place needs to be looked up
    total = lambda places: F.aggregate(places, F.lit(0).cast("long"), lambda s, k: s + F.get("_shares", k))
    sums = F.array(*[total(w) for w in where]) if len(of) > 1 else F.array(F.aggregate("_shares", F.lit(0).cast("long"), lambda s, x: s + x))
    halves = lambda s: F.array(s.bitwiseAND(F.lit(SHARE - 1).cast("long")).cast("int"), F.floor(s / SHARE).cast("int"))
    return coded.withColumn("counts", F.flatten(F.transform(sums, halves))).drop("_shares")


#: Sums of allele_shares have the reference's count below this.
SHARE = 1 << 26


def allele_shares(gt: Column) -> Column:
    """A genotype's reference alleles plus SHARE times its others; only 0/0, 1/1 and pairs with one 0 count."""
    a = allele_indexes(gt)
    zeros = F.size(F.filter(a, lambda x: x == 0))
    other = F.when(zeros == 1, 1).when(F.forall(a, lambda x: x == 1), 2).otherwise(0)
    found = F.when(F.size(a) == 2, zeros + other.cast("long") * SHARE).otherwise(F.lit(0).cast("long"))
    return F.when(gt == "0/0", F.lit(2).cast("long")).when(gt == "0/1", F.lit(1 + SHARE).cast("long")).when(gt == "1/1", F.lit(2 * SHARE).cast("long")).otherwise(F.coalesce(found, F.lit(0).cast("long")))


def baypass(markers: DataFrame, populations: dict[str, str]) -> dict[str, DataFrame]:
    """populations: that of each individual, in the order of the genotypes. Variants without any count are skipped."""
    # the condition is on genotypes, not on sums of them: Spark evaluates conditions early, and would make all sums there once more
    counted = population_counts(markers.where(F.exists("gts", lambda g: allele_shares(g) > 0)), populations)
    names = markers.sparkSession.createDataFrame([(f"{k:06d}", p) for k, p in enumerate(sorted(set(populations.values())))], "ord string, line string")
    code = counted.select("ord", F.concat_ws(" ", "name", chrom(), pos(), F.array_join("alleles", " ")).alias("line"))
    return {
        "baypass": counted.select("ord", F.concat(F.array_join(F.transform("counts", lambda c: c.cast("string")), " "), F.lit(" ")).alias("line")),
        "popnames": names,
        "snpcode": headed(code, "VariantID Chromo Position Allele1 Allele2"),
    }


def bed(variants: DataFrame) -> DataFrame:
    """Half-open places of variants; unplaced ones stand at 0 of sequence 0."""
    end = F.coalesce("end_site", "start_site") - 1
    line = F.when(F.col("start_site").isNull(), F.concat_ws("\t", F.lit("0"), F.lit("0"), F.lit("0"), "variant_id", F.lit("0"), F.lit("+"))).otherwise(
        F.concat_ws("\t", chrom(), (F.col("start_site") - 1).cast("string"), end.cast("string"), "variant_id", F.lit("0"), F.lit("+"))
    )
    return variants.select("variant_id", *["ord"] * ("ord" in variants.columns), line.alias("line"))


def bed_annotated(markers: DataFrame) -> DataFrame:
    """Places by the reference allele's length, as used where variants have annotations; unplaced ones end at 0."""
    start = F.coalesce("start_site", F.lit(0)) - 1
    end = F.when(start == -1, F.lit(0)).otherwise(start + F.length(F.element_at("alleles", 1)) - 1)
    return markers.select("ord", F.concat_ws("\t", chrom(), F.greatest(start, F.lit(0)).cast("string"), end.cast("string"), "name", F.lit("0"), F.lit("+")).alias("line"))


def gff3(markers: DataFrame, individuals: list[str]) -> DataFrame:
    names = F.array(*map(F.lit, individuals))
    ontology = F.create_map(*[F.lit(x) for pair in SEQUENCE_ONTOLOGY.items() for x in pair])
    start = F.coalesce("start_site", F.lit(0))
    end = F.when(F.col("type") == "SNP", start).otherwise(start + F.length(F.element_at("alleles", 1)) - 1)
    cells = F.array_join(F.zip_with(names, genotype_text("/", "."), lambda n, g: F.concat(n, F.lit(":"), g)), ",")
    synonym = F.when(F.col("name") != F.col("variant_id"), F.concat(F.lit(";Name="), "name")).otherwise("")
    notes = F.concat(F.lit("ID="), "variant_id", synonym, F.lit(";alleles="), F.array_join("alleles", "/"), F.lit(";refallele="), F.element_at("alleles", 1), F.lit(";sample_genotypes="), cells)
    line = F.concat_ws("\t", chrom(), F.lit(""), F.coalesce(F.try_element_at(ontology, F.col("type")), F.lit(".")), start.cast("string"), end.cast("string"), F.lit("."), F.lit("+"), F.lit("."), notes)
    return headed(markers.select("ord", line.alias("line")), "##gff-version 3")


def vcf_header(individuals: list[str], contigs: list[tuple[str, int | None]], fields: tuple[str, ...] = (), assembly: str | None = None, info: StructType | None = None, filters: tuple[str, ...] = (), numbers: dict[str, int] | None = None, declared: dict[str, tuple[str, str, str]] | None = None) -> list[str]:
    """Version, sorted meta lines and column names; fields: FORMAT fields beside GT, numbers: how many values one has (1 if not said).

    declared: number, type and description of fields as their files' headers declare them; fields of none are numbers.
    """
    known = {f: (str((numbers or {}).get(f, 1)), "Float", f) for f in fields} | {f: d for f, d in (declared or {}).items() if f in fields}
    meta = ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', *[f'##FORMAT=<ID={f.upper()},Number={n},Type={kind},Description="{text}">' for f, (n, kind, text) in known.items()]]
    meta += [f"##contig=<ID={name}" + (f",length={n}" if n else "") + (f",assembly={assembly}" if assembly else "") + ">" for name, n in contigs]
    for f in info.fields if info is not None else []:
        kind = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
        named = next((name for types, name in (((BooleanType,), "Flag"), ((DoubleType, FloatType), "Float"), ((IntegerType, LongType, ShortType), "Integer")) if isinstance(kind, types)), "String")
        number = "0" if named == "Flag" else "." if isinstance(f.dataType, ArrayType) else "1"
        meta.append(f'##INFO=<ID={f.name},Number={number},Type={named},Description="{f.name}">')
    meta += [f'##FILTER=<ID={f},Description="{f}">' for f in filters]
    return ["##fileformat=VCFv4.1", *sorted(meta), "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *individuals])]


def vcf_filter(filters: Column) -> Column:
    """A point if none were applied (null), PASS if all were passed, else those that were not, sorted."""
    return F.when(filters.isNull(), ".").when(F.size(filters) == 0, "PASS").otherwise(F.array_join(F.sort_array(filters), ";"))


def vcf_info(info: Column, kind: StructType) -> Column:
    """key=value by key, keys alone for flags; absent (null) ones and false flags are left out."""
    parts = []
    for f in sorted(kind.fields, key=lambda f: f.name):
        value = info.getField(f.name)
        text = vcf_value(value, f.dataType)
        parts.append(F.when(value.isNotNull() & text.isNotNull(), F.when(text == "", F.lit(f.name)).otherwise(F.concat(F.lit(f.name + "="), text))))
    found = F.concat_ws(";", *parts)
    return F.when(found == "", ".").otherwise(found)


def no_value(field: str, numbers: dict[str, int] | None) -> str:
    return ",".join("." for _ in range((numbers or {}).get(field, 1)))


def vcf_fields(fields: DataFrame, keys: tuple[str, ...], numbers: dict[str, int] | None = None, of: Callable[[str], Column] = F.col) -> Column:
    """The fields of a genotype, in order, as its text has them. of: where their values are; fields: a table with their types."""
    return F.concat_ws(":", *[F.when(of(f).isNull(), no_value(f, numbers)).otherwise(vcf_value(of(f), fields.schema[f].dataType)) for f in keys])


def vcf(
    markers: DataFrame, individuals: list[str], fields: DataFrame | None = None, field_names: tuple[str, ...] = (), contigs: list[tuple[str, int | None]] | None = None, assembly: str | None = None,
    sites: DataFrame | None = None, filter_names: tuple[str, ...] = (), numbers: dict[str, int] | None = None, declared: dict[str, tuple[str, str, str]] | None = None,
) -> DataFrame:
    """A file of records. Where markers have `values`, these are the fields' texts; else fields: (variant_id, individual, the named fields), which follow GT in sorted order; sites: (variant_id, qual, filters, info).

    Each of these may be missing for a variant: then a point stands for it, and as many as a field's number says.
    """
    keys = tuple(sorted(field_names))
    cells = F.transform("gts", lambda g: F.coalesce(g, F.lit("./.")))
    if keys:
        if "values" not in markers.columns:
            values = dense(fields.select("variant_id", "individual", vcf_fields(fields, keys, numbers).alias("gt")), individuals).withColumnRenamed("gts", "values")
            markers = markers.join(values, "variant_id", "left")
        none = ":".join(no_value(f, numbers) for f in keys)
        cells = F.transform(cells, lambda g, i: F.concat(g, F.lit(":"), F.coalesce(F.get("values", i), F.lit(none))))
    quality, filters, info, info_type = F.lit("."), F.lit("."), F.lit("."), None
    if sites is not None:
        info_type = sites.schema["info"].dataType
        markers = markers.join(sites.select("variant_id", "qual", "filters", "info"), "variant_id", "left")
        quality, filters, info = vcf_quality(F.col("qual")), vcf_filter(F.col("filters")), vcf_info(F.col("info"), info_type)
    alternatives = F.array_join(F.slice("alleles", 2, F.size("alleles")), ",")
    line = F.concat_ws(
        "\t", chrom(), pos(), "name", F.element_at("alleles", 1), F.when(F.size("alleles") > 1, alternatives).otherwise("."), quality, filters, info,
        F.lit(":".join(["GT", *[k.upper() for k in keys]])), F.array_join(cells, "\t"),
    )
    return headed(markers.select("ord", line.alias("line")), *vcf_header(individuals, contigs or [], keys, assembly, info_type, filter_names, numbers, declared))


def igv_sites(variants: DataFrame) -> DataFrame:
    """Where no genotypes are wanted: id, alleles, sequence and position, tab-separated."""
    return variants.select("variant_id", F.concat_ws("\t", "variant_id", F.array_join("alleles", "/"), chrom(), pos()).alias("line"))


def plink_map(markers: DataFrame) -> DataFrame:
    return markers.select("ord", F.concat_ws(" ", chrom(), "name", F.lit("0"), pos()).alias("line"))


#: A part of an individual's line holds the markers of so many bases of a sequence, a power of ten; of fewer where they lie close.
PART_DIGITS, PART_MARKERS = 6, 20_000


#: So many unplaced markers make a part.
UNPLACED = 10_000


def unplaced_bounds(sites: DataFrame, most: int = UNPLACED) -> list[str]:
    """The first markers (by ord) of the parts of unplaced ones: one for each `most` of them, and none if they are fewer.

    sites: site_table, of which no genotypes are read. Markers are sorted by Spark; the driver gets one a part.
    """
    unplaced = sites.where("chrom is null").select("ord")
    if unplaced.count() <= most:
        return []

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for batch in batches:
            yield batch.iloc[(-seen) % most :: most]
            seen += len(batch)

    return [r["ord"] for r in unplaced.repartitionByRange("ord").sortWithinPartitions("ord").mapInPandas(every, "ord string").sort("ord").collect()]


def part_digits(sites: DataFrame, most: int = PART_MARKERS) -> int:
    """How many digits of a place a part leaves open, so that it has about `most` markers where these lie closest; PART_DIGITS at most. The driver gets one row."""
    each = sites.where("start_site is not null").groupBy("chrom").agg(F.count("*").alias("n"), (F.max("start_site") - F.min("start_site") + 1).alias("span"))
    closest = each.where(F.col("n") > most).agg(F.max(F.col("n") / F.col("span"))).first()[0]
    return PART_DIGITS if closest is None else max(0, min(PART_DIGITS, floor(log10(most / closest)))) if most > closest else 0


def marker_part(bounds: list[str] | None = None, digits: int = PART_DIGITS) -> Column:
    """The sequence and the leading digits of the place, whose order is that of the markers; of unplaced ones, also how many of the bounds they reach."""
    part = F.regexp_extract("ord", rf"^(.* \d{{{20 - digits}}})\d{{{digits}}} ", 1)
    if bounds:
        reached = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("ord")))
        part = F.when(F.col("chrom").isNull(), F.concat(part, F.lit(" "), F.lpad(reached.cast("string"), 10, "0"))).otherwise(part)
    return part


def by_individual(markers: DataFrame, individuals: list[str], cells: Column, pieces: bool = False, bounds: list[str] | None = None) -> DataFrame:
    """(individual, k, cells): each individual's cells in marker order, as an array.

    pieces: as one array for each stretch of a sequence, with `part`, whose order is that of the markers. They are
    formed anyhow, so that what is gathered is bounded until whole lines are asked for.
    """
    flat = markers.select("ord", marker_part(bounds).alias("part"), F.posexplode(cells).alias("k", "cell"))
    parts = flat.groupBy("k", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "cell"))), lambda c: c["cell"]).alias("cells"))
    if not pieces:
        parts = parts.groupBy("k").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "cells"))), lambda c: c["cells"])).alias("cells"))
    return parts.join(lookup(markers.sparkSession, list(enumerate(individuals)), "k int, individual string"), "k").select("individual", "k", *["part"] * pieces, "cells")


def in_pieces(markers: DataFrame, individuals: list[str], cells: Column, head: Callable[[str], str], separator: str, bounds: list[str] | None = None, digits: int = PART_DIGITS) -> DataFrame:
    """(ord, part, text) of individual-oriented lines, for exports whose lines hold more than a row should: texts of an ord, by part, are its line.

    head: what stands before the cells of an individual; it is the part before all others. bounds: of unplaced markers;
    digits: part_digits. Markers are shuffled as they are, and turned around in batches: no cell is a row of its own.
    """
    n, columns = len(individuals), ["ord", "part", "text"]
    keys = pa.array([f"{k:010d}" for k in range(n)])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1).to_pylist()
            begins = [k for k in range(len(parts)) if not k or parts[k] != parts[k - 1]]
            for low, high in zip(begins, [*begins[1:], len(parts)], strict=True):
                flat = batch.column(2).slice(low, high - low).flatten().to_pylist()
                texts = [separator + separator.join(c for c in flat[k::n] if c is not None) for k in range(n)]
                yield pa.RecordBatch.from_arrays([keys, pa.array([f"p{batch.column(0)[low].as_py()}"] * n), pa.array(texts, pa.string())], columns)

    rows = markers.select("ord", marker_part(bounds, digits).alias("part"), cells.alias("cells")).repartition("part").sortWithinPartitions("part", "ord")
    first = markers.sparkSession.createDataFrame([(f"{k:010d}", "", head(name)) for k, name in enumerate(individuals)], "ord string, part string, text string")
    return first.unionAll(rows.mapInArrow(turn, "ord string, part string, text string"))


def two_bases(missing: str) -> Column:
    """Both alleles of each genotype, haploids twice; * becomes -; missing stands for each of two."""
    def one(g: Column) -> Column:
        named = F.transform(allele_strings(g, F.col("alleles")), lambda a: F.when(a == "*", "-").otherwise(a))
        both = F.array(F.try_element_at(named, F.lit(1)), F.coalesce(F.try_element_at(named, F.lit(2)), F.try_element_at(named, F.lit(1))))
        return F.when(g.isNotNull(), both).otherwise(F.array(F.lit(missing), F.lit(missing)))

    return F.transform("gts", one)


def numbered(rows: DataFrame, line: Column) -> DataFrame:
    return rows.select(F.lpad(F.col("k").cast("string"), 10, "0").alias("ord"), line.alias("line"))


def plink_ped(markers: DataFrame, individuals: list[str], populations: dict[str, str]) -> DataFrame:
    """Population (or .), individual, four fixed fields, then two alleles a marker; missing ones are 0."""
    rows = by_individual(markers, individuals, F.transform(two_bases("0"), lambda b: F.array_join(b, " ")))
    known = lookup(markers.sparkSession, [(k, populations.get(i) or ".") for k, i in enumerate(individuals)], "k int, population string")
    return numbered(rows.join(known, "k"), F.concat_ws(" ", "population", "individual", F.lit("0 0 0 U"), F.array_join("cells", " ")))


def flapjack_map(markers: DataFrame) -> DataFrame:
    return headed(markers.select("ord", F.concat_ws("\t", "name", chrom(), pos()).alias("line")), "# fjFile = MAP")


def names_line(markers: DataFrame, copies: int = 1) -> DataFrame:
    """(names): the markers' names in order, each so often, with a tab before each."""
    repeated = lambda c: F.array_repeat(c["name"], copies)
    ordered = F.sort_array(F.collect_list(F.struct("ord", "name")))
    return markers.agg(F.concat(F.lit("\t"), F.array_join(F.flatten(F.transform(ordered, repeated)), "\t")).alias("names"))


def names_in_pieces(markers: DataFrame, copies: int, ord: str, head: str, bounds: list[str] | None = None, digits: int = PART_DIGITS) -> DataFrame:
    """names_line after `head` as pieces (ord, part, text), each of the markers of a stretch of a sequence."""
    names = markers.select("ord", marker_part(bounds, digits).alias("part"), F.array_join(F.array_repeat("name", copies), "\t").alias("name"))
    parts = names.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("names"))
    texts = parts.select(F.lit(ord).alias("ord"), F.concat(F.lit("p"), "part").alias("part"), F.concat(F.lit("\t"), F.array_join(F.transform("names", lambda n: n["name"]), "\t")).alias("text"))
    return markers.sparkSession.createDataFrame([(ord, "", head)], "ord string, part string, text string").unionAll(texts)


def line_pieces(lines: DataFrame) -> DataFrame:
    """Short lines as pieces."""
    return lines.select("ord", F.lit("").alias("part"), F.col("line").alias("text"))


def all_bases() -> Column:
    """The alleles of each genotype, as many as it has; * becomes -; null where missing."""
    return F.transform("gts", lambda g: F.when(g.isNotNull(), F.transform(allele_strings(g, F.col("alleles")), lambda a: F.when(a == "*", "-").otherwise(a))))


def flapjack_cells() -> Column:
    """One allele where all agree, else all of them, whatever their number; - where missing."""
    def cell(b: Column) -> Column:
        return F.when(F.coalesce(F.size(b), F.lit(0)) < 1, "-").when(F.size(F.array_distinct(b)) == 1, b[0]).otherwise(F.array_join(b, "/"))

    return F.transform(all_bases(), cell)


def flapjack_genotypes(markers: DataFrame, individuals: list[str]) -> DataFrame:
    rows = numbered(by_individual(markers, individuals, flapjack_cells()), F.concat_ws("\t", "individual", F.array_join("cells", "\t")))
    head = names_line(markers).select(F.lit(" 0001").alias("ord"), F.col("names").alias("line"))
    return headed(rows.unionAll(head), "# fjFile = GENOTYPE")


def metadata_lines(people: DataFrame, title: str, fields: tuple[str, ...] = ("population",)) -> DataFrame:
    """A table of what is known of individuals, as Flapjack's phenotypes have it."""
    rows = people.select(natural_key(F.col("individual")).alias("ord"), F.concat_ws("\t", "individual", *[F.coalesce(f, F.lit("")) for f in fields]).alias("line"))
    return headed(rows, *([title] if title else []), "\t".join(["", *fields]))


def allele_numbers(markers: DataFrame) -> DataFrame:
    """(allele, code): numbers in the sorted order of all alleles that occur, which need not fit one machine."""
    alleles = markers.select(F.explode("alleles").alias("allele")).distinct().withColumn("head", F.substring("allele", 1, 3))
    counts = alleles.groupBy("head").agg(F.count("*").alias("n"))  # a row for each three letters
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.select("head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return alleles.join(heads, "head").select("allele", (F.col("earlier") + F.row_number().over(Window.partitionBy("head").orderBy("allele")) - 1).alias("code"))


def with_codes(markers: DataFrame) -> DataFrame:
    """markers with `codes`, the numbers of their alleles."""
    coded = markers.select("variant_id", F.posexplode("alleles").alias("k", "allele")).join(allele_numbers(markers), "allele")
    codes = coded.groupBy("variant_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "code"))), lambda c: c["code"]).alias("codes"))
    return markers.join(codes, "variant_id", "left")


def darwin_cells(ploidy: int) -> Column:
    """Alleles as numbers in the sorted order of all that occur, -1 where missing; over with_codes."""
    def cell(g: Column) -> Column:
        found = F.transform(allele_indexes(g), lambda i: F.try_element_at("codes", i + 1))
        shown = F.transform(F.sequence(F.lit(0), F.lit(ploidy - 1)), lambda k: F.coalesce(F.get(found, k), F.get(found, F.lit(0)), F.lit(-1)).cast("string"))
        return F.array_join(shown, "\t")

    return F.transform("gts", cell)


def darwin_variables(markers: DataFrame, individuals: list[str], ploidy: int = 2) -> DataFrame:
    rows = numbered(by_individual(with_codes(markers), individuals, darwin_cells(ploidy)), F.concat_ws("\t", (F.col("k") + 1).cast("string"), F.array_join("cells", "\t")))
    counts = markers.agg(F.concat_ws("\t", F.lit(len(individuals)), F.count("*") * ploidy).alias("line")).select(F.lit(" 0001").alias("ord"), "line")
    head = names_line(markers, ploidy).select(F.lit(" 0002").alias("ord"), F.concat(F.lit("N°"), "names").alias("line"))
    return headed(rows.unionAll(counts).unionAll(head), f"@DARwin 5.0 - ALLELIC - {ploidy}")


def darwin_individuals(people: DataFrame, individuals: list[str]) -> DataFrame:
    places = lookup(people.sparkSession, [(i, k + 1) for k, i in enumerate(individuals)], "individual string, place int")
    place = F.col("place")
    rows = people.join(places, "individual").select(F.lpad(place.cast("string"), 10, "0").alias("ord"), F.concat_ws("\t", place.cast("string"), "individual", F.coalesce("population", F.lit(""))).alias("line"))
    return headed(rows, "@DARwin 5.0 - DON -", f"{len(individuals)}\t2", "N°\tindividual\tpopulation")


def sequences(markers: DataFrame, individuals: list[str], missing: str) -> DataFrame:
    """(individual, k, sequence): both bases of all SNPs, one after the other."""
    rows = by_individual(markers.where("type = 'SNP'"), individuals, F.transform(two_bases(missing), lambda b: F.array_join(b, "")))
    return rows.select("individual", "k", F.array_join("cells", "").alias("sequence"))


def fasta(markers: DataFrame, individuals: list[str]) -> DataFrame:
    return numbered(sequences(markers, individuals, "-"), F.concat(F.lit(">"), "individual", F.lit("\n"), "sequence"))


def _site_count(markers: DataFrame, line: Callable[[Column], Column], ord: str) -> DataFrame:
    return markers.where("type = 'SNP'").agg(F.count("*").alias("n")).select(F.lit(ord).alias("ord"), line((2 * F.col("n")).cast("string")).alias("line"))


def phylip_head(markers: DataFrame, individuals: list[str]) -> DataFrame:
    return _site_count(markers, lambda n: F.concat_ws(" ", F.lit(len(individuals)), n), " 0000")


def phylip(markers: DataFrame, individuals: list[str]) -> DataFrame:
    return phylip_head(markers, individuals).unionAll(numbered(sequences(markers, individuals, "?"), F.concat_ws("\t", "individual", "sequence")))


def nexus_frame(markers: DataFrame, individuals: list[str]) -> DataFrame:
    """What stands before and after the matrix."""
    dimensions = _site_count(markers, lambda n: F.concat(F.lit(f"dimensions ntax={len(individuals)} nchar="), n, F.lit(";")), " 0000a")
    head = [(" 0000", "#NEXUS\nbegin data;"), (" 0001", "format datatype=dna missing=? gap=-;\nmatrix"), ("~", ";\nend;")]
    return markers.sparkSession.createDataFrame(head, "ord string, line string").unionAll(dimensions)


def nexus(markers: DataFrame, individuals: list[str]) -> DataFrame:
    return nexus_frame(markers, individuals).unionAll(numbered(sequences(markers, individuals, "?"), F.concat_ws("\t", "individual", "sequence")))


@dataclass(frozen=True)
class Format:
    """What a format takes; None means any."""

    name: str
    extensions: tuple[str, ...]
    variant_types: tuple[str, ...] | None = None
    ploidies: tuple[int, ...] | None = None

    def accepts(self, variants: DataFrame) -> DataFrame:
        return variants.where(F.col("type").isin(*self.variant_types)) if self.variant_types else variants

    def check_ploidy(self, ploidy: int) -> None:
        if self.ploidies is not None and ploidy not in self.ploidies:
            raise ValueError(f"{self.name} takes ploidy {self.ploidies}, not {ploidy}")


_FIVE = ("SNP", "MNP", "INDEL", "MIXED", "NO_VARIATION")
FORMATS = {
    f.name: f
    for f in (
        Format("HAPMAP", ("hapmap",), _FIVE), Format("EIGENSTRAT", ("eigenstratgeno", "snp", "ind"), ("SNP",), (2,)), Format("BAYPASS", ("baypass", "popnames", "_snp.code"), ("SNP", "NO_VARIATION")),
        Format("BED", ("bed",)), Format("GFF3", ("gff3",)), Format("VCF", ("vcf",)), Format("VCF.gz", ("vcf.gz",)), Format("PLINK", ("ped", "map"), _FIVE, (2,)),
        Format("FLAPJACK", ("genotype", "map", "phenotype")), Format("DARwin", ("var", "don")), Format("FASTA", ("fasta", "map"), ("SNP",), (2,)), Format("PHYLIP", ("phy", "map"), ("SNP",), (2,)),
        Format("NEXUS", ("nxs", "map"), ("SNP",), (2,)), Format("JUKES-CANTOR", ("mtx", "nwk", "map"), ("SNP",), (2,)), Format("ASD", ("mtx", "nwk", "map"), ("SNP",), (2,)), Format("PCA", ("pca",), ("SNP",), (2,)),
    )
}
