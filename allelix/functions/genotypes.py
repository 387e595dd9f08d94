"""Column expressions over genotype codes such as 0/1; null is a missing genotype."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType


def allele_indexes(gt: Column) -> Column:
    """The allele numbers of a genotype; null if it is missing or isn't numbers."""
    parts = F.transform(F.split(gt, "[/|]"), lambda a: a.try_cast("int"))
    return F.when(~F.exists(parts, lambda a: a.isNull()), parts)


def allele_strings(gt: Column, alleles: Column) -> Column:
    """The alleles of a genotype as bases; N stands for a deletion (D), NN for an insertion (I)."""
    named = F.transform(allele_indexes(gt), lambda i: F.try_element_at(alleles, i + 1))
    return F.transform(named, lambda a: F.when(a == "NN", "I").when(a == "N", "D").otherwise(a))


def dosage_by_order(gt: Column, heterozygote: str = "0/1") -> Column:
    """0, 1 or 2 as the code sorts before, at or after the heterozygote's; 0 if missing. For haploids compare with "1"."""
    return F.when(gt.isNull() | (gt < heterozygote), 0).when(gt == heterozygote, 1).otherwise(2)


def middle_code(ploidy: int) -> str:
    """What dosages compare with."""
    return "1" if ploidy == 1 else "0/1"


def alternate_count(gt: Column) -> Column:
    """How many alleles aren't the reference; null if missing."""
    return F.size(F.filter(allele_indexes(gt), lambda a: a != 0))


def reference_code(gt: Column) -> Column:
    """How many alleles are the reference; 9 if missing."""
    found = allele_indexes(gt)
    return F.when(found.isNull(), 9).otherwise(F.size(F.filter(found, lambda a: a == 0)))


def is_heterozygous(gt: Column) -> Column:
    """Whether the first two alleles differ; null if missing, false for haploids."""
    found = allele_indexes(gt)
    return F.when(F.size(found) < 2, False).otherwise(F.try_element_at(found, F.lit(1)) != F.try_element_at(found, F.lit(2)))


def is_homozygous_reference(gt: Column) -> Column:
    return F.forall(allele_indexes(gt), lambda a: a == 0)


def is_homozygous_variant(gt: Column) -> Column:
    found = allele_indexes(gt)
    return (F.size(F.array_distinct(found)) == 1) & (F.element_at(found, 1) != 0)


def natural_key(name: Column) -> Column:
    """Sorts chr2 before chr10: runs of digits padded to 20."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


#: The characters of genotype codes, in order, and a hexadecimal digit for each: 15 of them fit an integer.
CODE_CHARACTERS, CODE_DIGITS = "./0123456789|", "123456789ABCD"


#: So many characters fit an integer, and so many integers hold the longest code that is taken.
CODE_WIDTH, CODE_PARTS = 15, 4
#: Codes that most genotypes have are looked up, not converted.
COMMON_CODES = ("0/0", "0/1", "1/1", "0|0", "0|1", "1|0", "1|1", "0", "1")


def _digits(code: str) -> int:
    return int(code.translate(str.maketrans(CODE_CHARACTERS, CODE_DIGITS)), 16)


def packed_code(gt: Column) -> Column:
    """A genotype code of at most 15 characters as an integer, which hash aggregation can hold where it can't hold text; null if it is missing.

    Codes are of digits, separators and points; others raise an error.
    """
    fits = gt.rlike(rf"^[0-9./|]{{1,{CODE_WIDTH}}}$")
    found = F.when(fits, F.conv(F.translate(gt, CODE_CHARACTERS, CODE_DIGITS), 16, 10).cast("long"))
    found = found.when(gt.isNotNull(), F.raise_error(F.concat(F.lit("not a genotype code: "), gt)).cast("long"))
    for code in reversed(COMMON_CODES):
        found = F.when(gt == code, F.lit(_digits(code)).cast("long")).otherwise(found)
    return found


def unpacked_code(code: Column) -> Column:
    found = F.translate(F.hex(code), CODE_DIGITS, CODE_CHARACTERS)
    for text in reversed(COMMON_CODES):
        found = F.when(code == _digits(text), text).otherwise(found)
    return found


def packed_parts(gt: Column) -> list[Column]:
    """A genotype code of up to 60 characters (twenty alleles of two digits) as four integers; what a code is too short for is 0."""
    long = F.length(gt) > CODE_WIDTH
    checked = F.when(F.length(gt) <= CODE_WIDTH * CODE_PARTS, gt).otherwise(F.when(gt.isNotNull(), F.raise_error(F.concat(F.lit("genotype code of too many alleles: "), gt))))
    part = lambda k: packed_code(F.substring(checked, CODE_WIDTH * k + 1, CODE_WIDTH))
    rest = [F.when(F.length(gt) > CODE_WIDTH * k, part(k)).when(gt.isNotNull(), F.lit(0).cast("long")) for k in range(1, CODE_PARTS)]  # null where nothing is called
    return [F.when(long, part(0)).otherwise(packed_code(gt)), *rest]


def unpacked_parts(parts: list[Column]) -> Column:
    return F.when(parts[1] == 0, unpacked_code(parts[0])).otherwise(F.concat(unpacked_code(parts[0]), *[F.when(p == 0, "").otherwise(unpacked_code(p)) for p in parts[1:]]))


def callset_of(id_: Column, separator: str = "§") -> Column:
    """The last part of an id that names project, individual and callset."""
    return F.substring_index(id_, separator, -1)


def vcf_double(x: Column) -> Column:
    """Two decimals from 1 on, three from 0.01 on, else (also below 0) three in exponent form; 0.00 below 1e-20 in size; . if null."""
    return F.when(x.isNull(), ".").when(x >= 1, F.format_string("%.2f", x)).when(x >= 0.01, F.format_string("%.3f", x)).when(F.abs(x) < 1e-20, "0.00").otherwise(F.format_string("%.3e", x))


def vcf_quality(x: Column) -> Column:
    """Two decimals without .00; . if null."""
    return F.when(x.isNull(), ".").otherwise(F.regexp_replace(F.format_string("%.2f", x), r"\.00$", ""))


def vcf_value(value: Column, kind: DataType) -> Column:
    """A value of a field: . for null and for empty lists, lists joined by commas, flags as nothing if true and null (no entry) if false."""
    if isinstance(kind, ArrayType):
        listed = F.array_join(F.transform(value, lambda x: vcf_value(x, kind.elementType)), ",")
        return F.when(F.size(value) > 0, listed).otherwise(".")
    if isinstance(kind, BooleanType):
        return F.when(value.isNull(), ".").when(value, "")
    if isinstance(kind, DoubleType | FloatType):
        return vcf_double(value)
    return F.coalesce(value.cast("string"), F.lit("."))
