"""Genotypes as packed vectors: a row a variant, and in it a vector of bits for each run, so that statistics need no genotype shuffle.

A run's vector holds a code number for each entity, spread over planes of bits: the first plane has the lowest bit of each
entity's number, and so on; number 0 is a missing genotype. With up to three genotype codes a cell takes two bits. A word
is a long, of 64 entities. Which entities have a code is the conjunction of its number's planes, how many of them a group
has is a count of bits, and which agree over all runs is a disjunction: all of it within the row, by built-in functions.

The columns of the variants are kept, so a chart reads one table, and its only exchange is that of the windows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import lookup
from .filters import statistics_of

WORD = 64


def words_for(n: int) -> int:
    return max(1, -(-n // WORD))


def bits_of(numbers: list[int], words: int) -> list[int]:
    """The entities of these numbers as words of bits."""
    out = [0] * words
    for k in numbers:
        out[k // WORD] |= 1 << k % WORD
    return [w - (1 << 64) if w >> 63 else w for w in out]


def literal(words: list[int]) -> Column:
    return F.array(*[F.lit(w).cast("long") for w in words])


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def but_not(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def counted(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))


@dataclass(frozen=True)
class Packed:
    """A table of packed genotypes and the entities, in order, whose numbers are places in its vectors.

    Columns: those of the variants, and runs: structs (project_id, run_name, codes, planes) in which codes are the
    called genotype codes in order; samples: whether entities are samples. An entity with several callsets in a run has its further ones in further structs.
    """

    table: DataFrame
    entities: tuple[str, ...]
    samples: bool = False

    def where(self, table: DataFrame) -> Packed:
        return replace(self, table=table)

    def mask(self, names: tuple[str, ...] | None) -> Column:
        """The bits of the entities so named; of all, if none are."""
        at = {name: k for k, name in enumerate(self.entities)}
        return literal(bits_of(list(range(len(self.entities))) if names is None else [at[n] for n in dict.fromkeys(names) if n in at], words_for(len(self.entities))))


def pack(variants: DataFrame, genotypes: DataFrame, entities: tuple[str, ...]) -> DataFrame:
    """The table of Packed: variants with the genotypes (variant_id, project_id, run_name, callset_id, individual, gt) of these entities.

    Genotypes are shuffled once, by variant. Variants without genotypes have no runs. Rows of other entities are left out.
    """
    words = words_for(len(entities))
    numbers = lookup(genotypes.sparkSession, list(enumerate(entities)), "k int, individual string")
    cells = genotypes.where("gt is not null").join(numbers, "individual").select("variant_id", "project_id", "run_name", "k", "callset_id", "gt")
    # callsets of an entity within a run, one after the other: the first of each make a vector, the second another
    by = ["variant_id", "project_id", "run_name"]
    layer = F.row_number().over(Window.partitionBy(*by, "k").orderBy("callset_id", "gt")) - 1
    layered = cells.repartition("variant_id").select(*by, layer.alias("layer"), "gt", F.floor(F.col("k") / WORD).cast("int").alias("w"), (F.col("k") % WORD).alias("at"))
    # the bits of a code in a word are summed as integers, so what is gathered is a row for each of them
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    parts = layered.groupBy(*by, "layer", "gt", "w").agg(F.bit_or(F.call_function("shiftleft", one, F.col("at"))).alias("bits"))
    vectors = parts.groupBy(*by, "layer").agg(F.sort_array(F.collect_list(F.struct("gt", "w", "bits"))).alias("parts")).withColumn("codes", F.array_distinct(F.transform("parts", lambda part: part["gt"])))
    numbered = F.transform("parts", lambda part: F.struct(part["w"].alias("w"), part["bits"].alias("bits"), F.array_position("codes", part["gt"]).cast("int").alias("number")))
    depth = F.floor(F.log2(F.size("codes"))).cast("int")

    def plane(p: Column) -> Column:
        """The words of a plane: each joins the bits of the codes whose numbers have the plane's."""
        has = lambda part: F.call_function("shiftright", part["number"], p).bitwiseAND(F.lit(1)) == 1
        return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.aggregate(F.filter("numbered", lambda part: (part["w"] == w) & has(part)), none, lambda s, part: s.bitwiseOR(part["bits"])))

    packed = vectors.withColumn("numbered", numbered).select("variant_id", F.struct("project_id", "run_name", "layer", "codes", F.transform(F.sequence(F.lit(0), depth), plane).alias("planes")).alias("run"))
    rows = packed.groupBy("variant_id").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    return variants.join(rows, "variant_id", "left").withColumn("runs", F.coalesce("runs", F.array().cast(rows.schema["runs"].dataType)))


def code_bits(run: Column, number: Column, words: int) -> Column:
    """Which entities have the code of a number (from 1) in a run."""
    every = F.array_repeat(F.lit(-1).cast("long"), words)
    at = lambda k: F.call_function("shiftright", number, k).bitwiseAND(F.lit(1)) == 1
    indexed = F.transform(run["planes"], lambda p, k: F.when(at(k), p).otherwise(F.transform(p, F.bitwise_not)))
    return F.aggregate(indexed, every, lambda a, p: both(a, p))


def agreed(packed: Packed, projects: tuple[int, ...] = (), runs: tuple[tuple[int, str], ...] = ()) -> DataFrame:
    """The table with `calls`: structs (gt, bits) of the codes, and which entities have it in all runs where they have any.

    projects, runs: those to look at; all if none are named.
    """
    words = words_for(len(packed.entities))
    found, nobody = packed.table, F.array_repeat(F.lit(0).cast("long"), words)
    chosen = F.col("runs")
    if projects:
        chosen = F.filter(chosen, lambda r: r["project_id"].isin(*projects))
    if runs:
        chosen = F.filter(chosen, lambda r: reduce(Column.__or__, [(r["project_id"] == p) & (r["run_name"] == name) for p, name in runs]))
    found = found.withColumn("_runs", chosen)
    # which entities have a code in each run, then in any, then in more than one
    codes = F.array_distinct(F.flatten(F.transform("_runs", lambda r: r["codes"])))
    in_run = lambda r, gt: F.coalesce(F.when(F.array_contains(r["codes"], gt), code_bits(r, F.array_position(r["codes"], gt).cast("int"), words)), nobody)
    said = F.transform(codes, lambda gt: F.struct(gt.alias("gt"), F.aggregate("_runs", nobody, lambda a, r: either(a, in_run(r, gt))).alias("bits")))
    found = found.withColumn("_said", said)
    start = F.struct(nobody.alias("once"), nobody.alias("twice"))
    twice = F.aggregate("_said", start, lambda s, c: F.struct(either(s["once"], c["bits"]).alias("once"), either(s["twice"], both(s["once"], c["bits"])).alias("twice")))["twice"]
    found = found.withColumn("_twice", twice)
    return found.withColumn("calls", F.transform("_said", lambda c: F.struct(c["gt"].alias("gt"), but_not(c["bits"], F.col("_twice")).alias("bits")))).drop("_runs", "_said", "_twice")


def counts_of(mask: Column) -> Column:
    """Structs (gt, n) of the codes that entities of a mask have; over agreed."""
    return F.filter(F.transform("calls", lambda c: F.struct(c["gt"].alias("gt"), counted(both(c["bits"], mask)).alias("n"))), lambda c: c["n"] > 0)


def variant_statistics(packed: Packed, names: tuple[str, ...] | None = None, ploidy: int = 2, projects: tuple[int, ...] = (), runs: tuple[tuple[int, str], ...] = ()) -> DataFrame:
    """The table's variants with the statistics of the entities so named (all if None); null shares where nothing is called."""
    n = len(packed.entities) if names is None else len(set(names) & set(packed.entities))
    found = agreed(packed, projects, runs).withColumn("counts", counts_of(packed.mask(names)))
    return found.select(*[c for c in packed.table.columns if c != "runs"], *[c.alias(name) for name, c in statistics_of(F.col("counts"), n, ploidy).items()])


def unpacked(packed: Packed) -> DataFrame:
    """(variant_id, project_id, run_name, layer, individual, gt): the called cells again."""
    words = words_for(len(packed.entities))
    runs = packed.table.select("variant_id", F.explode("runs").alias("run"))
    coded = runs.select("variant_id", "run.project_id", "run.run_name", "run.layer", F.explode(F.transform("run.codes", lambda gt: F.struct(gt.alias("gt"), code_bits(F.col("run"), F.array_position("run.codes", gt).cast("int"), words).alias("bits")))).alias("c"))
    names = lookup(packed.table.sparkSession, list(enumerate(packed.entities)), "k int, individual string")
    held = F.filter(F.sequence(F.lit(0), F.lit(len(packed.entities) - 1)), lambda k: F.call_function("shiftright", F.get("c.bits", F.floor(k / WORD).cast("int")), k % WORD).bitwiseAND(F.lit(1).cast("long")) == 1)
    cells = coded.select("variant_id", "project_id", "run_name", "layer", F.explode(held).alias("k"), "c.gt")
    return cells.join(names, "k").select("variant_id", "project_id", "run_name", "layer", "individual", "gt")
