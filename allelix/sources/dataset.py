"""The tables of a genotyping project, as a request is run over them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from ..operators.vectors import Packed


@dataclass(frozen=True)
class Dataset:
    """Tables by name; those that may be None aren't needed for everything.

    variants: variant_id, type, chrom, start_site, end_site, alleles. genotypes: variant_id, project_id, run_name,
    callset_id, individual, population, gt and FORMAT fields. people: individual, population and what else is known of
    them, a row each. callsets: callset_id, sample_id, individual. synonyms: variant_id, synonym. variant_runs:
    variant_id, info (a map with ANN, CSQ or EFF). sites: variant_id, qual, filters, info (a struct). contigs: names and
    lengths, in order. ploidies: that of each project, 2 if it isn't said.
    placed: variants and genotypes are tables in buckets by variant_id, so that neither is shuffled to meet the other.
    formats: number, type and description of FORMAT fields as a VCF header declares them.
    packed: the genotypes as vectors, which charts and searches use where they can.
    """

    variants: DataFrame
    genotypes: DataFrame
    people: DataFrame
    callsets: DataFrame | None = None
    synonyms: DataFrame | None = None
    variant_runs: DataFrame | None = None
    sites: DataFrame | None = None
    contigs: tuple[tuple[str, int | None], ...] = ()
    assembly: str | None = None
    ploidies: dict[int, int] = field(default_factory=dict)
    formats: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    placed: bool = False
    packed: Packed | None = None
