"""What a user asks for: filters on variants, groups of individuals with genotype filters, windows to chart."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Fixed labels of the genotype patterns.
PATTERNS = (
    "Any",
    "Not all the same",
    "All or mostly the same",
    "All different",
    "Not all different",
    "All Homozygous Ref",
    "Some Homozygous Ref",
    "All Homozygous Var",
    "Some Homozygous Var",
)


@dataclass(frozen=True)
class Group:
    """A population with conditions on its genotypes; no individuals means all. Ranges are percentages."""

    name: str | None = None
    individuals: tuple[str, ...] = ()
    pattern: str = "Any"
    most_same_ratio: float = 100
    missing: tuple[float, float] = (0, 100)
    heterozygosity: tuple[float, float] = (0, 100)
    maf: tuple[float, float] = (0, 50)
    #: Least values of FORMAT fields; genotypes below count as missing.
    field_thresholds: dict[str, float] = field(default_factory=dict)
    #: Number (from 0) of the group, or numbers of the groups, whose most frequent genotypes must differ.
    discriminate: int | tuple[int, ...] | None = None

    @classmethod
    def of_callsets(cls, ids: list[str], separator: str = "§", **more) -> Group:
        """A group of the entities that ids of callsets (project, then others, then the entity) end in."""
        return cls(individuals=tuple(dict.fromkeys(i.rsplit(separator, 1)[-1] for i in ids)), **more)

    def __post_init__(self):
        if self.pattern not in PATTERNS:
            raise ValueError(f"unknown genotype pattern {self.pattern!r}")

    @property
    def apart_from(self) -> tuple[int, ...]:
        return () if self.discriminate is None else (self.discriminate,) if isinstance(self.discriminate, int) else tuple(self.discriminate)

    def filters_genotypes(self) -> bool:
        return self.discriminate is not None or self.pattern != "Any" or self.missing != (0, 100) or self.heterozygosity != (0, 100) or self.maf != (0, 50)


@dataclass(frozen=True)
class SearchRequest:
    """Filters on variants; empty ones hold always. A None among the sequences stands for unplaced variants."""

    projects: tuple[int, ...] = ()
    runs: tuple[tuple[int, str], ...] = ()
    #: Names of variants, if only these are wanted.
    variant_ids: tuple[str, ...] = ()
    variant_types: tuple[str, ...] = ()
    sequences: tuple[str | None, ...] = ()
    start: int = -1
    end: int = -1
    allele_counts: tuple[int, ...] = ()
    gene_names: tuple[str, ...] = ()
    variant_effects: tuple[str, ...] = ()
    groups: tuple[Group, ...] = ()
    sort_by: str | None = None
    descending: bool = False
    page: int = 0
    page_size: int = 100
    #: What a search gives: `count`, `page`, or `both`; whether a page has the genotypes of the groups' entities; and whether
    #: an export of more cells (variants by entities) than a limit is refused.
    mode: str = "both"
    with_genotypes: bool = True
    limit_matrix: bool = True

    def __post_init__(self):
        if self.mode not in ("count", "page", "both"):
            raise ValueError(f"unknown search mode {self.mode!r}")

    @property
    def filters_genotypes(self) -> bool:
        return any(g.filters_genotypes() for g in self.groups)


@dataclass(frozen=True)
class ChartRequest(SearchRequest):
    """Windows over [range_min, range_max] of one sequence; unset bounds are those of the variants that pass."""

    displayed_sequence: str | None = None
    range_min: int = -1
    range_max: int = -1
    intervals: int = 20
    displayed_type: str | None = None


@dataclass(frozen=True)
class FieldPlotRequest(ChartRequest):
    vcf_field: str = "dp"
