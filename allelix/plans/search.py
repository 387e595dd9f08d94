"""Searches as a user sees them: how many variants fit, and a page of them with their genotypes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters
from ..sources.dataset import Dataset
from .execution import entities, genotypes_of, members_of, selected_variants
from .requests import SearchRequest

#: Cells of the largest matrix that is exported unless a request says otherwise.
MOST_CELLS = 10_000_000_000


class MatrixTooLarge(ValueError):
    """What was asked for has more cells than the limit."""


@dataclass(frozen=True)
class Found:
    """What a request's mode asks for: the number of variants, and a page of them (with `genotypes`: structs of callset, entity and code, in that order)."""

    count: int | None
    page: DataFrame | None


def search(data: Dataset, request: SearchRequest, samples: bool = False, selected: DataFrame | None = None) -> Found:
    """The count and page of a request. selected: its variants, if they are known (of a kept search)."""
    variants = selected_variants(data, request, samples) if selected is None else selected
    count = variants.count() if request.mode in ("count", "both") else None
    return Found(count, page_of(data, request, variants, samples) if request.mode in ("page", "both") else None)


def page_of(data: Dataset, request: SearchRequest, variants: DataFrame, samples: bool) -> DataFrame:
    """A page; genotypes are read for its variants only."""
    found = filters.page(variants, request)
    if not request.with_genotypes:
        return found
    members = members_of(data, request.groups, samples).select("individual").distinct()
    cells = genotypes_of(data, request, samples).join(F.broadcast(found.select("variant_id")), "variant_id", "left_semi").join(members, "individual", "left_semi")
    gathered = cells.groupBy("variant_id").agg(F.sort_array(F.collect_list(F.struct("callset_id", "individual", "gt"))).alias("genotypes"))
    shown = found.join(gathered, "variant_id", "left")
    by = F.col(request.sort_by or "variant_id")
    return shown.orderBy(by.desc() if request.descending else by.asc(), "variant_id")


def check_matrix(data: Dataset, request: SearchRequest, variants: DataFrame, samples: bool = False, most: int = MOST_CELLS) -> int:
    """How many cells an export of the variants has; over `most`, unless the request lifts that limit, MatrixTooLarge."""
    named = {i for g in request.groups for i in g.individuals}
    everyone = not request.groups or any(not g.individuals for g in request.groups)
    n = entities(data, samples).select("individual").distinct().count() if everyone else len(named)
    cells = variants.count() * n
    if request.limit_matrix and cells > most:
        raise MatrixTooLarge(f"{cells} genotypes are more than {most}: choose fewer variants or individuals")
    return cells
