"""Whole exports: the files of a format, by its name, for what a request chooses.

Each file is a table of lines (ord, line), or of an individual-oriented line's pieces (ord, part, text), so that an
export of any size can be written by Spark; `sources.archive` streams them into an archive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotypes import natural_key, reference_code
from ..functions.text import expand_url, parse_online_tool
from ..plans.execution import Selection, ploidy_of, selection
from ..plans.requests import SearchRequest
from ..runtime import lookup, written
from ..sources.dataset import Dataset
from . import formats, matrix, resolution, tree


@dataclass(frozen=True)
class Export:
    """What an export is made of; whatever a format doesn't take isn't computed."""

    data: Dataset
    chosen: Selection
    samples: bool = False
    ploidy: int = 2

    @property
    def names(self) -> list[str]:
        return self.chosen.names

    @cached_property
    def gathered(self) -> DataFrame:
        """A row a variant; cells are by the number of their individual."""
        return formats.resolved_rows(self.chosen.genotypes, self.names)

    @cached_property
    def resolved(self) -> DataFrame:
        return self.by_name(self.gathered)

    def by_name(self, gathered: DataFrame) -> DataFrame:
        """Resolved genotypes, a row a cell with its individual."""
        return resolution.cells_of(gathered).join(lookup(gathered.sparkSession, list(enumerate(self.names)), "k int, individual string"), "k")

    @cached_property
    def markers(self) -> DataFrame:
        return formats.marker_table(self.chosen.variants, self.gathered, self.names, self.data.synonyms)

    @cached_property
    def sites(self) -> DataFrame:
        """Markers without genotypes, for files that need none."""
        return formats.site_table(self.chosen.variants, self.data.synonyms)

    @cached_property
    def bounds(self) -> list[str]:
        """Where the pieces of unplaced markers begin."""
        return formats.unplaced_bounds(self.sites)

    @cached_property
    def digits(self) -> int:
        """How much of a sequence is a piece."""
        return formats.part_digits(self.sites)

    @cached_property
    def people(self) -> DataFrame:
        rows = [(i, p) for i, p in self.chosen.populations.items()]
        return self.data.variants.sparkSession.createDataFrame(rows, "individual string, population string")

    def cells(self, resolved: DataFrame) -> DataFrame:
        return resolved.join(self.sites.select("variant_id", "name", "ord", "type", "alleles"), "variant_id")

    def map(self) -> dict[str, DataFrame]:
        return {"map": formats.plink_map(self.sites)}

    def remarks(self, exported: Column | None, *more: DataFrame, resolved: DataFrame | None = None) -> dict[str, DataFrame]:
        found = resolution.dissimilar(self.cells(self.resolved if resolved is None else resolved), exported)
        return {"REMARKS": reduce(DataFrame.unionAll, more, found)}


def _text(separator: str, snp_separator: str | None = None) -> Column:
    return formats.one_genotype(F.col("gt"), separator, "", snp_separator)


def _hapmap(e: Export) -> dict[str, DataFrame]:
    return {"hapmap": formats.hapmap(e.markers, e.names, e.data.assembly), **e.remarks(_text("/", ""))}


def _eigenstrat(e: Export) -> dict[str, DataFrame]:
    return {
        "eigenstratgeno": formats.eigenstrat_genotypes(e.markers), "snp": formats.eigenstrat_markers(e.sites), "ind": formats.eigenstrat_individuals(e.people),
        **e.remarks(reference_code(F.col("gt")), resolution.many_alleles(e.cells(e.resolved)), resolution.multi_allelic(e.sites)),
    }


def _baypass(e: Export) -> dict[str, DataFrame]:
    resolved = formats.resolved_rows(e.chosen.genotypes, e.names, resolution.of_two_counts)
    found = formats.baypass(formats.marker_table(e.chosen.variants, resolved, e.names, e.data.synonyms), {i: p or "." for i, p in e.chosen.populations.items()})
    return {"baypass": found["baypass"], "popnames": found["popnames"], "_snp.code": found["snpcode"], **e.remarks(None, resolved=e.by_name(resolved))}


def _bed(e: Export) -> dict[str, DataFrame]:
    if e.data.variant_runs is not None:
        return {"bed": formats.bed_annotated(e.sites)}
    return {"bed": formats.bed(e.sites).select("ord", "line")}


def _vcf(e: Export) -> dict[str, DataFrame]:
    contigs = list(e.data.contigs) or [(r["chrom"], None) for r in e.chosen.variants.where("chrom is not null").select("chrom").distinct().orderBy(natural_key(F.col("chrom"))).collect()]
    names = tuple(sorted({f for r in e.data.sites.select(F.explode("filters").alias("f")).distinct().collect() for f in r})) if e.data.sites is not None else ()
    fields = tuple(f for f in e.chosen.genotypes.columns if f not in {"variant_id", "project_id", "run_name", "callset_id", "individual", "population", "gt"})
    numbers = {f: int(n) for f, (n, _, _) in e.data.formats.items() if n.isdigit()}
    found, keys = formats.resolved_rows(e.chosen.genotypes, e.names, fields=fields), tuple(sorted(fields))
    if keys:
        found = found.select("variant_id", F.transform("cells", lambda c: F.struct(c["k"].alias("k"), c["gt"].alias("gt"), formats.vcf_fields(e.chosen.genotypes, keys, numbers, c.getField).alias("values"))).alias("cells"))
    markers = formats.marker_table(e.chosen.variants, found, e.names, e.data.synonyms, ("values",) if keys else ())
    lines = formats.vcf(markers, e.names, None, fields, contigs, e.data.assembly, e.data.sites, names, numbers, e.data.formats)
    return {"vcf": lines, **e.remarks(_text("/"))}


def _vcf_gz(e: Export) -> dict[str, DataFrame]:
    files = _vcf(e)
    return {"vcf.gz": files["vcf"], "REMARKS": files["REMARKS"]}


def _plink(e: Export) -> dict[str, DataFrame]:
    heads = {i: f"{p or '.'} {i} 0 0 0 U" for i, p in e.chosen.populations.items()}
    head = heads.__getitem__
    cells = F.transform(formats.two_bases("0"), lambda b: F.array_join(b, " "))
    return {"ped": _pieces(e, cells, head, " "), **e.map(), **e.remarks(_text("/", ""), resolution.many_alleles(e.cells(e.resolved)))}


def _pieces(e: Export, cells: Column, head: Callable[[str], str], separator: str, markers: DataFrame | None = None) -> DataFrame:
    return formats.in_pieces(e.markers if markers is None else markers, e.names, cells, head, separator, e.bounds, e.digits)


def _first(e: Export, *lines: str) -> DataFrame:
    """Lines before all others, as pieces."""
    return e.data.variants.sparkSession.createDataFrame([(f" {k:04d}", "", line) for k, line in enumerate(lines)], "ord string, part string, text string")


def _flapjack(e: Export) -> dict[str, DataFrame]:
    rows = _pieces(e, formats.flapjack_cells(), str, "\t")
    genotype = _first(e, "# fjFile = GENOTYPE").unionAll(formats.names_in_pieces(e.sites, 1, " 0001", "", e.bounds, e.digits)).unionAll(rows)
    return {"genotype": genotype, "map": formats.flapjack_map(e.sites), "phenotype": formats.metadata_lines(e.people, "# fjFile = PHENOTYPE"), **e.remarks(_text("/", ""))}


def _darwin(e: Export) -> dict[str, DataFrame]:
    ploidy = e.ploidy
    places = {name: str(k + 1) for k, name in enumerate(e.names)}
    rows = _pieces(e, formats.darwin_cells(ploidy), places.__getitem__, "\t", formats.with_codes(e.markers))
    size = e.sites.agg(F.concat_ws("\t", F.lit(len(e.names)), F.count("*") * ploidy).alias("text")).select(F.lit(" 0001").alias("ord"), F.lit("").alias("part"), "text")
    var = _first(e, f"@DARwin 5.0 - ALLELIC - {ploidy}").unionAll(size).unionAll(formats.names_in_pieces(e.sites, ploidy, " 0002", "N°", e.bounds, e.digits)).unionAll(rows)
    return {"var": var, "don": formats.darwin_individuals(e.people, e.names), **e.remarks(_text("/", ""))}


def _alignment(e: Export, missing: str, head: Callable[[str], str]) -> DataFrame:
    return _pieces(e, F.transform(formats.two_bases(missing), lambda b: F.array_join(b, "")), head, "")


def _fasta(e: Export) -> dict[str, DataFrame]:
    return {"fasta": _alignment(e, "-", lambda name: f">{name}\n"), **e.map(), **e.remarks(_text("/", ""))}


def _phylip(e: Export) -> dict[str, DataFrame]:
    head = formats.line_pieces(formats.phylip_head(e.sites, e.names))
    return {"phy": head.unionAll(_alignment(e, "?", lambda name: f"{name}\t")), **e.map(), **e.remarks(_text("/", ""))}


def _nexus(e: Export) -> dict[str, DataFrame]:
    frame = formats.line_pieces(formats.nexus_frame(e.sites, e.names))
    return {"nxs": frame.unionAll(_alignment(e, "?", lambda name: f"{name}\t")), **e.map(), **e.remarks(_text("/", ""))}


def _distances(kind: str, measure: Callable[[DataFrame, list[str]], DataFrame]) -> Callable[[Export], dict[str, DataFrame]]:
    def files(e: Export) -> dict[str, DataFrame]:
        kept, names, left_out = matrix.enough_data(written(e.markers.select("variant_id", "alleles", "gts"), "markers"), e.names, kind, lacks=matrix.lacking_bases if kind == "NJ" else matrix.lacking)
        found = written(measure(kept, names), "distances")
        newick = tree.tree_of(found, names).select(F.lit("").alias("ord"), F.col("newick").alias("line"))
        text = matrix.matrix_text(found, names).select(F.lpad(F.col("ord").cast("string"), 10, "0").alias("ord"), "line")
        exported = reference_code(F.col("gt")) if kind == "ASD" else _text("/", "")
        return {"mtx": text, "nwk": newick, **e.map(), **e.remarks(exported, left_out)}

    return files


def _pca(e: Export) -> dict[str, DataFrame]:
    markers = written(e.markers.select("variant_id", "name", "ord", "gts"), "markers")
    z = matrix.standardized(matrix.variant_missing(markers))
    return {"pca": matrix.pca_lines(*matrix.principal_components(z, e.names)), **e.remarks(reference_code(F.col("gt")), matrix.too_few_calls(markers))}


WRITERS: dict[str, Callable[[Export], dict[str, DataFrame]]] = {
    "HAPMAP": _hapmap, "EIGENSTRAT": _eigenstrat, "BAYPASS": _baypass, "BED": _bed, "GFF3": lambda e: {"gff3": formats.gff3(e.markers, e.names), **e.remarks(_text("/"))}, "VCF": _vcf, "VCF.gz": _vcf_gz,
    "PLINK": _plink, "FLAPJACK": _flapjack, "DARwin": _darwin, "FASTA": _fasta, "PHYLIP": _phylip, "NEXUS": _nexus,
    "JUKES-CANTOR": _distances("NJ", matrix.jukes_cantor_distance), "ASD": _distances("ASD", matrix.allele_sharing_distance), "PCA": _pca,
}


def export(data: Dataset, format: str, request: SearchRequest = SearchRequest(), samples: bool = False, ploidy: int | None = None, selected: DataFrame | None = None) -> dict[str, DataFrame]:
    """The files of a format by their extensions (and REMARKS), for the variants and entities that a request chooses.

    Variants of types that the format doesn't take are left out; a ploidy that it doesn't take raises an error, and so do
    projects of different ploidies unless one is given. selected: the variants, if they are known (of a kept search).
    """
    kind = formats.FORMATS[format]
    ploidy = ploidy_of(data, request) if ploidy is None else ploidy
    kind.check_ploidy(ploidy)
    chosen = selection(data, request, samples, selected)
    files = WRITERS[format](Export(data, replace(chosen, variants=kind.accepts(chosen.variants)), samples, ploidy))
    if data.variant_runs is not None:
        files["ann"] = annotation_lines(data, kind.accepts(chosen.variants))
    return files


def annotation_lines(data: Dataset, variants: DataFrame) -> DataFrame:
    """(ord, line) of the annotations (ANN, else CSQ, else EFF) of placed variants: id, place and one annotation a line."""
    notes = data.variant_runs.select("variant_id", F.coalesce(*[F.try_element_at("info", F.lit(k)) for k in ("ANN", "CSQ", "EFF")]).alias("notes")).where("notes is not null").dropDuplicates(["variant_id"])
    sites = formats.site_table(variants.where("chrom is not null"), data.synonyms).join(notes, "variant_id")
    one = sites.select("ord", "name", "chrom", "start_site", F.posexplode(F.split("notes", ",")).alias("k", "note"))
    fields = F.split("note", r"\|")
    line = F.concat_ws("\t", "name", F.concat("chrom", F.lit(":"), F.col("start_site").cast("string")), *[F.coalesce(F.get(fields, F.lit(k)), F.lit("")) for k in (3, 1, 6)])
    return formats.headed(one.select(F.concat("ord", F.lit(" "), F.lpad(F.col("k").cast("string"), 6, "0")).alias("ord"), line.alias("line")), "#Uploaded_variation\tLocation\tGene\tConsequence\tFeature")


def tool_urls(settings: list[str], format: str, files: list[str]) -> dict[str, str]:
    """Of online tools (settings as parse_online_tool takes them), label to URL of those that take a format and find what they need among an export's files."""
    tools = [t for t in map(parse_online_tool, settings) if not t.formats or format in t.formats]
    found = {t.label: expand_url(t.url, files) for t in tools}
    return {label: url for label, url in found.items() if url is not None}


def register_format(kind: formats.Format, files: Callable[[Export], dict[str, DataFrame]]) -> None:
    """Add a format with its writer, or put it in the place of that with its name."""
    formats.FORMATS[kind.name] = kind
    WRITERS[kind.name] = files
