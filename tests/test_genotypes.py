"""Hand-computed values, edge cases and properties of the genotype operators."""

import gzip
import io
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelix import queries
from allelix.functions import genotypes as g
from allelix.functions import text
from allelix.operators import exports, filters, formats, matrix, resolution, tree, windows
from allelix.plans import execution, progress
from allelix.plans.requests import ChartRequest, Group, SearchRequest
from allelix.sources import archive, tables
from allelix.sources.dataset import Dataset


def cells(spark, **by_variant):
    """Genotype rows of individuals a, b, c .. in population p, one list for each variant."""
    rows = [(v, "abcdefghi"[k], "p", x) for v, codes in by_variant.items() for k, x in enumerate(codes)]
    return spark.createDataFrame(rows, "variant_id string, individual string, population string, gt string")


def placed(spark, *names):
    return spark.createDataFrame([(n, "SNP", "1", 5, 5, ["A", "G"]) for n in names], "variant_id string, type string, chrom string, start_site long, end_site long, alleles array<string>")


BINS = windows.Bins(0, 10, 1)


@pytest.fixture(scope="module")
def four(spark):
    return placed(spark, "V1", "V2", "V3"), cells(spark, V1=["0/0", "0/1", "1/1", None], V2=["0/0", "0/0", "0/1", "0/1"], V3=["0/0"] * 4)


def value(df, column):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][column]


def test_window_statistics_of_four_individuals(four):
    v, c = four
    assert value(windows.density(v, BINS), "variants") == 3
    assert value(windows.minor_allele_frequency(v, c, BINS), "maf") == pytest.approx(25)
    assert value(windows.missing_data(v, c, BINS, 4), "missing") == pytest.approx(100 / 12)
    assert value(windows.heterozygosity(v, c, BINS), "heterozygosity") == pytest.approx(100 * (1 / 3 + 1 / 2) / 3)
    d = windows.tajima_d(v, c, BINS, 4)
    assert value(d, "segregating_sites") == 2
    assert value(d, "tajima_d") == pytest.approx(1.1039355897563785)


@pytest.mark.parametrize(
    ("groups", "textbook", "expected"),
    [
        ((("0/0", "0/0", "0/1"), ("1/1", "0/1", "1/1")), False, 0.5384615384615384),
        ((("0/0", "0/0", "0/1"), ("0/0", "0/0", "0/1")), False, -0.2),
        ((("0/0", "0/0", "0/1"), ("1/1", "0/1", "1/1"), ("0/0", "0/1", "1/1")), True, 0.22580645161290322),
        ((("0/0", "0/0", "0/1"), ("1/1", "0/1", "1/1"), ("0/0", "0/1", "1/1")), False, 0.10447761194029852),
    ],
)
def test_fst(spark, groups, textbook, expected):
    rows = [("V", f"{k}{n}", f"pop{k}", x) for k, codes in enumerate(groups) for n, x in enumerate(codes)]
    resolved = spark.createDataFrame(rows, "variant_id string, individual string, population string, gt string")
    assert value(windows.fst(placed(spark, "V"), resolved, BINS, textbook), "fst") == pytest.approx(expected)


def test_fst_with_three_alleles_and_a_population_without_data(spark):
    rows = [("V", "a", "p", "0/2"), ("V", "b", "p", "0/0"), ("V", "c", "q", "2/2"), ("V", "d", "q", "0/2"), ("V", "e", "r", None), ("W", "a", "p", "0/1")]
    resolved = spark.createDataFrame(rows, "variant_id string, individual string, population string, gt string")
    assert -1 <= value(windows.fst(placed(spark, "V", "W"), resolved, BINS), "fst") <= 1


def test_windows(spark):
    bins = windows.Bins(0, 10, 7)
    assert [r[0] for r in bins.spine(spark.range(1)).orderBy("bin_start").collect()] == [0, 2, 4, 6, 8, 10, 12]
    assert windows.Bins(3, 3, 20).count == 1
    assert windows.Bins(5, 3, 20).count == 0
    last = windows.Bins(1, 100_000, 20)
    assert (last.size, last.count) == (5000, 20)
    v = spark.createDataFrame([("a", 100_000), ("b", 95_001), ("c", 95_000)], "variant_id string, start_site long")
    assert {(r.variant_id, r.bin_start) for r in last.binned(v).collect()} == {("a", 95_001), ("b", 95_001), ("c", 90_001)}


def test_empty_tables_give_empty_windows(spark, four):
    v, c = (df.limit(0) for df in four)
    assert value(windows.density(v, BINS), "variants") == 0
    assert value(windows.minor_allele_frequency(v, c, BINS), "maf") is None
    assert value(windows.missing_data(v, c, BINS, 4), "missing") is None
    assert value(windows.fst(v, c, BINS), "fst") is None


@pytest.mark.parametrize(
    ("codes", "majority", "baypass"),
    [
        (["0/1", "0/1", "0/0"], "0/1", "0/1"),
        (["0/1", "0/0"], None, None),
        (["0/0"] * 2 + ["0/1"] * 2 + ["1/1"], None, "0/0"),
        (["0/0"] * 3 + ["0/1"] * 2 + ["1/1"], "0/0", None),
        ([None, "1/1", None], "1/1", "1/1"),
        ([None], None, None),
    ],
)
def test_resolution(spark, codes, majority, baypass):
    rows = [("V", "a", "p", c) for c in codes]
    df = spark.createDataFrame(rows, "variant_id string, individual string, population string, gt string")
    assert value(resolution.majority(df), "gt") == majority
    assert value(resolution.by_count_values(df), "gt") == baypass
    same = len({c for c in codes if c}) == 1
    assert [r.gt for r in resolution.coherent(df).collect()] == ([majority] if same else [])


def test_genotype_expressions(spark):
    df = spark.createDataFrame([("1",), ("0/2",), ("1/0",), (None,), ("10/1",), ("x/1",), ("0|1",)], "gt string")
    found = df.select(g.allele_indexes(F.col("gt")).alias("a"), g.is_heterozygous(F.col("gt")).alias("h"), g.reference_code(F.col("gt")).alias("r"), g.alternate_count(F.col("gt")).alias("n")).collect()
    assert [tuple(r) for r in found] == [([1], False, 0, 1), ([0, 2], True, 1, 1), ([1, 0], True, 1, 1), (None, None, 9, None), ([10, 1], True, 0, 2), (None, None, 9, None), ([0, 1], True, 1, 1)]


def test_natural_order(spark):
    names = ["chr10", "chr2", "chr1", "chrX", "2b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(g.natural_key(F.col("n"))).collect()] == ["2b", "chr1", "chr2", "chr10", "chrX"]


def test_vcf_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (12.34, 0.5, 0.001234, 1e-25, None)], "x double")
    assert [r[0] for r in df.select(g.vcf_double(F.col("x"))).collect()] == ["12.34", "0.500", "1.234e-03", "0.00", "."]
    assert [r[0] for r in spark.createDataFrame([(30.0,), (30.5,), (None,)], "x double").select(g.vcf_quality(F.col("x"))).collect()] == ["30", "30.50", "."]


def test_missing_individuals_and_variants(spark):
    df = cells(spark, V1=["0/0", None, None], V2=["0/0", None, "0/1"])
    assert {r.individual: (r.missing, r.kept) for r in matrix.individual_missing(df, 2).collect()} == {"a": (0, True), "b": (100, False), "c": (50, True)}
    kept = matrix.variant_missing(matrix.dense(df, ["a", "b", "c"]), 50)
    assert [r.variant_id for r in kept.collect()] == ["V2"]


def test_neighbour_joining_recovers_an_additive_tree():
    d = np.zeros((4, 4))
    for (i, j), x in {(0, 1): 5, (0, 2): 7, (0, 3): 8, (1, 2): 8, (1, 3): 9, (2, 3): 9}.items():
        d[i, j] = d[j, i] = x
    newick = tree.neighbour_joining(list("ABCD"), d)
    assert "(A:2,B:3)" in newick
    assert "C:4" in newick
    assert "D:5" in newick
    assert tree.neighbour_joining(["A", "B"], np.array([[0, 3.0], [3, 0]])) == "(A:1.5,B:1.5);"


def test_distances_are_pairwise_complete(spark):
    names = ["a", "b", "c"]
    m = matrix.dense(cells(spark, V1=["0/0", "1/1", None], V2=["0/0", "0/1", "0/1"]), names)
    found = {(r.a, r.b): r.distance for r in matrix.allele_sharing_distance(m, names).collect()}
    assert found == {("a", "b"): 1.5, ("a", "c"): 1.0, ("b", "c"): 0.0}
    jc = {(r.a, r.b): r.distance for r in matrix.jukes_cantor_distance(m, names).collect()}
    assert jc[("b", "c")] == 0
    assert jc[("a", "b")] == 5.0  # three of four alleles differ: saturated
    lines = [r.line for r in matrix.matrix_text(matrix.allele_sharing_distance(m, names), names).orderBy("ord").collect()]
    assert lines == ["\t3", "a 0.000000 1.500000 1.000000", "b 1.500000 0.000000 0.000000", "c 1.000000 0.000000 0.000000"]


def test_principal_components_keep_the_variance(spark):
    names = ["a", "b", "c", "d"]
    z = matrix.standardized(matrix.dense(cells(spark, V1=["0/0", "0/1", "1/1", None], V2=["0/0", "0/0", "0/1", "1/1"], V3=["0/0"] * 4), names))
    values, scores = matrix.principal_components(z, names)
    assert values.sum() == pytest.approx(2)  # variants that aren't constant
    assert scores.count() == 16


def test_filters_on_groups(spark):
    df = cells(spark, V1=["0/0", "0/1", "1/1", "0/0"], V2=["0/0"] * 4, V3=["1/1", "1/1", None, None])

    def of(**options):
        return {r.variant_id for r in filters.filter_group(df, Group(**options), 4).collect()}

    assert of(pattern="All Homozygous Ref") == {"V2"}
    assert of(pattern="All Homozygous Var") == {"V3"}
    assert of(pattern="Not all the same") == {"V1"}
    assert of(missing=(50, 100)) == {"V3"}
    assert of(individuals=("a", "b"), pattern="All different") == {"V1"}
    assert {r.variant_id for r in filters.discriminate(df, Group(individuals=("a",)), Group(individuals=("c",))).collect()} == {"V1"}
    with pytest.raises(ValueError, match="pattern"):
        Group(pattern="Whatever")


def test_chart_range_and_selection_are_both_applied(spark):
    v = spark.createDataFrame([("a", "INDEL", "1", 5, 12, ["A", "G"]), ("b", "SNP", "1", 11, 11, ["A", "G", "T"]), ("c", "SNP", None, None, None, ["A"])], placed(spark, "x").schema)

    def of(request):
        return {r.variant_id for r in filters.filter_variants(v, request).collect()}

    assert of(SearchRequest(start=10, end=20)) == {"a", "b"}
    assert of(SearchRequest(start=10, end=20, variant_types=("SNP",))) == {"b"}
    assert of(ChartRequest(start=10, displayed_sequence="1", range_min=1, range_max=6)) == {"a"}
    assert of(SearchRequest(sequences=(None,))) == {"c"}
    assert of(SearchRequest()) == {"a", "b", "c"}


def test_formats_registry():
    formats.FORMATS["PLINK"].check_ploidy(2)
    formats.FORMATS["VCF"].check_ploidy(4)
    with pytest.raises(ValueError, match="ploidy"):
        formats.FORMATS["PLINK"].check_ploidy(4)
    assert len(formats.FORMATS) == 16


def test_vcf_file_is_block_gzipped(spark, tmp_path, four):
    v, c = four
    names = list("abcd")
    lines = formats.vcf(formats.marker_table(v, c, names), names, contigs=[("1", 100)], assembly="as1")
    path = str(tmp_path / "x.zip")
    archive.write_zip(path, {"x.vcf.gz": lines, "x-REMARKS.txt": "none\n"})
    with zipfile.ZipFile(path) as z:
        data = z.read("x.vcf.gz")
        assert z.read("x-REMARKS.txt") == b"none\n"
    assert data.endswith(archive.END)
    found = gzip.decompress(data).decode().splitlines()
    assert found[0] == "##fileformat=VCFv4.1"
    assert "##contig=<ID=1,length=100,assembly=as1>" in found
    assert found[-3].split("\t") == ["1", "5", "V1", "A", "G", ".", ".", ".", "GT", "0/0", "0/1", "1/1", "./."]


def test_blocks_of_a_long_file():
    data = bytes(range(256)) * 1000
    out = io.BytesIO()
    archive.write_bgzf([data], out)
    assert gzip.decompress(out.getvalue()) == data


def test_text_lines_by_spark(spark, tmp_path):
    archive.write_lines(spark.createDataFrame([("b", "2"), ("a", "1")], "ord string, line string"), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["1", "2"]


def test_eigenstrat_lines_must_fit(spark):
    lines = spark.createDataFrame([("m", "019")], "marker string, line string")
    assert [(r.individual, r.dosage) for r in tables.eigenstrat_genotypes(lines, ["a", "b", "c"]).collect()] == [("a", 0), ("b", 1), ("c", None)]
    with pytest.raises(Exception, match="right length"):
        tables.eigenstrat_genotypes(lines, ["a", "b"]).collect()


def test_pieces_by_sequence(spark, four):
    v, c = four
    names = list("abcd")
    rows = formats.by_individual(formats.marker_table(v, c, names), names, F.col("gts"), pieces=True).collect()
    assert [r.cells for r in rows if r.individual == "b"] == [["0/1", "0/0", "0/0"]]
    whole = formats.by_individual(formats.marker_table(v, c, names), names, F.col("gts")).collect()
    assert {r.individual: r.cells for r in whole}["b"] == ["0/1", "0/0", "0/0"]
    far = v.withColumn("start_site", F.when(F.col("variant_id") == "V2", 20_000_005).otherwise(F.col("start_site")))
    pieces = formats.in_pieces(formats.marker_table(far, c, names), names, F.col("gts"), str, " ").orderBy("ord", "part").collect()
    assert ["".join(r.text for r in pieces if r.ord.endswith(str(k))) for k in range(4)] == ["a 0/0 0/0 0/0", "b 0/1 0/0 0/0", "c 1/1 0/0 0/1", "d NULL 0/0 0/1".replace("NULL ", "")]


def test_unplaced_markers_come_in_parts(spark, monkeypatch):
    rows = [(f"v{k}", "SNP", None if k % 3 else "1", None if k % 3 else k, None, ["A", "G"]) for k in range(60)]
    v = spark.createDataFrame(rows, "variant_id string, type string, chrom string, start_site long, end_site long, alleles array<string>").repartition(4)
    c = spark.createDataFrame([(f"v{k}", "a", "p", f"{k % 2}/{k % 2}") for k in range(60)], "variant_id string, individual string, population string, gt string")
    markers = formats.marker_table(v, c, ["a"])
    assert formats.unplaced_bounds(markers) == []
    bounds = formats.unplaced_bounds(markers, 7)
    assert len(bounds) >= 5 and bounds == sorted(bounds)
    pieces = formats.in_pieces(markers, ["a"], F.col("gts"), str, " ", bounds).orderBy("ord", "part").collect()
    assert len(pieces) >= 7 and max(r.text.count("/") for r in pieces[2:]) <= 20
    (whole,) = formats.by_individual(markers, ["a"], F.col("gts")).collect()
    assert "".join(r.text for r in pieces) == " ".join(["a", *whole.cells])
    names = formats.names_in_pieces(markers, 1, "0", "", bounds).orderBy("part").collect()
    assert "".join(r.text for r in names).split("\t")[1:] == [r.name for r in markers.orderBy("ord").collect()]


def test_spanning_deletions_are_gaps_of_alignments(spark):
    rows = [(f"v{k}", ["A", "*", "G"], ["0/0", "1/1" if k < 6 else "2/2", "0/1", "0/2"]) for k in range(10)]
    table = spark.createDataFrame(rows, "variant_id string, alleles array<string>, gts array<string>")
    missing = {r.individual: r.missing for r in matrix.missing_of_columns(table, list("abcd"), matrix.lacking_bases).collect()}
    assert missing == {"a": 0, "b": 60, "c": 50, "d": 0}
    _, kept, left_out = matrix.enough_data(table, list("abcd"), "NJ", lacks=matrix.lacking_bases)
    assert kept == list("acd") and "individual b" in left_out.first().line
    _, everyone, _ = matrix.enough_data(table, list("abcd"), "ASD")
    assert everyone == list("abcd")
    found = {(r.a, r.b): r.distance for r in matrix.jukes_cantor_distance(table, list("abcd")).collect()}
    assert found["a", "c"] == 0  # the one base that both have agrees; a deletion is no base
    assert found["a", "b"] == 5


def test_online_tools():
    tool = text.parse_online_tool("Viewer; http://x/?map={map|txt}&g={genotype}&y=1 ; FLAPJACK, PLINK")
    assert tool.label == "Viewer"
    assert tool.formats == ("FLAPJACK", "PLINK")
    assert text.expand_url(tool.url, ["http://f/a.genotype"]) == "http://x/?g=http://f/a.genotype&y=1"
    assert text.expand_url("http://x/{vcf}", ["a.ped"]) is None
    settings = ["Viewer;http://x/?m={map};PLINK", "Other;http://y/?v={vcf};VCF", "All;http://z/{ped}"]
    assert exports.tool_urls(settings, "PLINK", ["http://f/a.ped", "http://f/a.map"]) == {"Viewer": "http://x/?m=http://f/a.map", "All": "http://z/http://f/a.ped"}


def test_codes_are_packed_and_unpacked(spark):
    codes = ["0/1", "1", "10/11/12/13", "0|1", "./.", "0/0/0/0/0/0/0/1", None]
    df = spark.createDataFrame([(c,) for c in codes], "gt string")
    found = df.select("gt", g.packed_code(F.col("gt")).alias("n"), g.unpacked_code(g.packed_code(F.col("gt"))).alias("back")).collect()
    assert [r.back for r in found] == codes
    assert len({r.n for r in found}) == len(codes)
    with pytest.raises(Exception, match="not a genotype code"):
        spark.createDataFrame([("A/B",)], "gt string").select(g.packed_code(F.col("gt"))).collect()


def test_marker_tables_are_filled_by_place(spark):
    names = [f"i{k}" for k in range(6)]
    rows = [("V", "i1", "0/0"), ("V", "i4", None), ("V", "i5", "1/1"), ("W", "i0", "0/1"), *[("X", n, "0/0") for n in names], ("Y", "unknown", "0/0")]
    found = {r.variant_id: r.gts for r in matrix.dense(spark.createDataFrame(rows, "variant_id string, individual string, gt string"), names).collect()}
    assert found == {"V": [None, "0/0", None, None, None, "1/1"], "W": ["0/1", *[None] * 5], "X": ["0/0"] * 6}


def test_variant_types_of_formats(spark):
    types = ("SNP", "MNP", "INDEL", "MIXED", "SYMBOLIC", "NO_VARIATION")
    df = spark.createDataFrame([(t,) for t in types], "type string")
    taken = {name: {r.type for r in kind.accepts(df).collect()} for name, kind in formats.FORMATS.items()}
    assert taken["HAPMAP"] == taken["PLINK"] == {"SNP", "MNP", "INDEL", "MIXED", "NO_VARIATION"}
    assert taken["BAYPASS"] == {"SNP", "NO_VARIATION"}
    for name in ("EIGENSTRAT", "FASTA", "PHYLIP", "NEXUS", "JUKES-CANTOR", "ASD", "PCA"):
        assert taken[name] == {"SNP"}
    for name in ("BED", "GFF3", "VCF", "VCF.gz", "FLAPJACK", "DARwin"):
        assert taken[name] == set(types)


def test_statistics_without_individuals(four):
    v, c = (df.limit(0) for df in four)
    assert value(windows.tajima_d(v, c, BINS, 0), "tajima_d") is None


def test_vcf_values(spark):
    df = spark.createDataFrame([(1.5, [1, None], True, "x"), (None, [], False, None)], "d double, l array<int>, f boolean, s string")
    found = df.select(*[g.vcf_value(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).collect()
    assert [tuple(r) for r in found] == [("1.50", "1,.", "", "x"), (".", ".", None, ".")]
    below = spark.createDataFrame([(-0.5,), (1.0,), (0.01,)], "x double").select(g.vcf_double(F.col("x"))).collect()
    assert [r[0] for r in below] == ["-5.000e-01", "1.00", "0.010"]
    sites = spark.createDataFrame([("V", None, None, None)], "variant_id string, qual double, filters array<string>, info struct<A:int>")
    markers = formats.marker_table(placed(spark, "V"), cells(spark, V=["0/1", None]), ["a", "b"])
    depth = spark.createDataFrame([("V", "a", 3)], "variant_id string, individual string, ad int")
    lines = formats.vcf(markers, ["a", "b"], depth, ("ad",), sites=sites, numbers={"ad": 2}).orderBy("ord").collect()
    assert lines[-1].line.split("\t") == ["1", "5", "V", "A", "G", ".", ".", ".", "GT:AD", "0/1:3", "./.:.,."]
    assert spark.range(1).select(g.callset_of(F.lit("p§ind§7"))).first()[0] == "7"


def dataset_of(spark, four, **more):
    v, c = four
    genotypes = c.withColumns({"project_id": F.lit(1), "run_name": F.lit("r"), "callset_id": F.ascii("individual")})
    people = spark.createDataFrame([(i, "p") for i in "abcd"], "individual string, population string")
    return Dataset(**({"variants": v, "genotypes": genotypes, "people": people} | more))


def text_of(files, kind):
    return b"".join(archive.lines_of(files[kind])).decode()


def test_exports_by_name(spark, four, tmp_path):
    data = dataset_of(spark, four)
    kinds = {"HAPMAP": {"hapmap"}, "EIGENSTRAT": {"eigenstratgeno", "snp", "ind"}, "BAYPASS": {"baypass", "popnames", "_snp.code"}, "BED": {"bed"}, "GFF3": {"gff3"}, "VCF": {"vcf"}, "VCF.gz": {"vcf.gz"}, "PLINK": {"ped", "map"}}
    kinds |= {"FLAPJACK": {"genotype", "map", "phenotype"}, "DARwin": {"var", "don"}, "FASTA": {"fasta", "map"}, "PHYLIP": {"phy", "map"}, "NEXUS": {"nxs", "map"}, "PCA": {"pca"}}
    kinds |= {name: {"mtx", "nwk", "map"} for name in ("JUKES-CANTOR", "ASD")}
    made = {name: exports.export(data, name) for name in kinds}
    assert {name: set(files) - {"REMARKS"} for name, files in made.items()} == kinds
    assert text_of(made["PLINK"], "ped") == "p a 0 0 0 U A A A A A A\np b 0 0 0 U A G A A A A\np c 0 0 0 U G G A G A A\np d 0 0 0 U 0 0 A G A A\n"
    assert text_of(made["PHYLIP"], "phy") == "4 6\na\tAAAAAA\nb\tAGAAAA\nc\tGGAGAA\nd\t??AGAA\n"
    assert text_of(made["FASTA"], "fasta").splitlines()[-2:] == [">d", "--AGAA"]
    assert text_of(made["FLAPJACK"], "genotype") == "# fjFile = GENOTYPE\n\tV1\tV2\tV3\na\tA\tA\tA\nb\tA/G\tA\tA\nc\tG\tA/G\tA\nd\t-\tA/G\tA\n"
    assert text_of(made["DARwin"], "var") == "@DARwin 5.0 - ALLELIC - 2\n4\t6\nN°\tV1\tV1\tV2\tV2\tV3\tV3\n1\t0\t0\t0\t0\t0\t0\n2\t0\t1\t0\t0\t0\t0\n3\t1\t1\t0\t1\t0\t0\n4\t-1\t-1\t0\t1\t0\t0\n"
    assert text_of(made["NEXUS"], "nxs").startswith("#NEXUS\nbegin data;\ndimensions ntax=4 nchar=6;\nformat datatype=dna missing=? gap=-;\nmatrix\na\tAAAAAA\n")
    assert text_of(made["NEXUS"], "nxs").endswith("d\t??AGAA\n;\nend;\n")
    path = str(tmp_path / "x.zip")
    archive.write_export(path, made["PLINK"], "mine")
    with zipfile.ZipFile(path) as z:
        assert set(z.namelist()) == {"mine.ped", "mine.map"}
    with pytest.raises(ValueError, match="ploidy"):
        exports.export(data, "PLINK", ploidy=4)


def test_individuals_with_too_little_data(spark, four):
    v, _ = four
    few = cells(spark, V1=["0/0", "0/1", None], V2=["0/0", "1/1", None], V3=["0/1", "0/1", "0/0"])
    data = dataset_of(spark, (v, few), people=spark.createDataFrame([(i, "p") for i in "abc"], "individual string, population string"))
    files = exports.export(data, "ASD")
    assert text_of(files, "REMARKS") == "- Excluding individual c from ASD export, it has too much missing data: 66%\n"
    assert text_of(files, "mtx").splitlines()[0] == "\t2"
    assert text_of(files, "nwk") == "(a:0.5,b:0.5);\n"
    with pytest.raises(ValueError, match="Not enough individuals"):
        exports.export(dataset_of(spark, (v, few.where("individual <> 'a'"))), "ASD")


def test_registered_formats_take_the_place_of_others(spark, four):
    old, writer = formats.FORMATS["BED"], exports.WRITERS["BED"]
    try:
        exports.register_format(formats.Format("BED", ("bed",), ("INDEL",)), lambda e: {"bed": formats.bed(e.sites)})
        assert exports.export(dataset_of(spark, four), "BED")["bed"].count() == 0
    finally:
        exports.register_format(old, writer)


def test_thresholds_of_a_group_hold_for_its_individuals(spark):
    df = spark.createDataFrame([("V", "a", "0/0", 5), ("V", "b", "0/0", 5), ("V", "c", "0/1", 20)], "variant_id string, individual string, gt string, dp int")
    found = execution.with_thresholds(df, (Group(individuals=("a", "c"), field_thresholds={"dp": 10}), Group(individuals=("b",))))
    assert {r.individual: r.gt for r in found.collect()} == {"a": None, "b": "0/0", "c": "0/1"}
    found = execution.with_thresholds(df, (Group(field_thresholds={"dp": 10}),))
    assert [r.gt for r in found.orderBy("individual").collect()] == [None, None, "0/1"]


def test_groups_are_stopped_and_watched(spark):
    with progress.job_group(spark, "mine", "a count"):
        assert spark.range(100).repartition(4).count() == 100
    assert 0 < progress.progress(spark, "mine") <= 1
    with pytest.raises(KeyError), progress.job_group(spark, "other", "an error"):
        raise KeyError
    assert progress.progress(spark, "other") == 0
    progress.abort(spark, "other")


def textbook_joining(names, d):
    """Neighbour joining by dictionaries: the splits and lengths of all branches but the last."""
    d = {(a, b): d[i][j] for i, a in enumerate(names) for j, b in enumerate(names)}
    nodes, out = [(n,) for n in names], {}
    d = {((a,), (b,)): x for (a, b), x in d.items()}
    while len(nodes) > 2:
        n, total = len(nodes), {a: sum(d[a, b] for b in nodes) for a in nodes}
        a, b = min(((a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]), key=lambda p: (n - 2) * d[p] - total[p[0]] - total[p[1]])
        out[frozenset(a)] = (d[a, b] + (total[a] - total[b]) / (n - 2)) / 2
        out[frozenset(b)] = d[a, b] - out[frozenset(a)]
        new = a + b
        for c in nodes:
            if c not in (a, b):
                d[new, c] = d[c, new] = (d[a, c] + d[b, c] - d[a, b]) / 2
        d[new, new] = 0
        nodes = [c for c in nodes if c not in (a, b)] + [new]
    return out


def branches_of(newick):
    """Splits and lengths of a tree's branches."""
    out, stack, at = {}, [[]], 0
    text = newick.rstrip(";")
    while at < len(text):
        if text[at] == "(":
            stack.append([])
            at += 1
        elif text[at] == ",":
            at += 1
        else:
            leaves = [c for group in stack.pop() for c in group] if text[at] == ")" else None
            at += text[at] == ")"
            m = re.match(r"([^:,()]*)(?::([-0-9.e]+))?", text[at:])
            at += m.end()
            leaves = leaves if leaves is not None else [m[1]]
            if m[2] is not None:
                out[frozenset(leaves)] = float(m[2])
            stack[-1].append(leaves)
    return out


def test_tree_of_the_tables_is_the_textbook_tree(spark):
    sf = "/root/testdata/sf0.001"
    pairs = queries.QUERIES["asd_matrix"](spark, sf).collect()
    names = sorted({r.a for r in pairs} | {r.b for r in pairs}, key=lambda n: int(n[3:]))
    d = [[0.0] * len(names) for _ in names]
    for r in pairs:
        d[names.index(r.a)][names.index(r.b)] = d[names.index(r.b)][names.index(r.a)] = r.distance
    found = branches_of(queries.QUERIES["nj_newick"](spark, sf).first()["newick"])
    for split, length in textbook_joining(names, d).items():
        if length > 1e-3 and frozenset(names) - split not in found:
            assert found[split] == pytest.approx(length, abs=1e-3)


def test_scores_of_the_tables_are_those_of_the_gram_matrix(spark):
    sf = "/root/testdata/sf0.001"
    gram = {(r.i, r.j): r.product for r in queries.QUERIES["pca_gram"](spark, sf).collect()}
    n = max(j for _, j in gram) + 1
    g_ = np.array([[gram[min(i, j), max(i, j)] for j in range(n)] for i in range(n)])
    rows = queries.QUERIES["pca_scores"](spark, sf).collect()
    names = sorted({r.individual for r in rows}, key=lambda x: int(x[3:]))
    s = np.zeros((n, n))
    for r in rows:
        s[names.index(r.individual), r.component - 1] = r.score
    assert np.allclose(s @ s.T, g_, atol=1e-2)  # all components are kept here
    assert np.allclose(g_ @ s, s * (s**2).sum(0), atol=1e-1)
    head = next(r.line for r in queries.QUERIES["pca_lines"](spark, sf).collect() if r.line.startswith("#eigvals"))
    assert np.allclose([float(x) for x in head.split("\t")[1:]], np.sort(np.linalg.eigvalsh(g_))[::-1] / (n - 1), atol=1e-3)


def test_counts_of_populations_are_summed_once(spark):
    codes = ["0/0", "0/1", "1/1", "0|1", "1|1", "0/2", "2/2", "1", None, "0/0/1"]
    names = [f"i{k}" for k in range(len(codes))]
    markers = formats.marker_table(placed(spark, "V", "W"), cells_of_names(spark, names, V=codes, W=[None] * len(codes)), names)
    for of in (lambda k: "p", lambda k: f"p{k % 2}"):
        populations = {n: of(k) for k, n in enumerate(names)}
        lines = formats.baypass(markers, populations)["baypass"]
        pairs = [(c or "").replace("|", "/").split("/") for c in codes]
        share = lambda p: (p.count("0"), 1 if p.count("0") == 1 else 2 * (p == ["1", "1"])) if len(p) == 2 else (0, 0)
        want = [str(sum(share(p)[side] for p, n in zip(pairs, names, strict=True) if populations[n] == q)) for q in sorted(set(populations.values())) for side in (0, 1)]
        assert [r.line for r in lines.collect()] == [" ".join(want) + " "]
        conditions = [line for line in lines._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
        assert conditions and not any("aggregate(" in line for line in conditions)


def cells_of_names(spark, names, **variants):
    rows = [(v, n, "p", c) for v, codes in variants.items() for n, c in zip(names, codes, strict=True)]
    return spark.createDataFrame(rows, "variant_id string, individual string, population string, gt string")


def test_genotypes_are_gathered_once(spark):
    rng = np.random.default_rng(3)
    rows = [(f"V{rng.integers(20)}", f"i{rng.integers(12)}", "p", str(rng.choice(["0/0", "0/1", "1/1"])) if rng.random() < 0.8 else None, int(rng.integers(50)) if rng.random() < 0.8 else None) for _ in range(900)]
    df = spark.createDataFrame(rows, "variant_id string, individual string, population string, gt string, dp int")
    want = {}
    for v, i, _, gt, dp in rows:
        of = want.setdefault((v, i), {})
        if gt is not None:
            n, most = of.get(gt, (0, None))
            of[gt] = (n + 1, max((x for x in (most, dp) if x is not None), default=None))
    best = lambda of: min(((-n, gt, dp) for gt, (n, dp) in of.items()), key=lambda x: x[:2])[1:] if of else (None, None)
    tied = lambda of: len(of) > 1 and sorted(n for n, _ in of.values())[-2] == max(n for n, _ in of.values())
    expected = {k: ((None, None) if tied(of) else best(of), len(of) > 1) for k, of in want.items()}
    assert {(r.variant_id, r.individual): ((r.gt, r.dp), r.conflict) for r in resolution.majority(df, ("dp",)).collect()} == expected
    names = [f"i{k}" for k in range(11)]
    sites = spark.createDataFrame([(f"V{k}", "SNP", "1", k, k, ["A", "G"]) for k in range(20)], "variant_id string, type string, chrom string, start_site int, end_site int, alleles array<string>")
    markers = formats.marker_table(sites, formats.resolved_rows(df, names), names)
    assert {r.variant_id: r.gts for r in markers.collect()} == {f"V{k}": [expected.get((f"V{k}", n), ((None, None), False))[0][0] for n in names] for k in range(20)}
    assert markers._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1


def test_close_markers_make_smaller_parts_and_no_cell_is_a_row(spark):
    rows = [(f"v{k:04d}", "SNP", "1", 1 + k % 100, 1 + k % 100, ["A", "G"]) for k in range(2000)]
    v = spark.createDataFrame(rows, "variant_id string, type string, chrom string, start_site long, end_site long, alleles array<string>")
    c = spark.createDataFrame([(f"v{k:04d}", n, "p", f"{(k + j) % 2}/1") for k in range(2000) for j, n in enumerate("ab")], "variant_id string, individual string, population string, gt string")
    markers = formats.marker_table(v, c, ["a", "b"])
    assert [formats.part_digits(formats.site_table(v), most) for most in (2000, 500, 200, 20, 3)] == [6, 1, 1, 0, 0]
    pieces = formats.in_pieces(markers, ["a", "b"], F.col("gts"), str, " ", digits=1)
    assert "Generate" not in pieces._jdf.queryExecution().optimizedPlan().toString()
    found = pieces.orderBy("ord", "part").collect()
    assert max(r.text.count("/") for r in found) <= 200
    order = sorted(range(2000), key=lambda k: (k % 100, k))
    for j, name in enumerate("ab"):
        assert "".join(r.text for r in found if r.ord == f"{j:010d}") == " ".join([name, *[f"{(k + j) % 2}/1" for k in order]])


def test_standardized_values_hold_a_few_variants_at_once(spark):
    df = spark.range(3000).selectExpr("concat('v', id) AS variant_id", "array('0/0', if(id % 3 = 0, '0/1', '1/1'), if(id % 2 = 0, null, '0/1')) AS gts")
    z = matrix.standardized(df)
    assert "MapInArrow" in z._jdf.queryExecution().optimizedPlan().toString()
    found = {r.variant_id: r.z for r in z.collect()}
    assert len(found) == 3000 and found["v0"] == pytest.approx([-1, 1, 0]) and found["v1"] == pytest.approx([-1, 1, 0])


def test_components_take_one_python_step_a_task(spark, monkeypatch):
    labels, real = [], matrix.written
    monkeypatch.setattr(matrix, "written", lambda df, label: labels.append(label) or real(df, label))
    df = spark.range(50).selectExpr("concat('v', id) AS variant_id", "array('0/0', if(id % 3 = 0, '0/1', '1/1'), if(id % 2 = 0, null, '0/1')) AS gts")
    values, scores = matrix.principal_components(matrix.standardized(df), ["a", "b", "c"])
    assert labels == ["standardized"] and values.sum() == pytest.approx(50) and scores.count() == 9
