"""Packed genotypes, kept searches, groups in one pass, and other ploidies, on small cases."""

from __future__ import annotations

import collections
import random
import re
import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from allelix import queries
from allelix.functions import genotypes as g
from allelix.operators import exports, filters, resolution, vectors
from allelix.plans import execution, search, selections
from allelix.plans.requests import ChartRequest, FieldPlotRequest, Group, SearchRequest
from allelix.sources.dataset import Dataset

CELLS = "variant_id string, project_id int, run_name string, callset_id int, individual string, population string, gt string, dp int"
CODES = ("0/0", "0/1", "1/1", "1|0", "2/2", "0/2", None)


def made(spark, seed=1, n_variants=40, n_people=70, codes=CODES, ploidies=None):
    """Two runs, of which the second repeats some cells, some twice; over 64 people take two words."""
    choose, cells = random.Random(seed), []
    people = [f"p{k}" for k in range(n_people)]
    for v in range(n_variants):
        for k, name in enumerate(people):
            for run in ("r1", "r2"):
                for callset in range(choose.choice([0, 1, 1, 2]) if run == "r2" else 1):
                    gt = choose.choice(codes) if choose.random() < 0.3 else codes[(v + k) % len(codes)]
                    cells.append((f"v{v}", 1, run, 10 * k + 2 * callset + (run == "r2"), name, f"pop{k % 3}", gt, choose.randint(1, 30)))
    sites = [(f"v{v}", "SNP", f"chr{v % 2}", 10 * v + 1, 10 * v + 1, ["A", "G"] if v % 5 else ["A", "G", "T"]) for v in range(n_variants)]
    variants = spark.createDataFrame(sites, "variant_id string, type string, chrom string, start_site long, end_site long, alleles array<string>")
    table = spark.createDataFrame([(p, f"pop{k % 3}") for k, p in enumerate(people)], "individual string, population string")
    return Dataset(variants, spark.createDataFrame(cells, CELLS), table, ploidies=ploidies or {}), cells


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counted(cells, names, low=0):
    """What agrees for the named, per variant, by brute force."""
    of = collections.defaultdict(set)
    for v, _, _, _, name, _, gt, dp in cells:
        if gt is not None and name in names and dp >= low:
            of[v, name].add(gt)
    out = collections.defaultdict(collections.Counter)
    for (v, _), gts in of.items():
        if len(gts) == 1:
            out[v][min(gts)] += 1
    return {v: dict(c) for v, c in out.items()}


@pytest.fixture(scope="module")
def some(spark):
    data, cells = made(spark)
    return execution.packed_dataset(data), data, cells


def test_counts_of_packed_genotypes_by_brute_force(some):
    packed, data, cells = some
    for names in (None, ("p3",), tuple(f"p{k}" for k in range(60, 70)), ("p1", "p63", "p64", "p65", "nobody")):
        found = vectors.agreed(packed.packed).select("variant_id", vectors.counts_of(packed.packed.mask(names)).alias("c")).collect()
        assert {r.variant_id: {c.gt: c.n for c in r.c} for r in found if r.c} == counted(cells, names or packed.packed.entities)
    one = [c for c in cells if c[2] == "r2"]
    found = vectors.agreed(packed.packed, runs=((1, "r2"),)).select("variant_id", vectors.counts_of(packed.packed.mask(None)).alias("c")).collect()
    assert {r.variant_id: {c.gt: c.n for c in r.c} for r in found if r.c} == counted(one, packed.packed.entities)
    assert not [r for r in vectors.agreed(packed.packed, projects=(2,)).select("calls").collect() if r.calls]


def test_packed_cells_come_back(some):
    packed, _, cells = some
    found = collections.Counter((r.variant_id, r.run_name, r.individual, r.gt) for r in vectors.unpacked(packed.packed).collect())
    assert found == collections.Counter((v, run, name, gt) for v, _, run, _, name, _, gt, _ in cells if gt is not None)
    bits = packed.packed.table.select(F.max(F.size(F.col("runs")[0]["planes"]))).first()[0]
    assert bits == 3  # six codes and missing


def test_two_bits_hold_three_codes(spark):
    data, _ = made(spark, codes=("0/0", "0/1", "1/1", None), n_variants=3)
    table = vectors.pack(data.variants, data.genotypes, tuple(f"p{k}" for k in range(70)))
    assert {(len(run.planes), len(run.planes[0])) for r in table.collect() for run in r.runs} == {(2, 2)}
    none = vectors.pack(data.variants, data.genotypes.limit(0), ("p0",))
    assert [r.runs for r in none.collect()] == [[], [], []]
    assert vectors.pack(data.variants.limit(0), data.genotypes, ("p0",)).count() == 0


@pytest.mark.parametrize("statistic", ["density", "maf", "missing", "heterozygosity", "tajima_d", "fst"])
def test_packed_charts_are_those_of_rows(some, statistic):
    packed, data, _ = some
    groups = (Group("a", tuple(f"p{k}" for k in range(30))), Group("b", tuple(f"p{k}" for k in range(20, 69)), maf=(5, 50)))
    for request in (ChartRequest(intervals=5), ChartRequest(intervals=7, groups=groups, displayed_sequence="chr1")):
        one, two = ({r.bin_start: [None if x is None else round(x, 9) for x in r[1:]] for r in execution.chart(d, request, statistic).collect()} for d in (packed, data))
        assert one == two and len(one) > 3


def test_packed_charts_shuffle_windows_only(spark, some):
    packed, _, _ = some
    for statistic in ("maf", "missing", "heterozygosity", "tajima_d", "fst"):
        plan = plan_of(execution.chart(packed, ChartRequest(displayed_sequence="chr1", range_min=1, range_max=400, intervals=4), statistic))
        assert plan.count("Exchange hashpartitioning") == 1, plan
        assert "Exchange hashpartitioning(bin_start" in plan and "Python" not in plan


def test_groups_of_a_search_take_one_pass(spark, some):
    packed, data, cells = some
    names = [tuple(f"p{k}" for k in ks) for ks in (range(25), range(20, 50), range(50, 70))]
    groups = (
        Group("a", names[0], maf=(10, 50)), Group("b", names[1], pattern="Not all the same", discriminate=0, field_thresholds={"dp": 9}), Group("c", names[2], missing=(0, 60), discriminate=(0, 1)), Group("all", heterozygosity=(1, 90)),
    )
    request = SearchRequest(groups=groups)
    got = {r.variant_id for r in execution.selected_variants(data, request).collect()}
    counts = [counted(cells, names[0]), counted(cells, names[1], 9), counted(cells, names[2]), counted(cells, set(packed.packed.entities))]
    plain = [counted(cells, n) for n in names]
    mode = lambda k, v: min((-n, gt) for gt, n in plain[k][v].items())[1]
    dose = lambda gt: 0 if gt < "0/1" else 1 if gt == "0/1" else 2
    apart = lambda gt: gt[0] != gt[2]
    want = set()
    for v in counts[0]:
        a, b, c, every = (of.get(v, {}) for of in counts)
        share = 50 * sum(dose(gt) * n for gt, n in a.items()) / sum(a.values())
        het = 100 * sum(n for gt, n in every.items() if apart(gt)) / sum(every.values())
        fits = 10 <= min(share, 100 - share) <= 50 and len(b) > 1 and 100 * (len(names[2]) - sum(c.values())) / len(names[2]) <= 60 and 1 <= het <= 90
        if fits and mode(1, v) != mode(0, v) and mode(2, v) not in (mode(0, v), mode(1, v)):
            want.add(v)
    assert got == want and 0 < len(want) < 40
    plan = plan_of(filters.group_counts(data.genotypes, groups))
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange RoundRobin") == 1
    same = SearchRequest(groups=(groups[0], groups[3], Group("b", names[1], discriminate=0)))
    assert {r.variant_id for r in execution.selected_variants(packed, same).collect()} == {r.variant_id for r in execution.selected_variants(data, same).collect()}


def test_plans_shuffle_genotypes_as_often_as_they_must(spark):
    sf = "/root/testdata/sf0.001"
    # one exchange is the derived genotype table's own, one brings a variant's genotypes together; joins with sites add theirs
    for name, most in {"genotype_coherent": 2, "genotype_majority": 2, "search_groups": 3, "vcf_records": 4, "hapmap_lines": 3, "packed_maf": 1}.items():
        plan = plan_of(queries.QUERIES[name](spark, sf))
        assert len(re.findall("(?<!Broadcast)Exchange (?:hash|Round|range)", plan)) <= most, name


def test_named_variants(spark, some):
    _, data, _ = some
    request = SearchRequest(variant_ids=("v3", "v5", "nothing", "v3"))
    assert sorted(r.variant_id for r in execution.selected_variants(data, request).collect()) == ["v3", "v5"]


def test_groups_of_callset_ids():
    assert Group.of_callsets(["p§1§a", "p§1§b", "a"], name="x") == Group("x", ("a", "b"))


def test_searches_by_mode(spark, some):
    _, data, cells = some
    request = SearchRequest(sort_by="start_site", page=1, page_size=7, groups=(Group("a", ("p1", "p2")),))
    found = search.search(data, request)
    rows = found.page.collect()
    assert found.count == 40 and [r.variant_id for r in rows] == [f"v{k}" for k in range(7, 14)]
    for r in rows:
        assert [(g.callset_id, g.individual, g.gt) for g in r.genotypes] == sorted(((c[3], c[4], c[6]) for c in cells if c[0] == r.variant_id and c[4] in ("p1", "p2")), key=lambda c: (c[0], c[1], c[2] is not None, c[2]))
    counted_, paged = search.search(data, replace(request, mode="count")), search.search(data, replace(request, mode="page", with_genotypes=False), selected=data.variants.limit(9))
    assert counted_ == search.Found(40, None) and paged.count is None and paged.page.count() == 2 and "genotypes" not in paged.page.columns
    with pytest.raises(ValueError, match="mode"):
        SearchRequest(mode="x")
    assert search.check_matrix(data, request, data.variants) == 80
    with pytest.raises(search.MatrixTooLarge):
        search.check_matrix(data, SearchRequest(), data.variants, most=100)
    assert search.check_matrix(data, SearchRequest(limit_matrix=False), data.variants, most=100) == 40 * 70


def test_thresholds_are_those_of_each_group(spark, some):
    _, data, cells = some
    names = tuple(f"p{k}" for k in range(10))
    request = FieldPlotRequest(groups=(Group("a", names, field_thresholds={"dp": 20}),), vcf_field="dp", range_min=1, range_max=400, intervals=1)
    (found,) = execution.chart(data, request, "field_mean").collect()
    held = [c[7] for c in cells if c[4] in names and c[7] >= 20 and c[6] is not None]
    assert found["mean"] == sum(held) // len(held)


def test_kept_searches_are_charted_without_a_genotype_shuffle(spark, some):
    _, data, _ = some
    token = f"t{uuid.uuid4().hex}"
    kept = selections.keep_dataset(data, token, 4)
    thirty = tuple(f"p{k}" for k in range(30))
    least = sorted(r.maf for r in vectors.variant_statistics(some[0].packed, thirty).collect())[25]
    request = SearchRequest(groups=(Group("a", thirty, maf=(least - 1e-9, 50)),))
    assert selections.buckets_of(kept) == 4
    n = selections.keep_search(kept, request, token)
    assert 0 < n < 40
    shown = ChartRequest(range_min=1, range_max=400, intervals=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chart = selections.chart_of_kept(kept, token, shown, "maf")
        plan = plan_of(chart)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning(variant_id" not in plan
    again = ChartRequest(groups=request.groups, range_min=1, range_max=400, intervals=4)
    # all individuals are charted for the variants that the group's condition found
    plain = execution.chart(data, shown, "maf", selected=execution.selected_variants(data, again))
    assert sorted(map(str, plain.collect())) == sorted(map(str, chart.collect()))
    made_ = exports.export(kept, "BED", selected=selections.kept_search(spark, token))
    assert made_["bed"].count() == n
    assert selections.page_of_kept(spark, token, 0, 3).count() == 3
    assert selections.selection_of_kept(kept, token).variants.count() == n
    selections.forget(spark, token)
    with pytest.raises(selections.TokenNotFound, match="search again"):
        selections.chart_of_kept(kept, token, shown, "maf")
    selections.forget_dataset(spark, token)
    with pytest.raises(selections.TokenNotFound):
        selections.kept_dataset(data, token)
    with pytest.raises(ValueError, match="tokens"):
        selections.kept_search(spark, "x; drop")


def test_codes_of_any_ploidy_are_resolved(spark):
    long = ["10/10/10/10/10/11", "/".join(["10"] * 20), "/".join(["10"] * 19 + ["11"]), "0/1/2/3/4/5/6/7/8", "0", "1|0"]
    rows = [("v", f"i{k}", "p", gt) for k, gt in enumerate(long)] + [("v", f"i{k}", "p", gt) for k, gt in enumerate(long)] + [("v", "x", "p", long[1]), ("v", "x", "p", long[2]), ("v", "y", "p", None)]
    df = spark.createDataFrame(rows, "variant_id string, individual string, population string, gt string")
    assert {r.individual: r.gt for r in resolution.coherent(df).collect()} == {f"i{k}": gt for k, gt in enumerate(long)}
    found = df.select("gt", g.unpacked_parts(g.packed_parts(F.col("gt"))).alias("back")).distinct().collect()
    assert all(r.back == r.gt for r in found if r.gt is not None)


def test_projects_of_different_ploidies(spark):
    data, _ = made(spark, ploidies={1: 4, 2: 2}, n_variants=5)
    request = ChartRequest(range_min=1, range_max=400, intervals=2)
    with pytest.raises(ValueError, match="Inconsistent ploidy"):
        execution.chart(data, request, "maf").collect()
    with pytest.raises(ValueError, match="Inconsistent ploidy"):
        exports.export(data, "VCF")
    assert execution.chart(data, ChartRequest(projects=(1,), range_min=1, range_max=400, intervals=2), "maf").count() == 2
    with pytest.raises(ValueError, match="takes ploidy"):
        exports.export(data, "PLINK", SearchRequest(projects=(1,)))


def test_tetraploids_keep_their_alleles(spark):
    variants = spark.createDataFrame([("m", "SNP", "1", 5, 5, ["A", "G"])], "variant_id string, type string, chrom string, start_site long, end_site long, alleles array<string>")
    cells = [("m", 1, "r", k, name, "p", gt, 1) for k, (name, gt) in enumerate([("a", "0/0/1/1"), ("b", "0/0/0/1"), ("c", "1/1/1/1"), ("d", None)])]
    people = spark.createDataFrame([(n, "p") for n in "abcd"], "individual string, population string")
    data = Dataset(variants, spark.createDataFrame(cells, CELLS), people, ploidies={1: 4})
    text = lambda files, kind: [r.text for r in files[kind].orderBy("ord", "part").collect()]
    assert text(exports.export(data, "FLAPJACK"), "genotype")[3:] == ["a", "\tA/A/G/G", "b", "\tA/A/A/G", "c", "\tG", "d", "\t-"]
    var = text(exports.export(data, "DARwin"), "var")
    assert var[:4] == ["@DARwin 5.0 - ALLELIC - 4", "4\t4", "N°", "\tm\tm\tm\tm"]
    assert var[4:] == ["1", "\t0\t0\t1\t1", "2", "\t0\t0\t0\t1", "3", "\t1\t1\t1\t1", "4", "\t-1\t-1\t-1\t-1"]


def test_packing_gathers_codes_and_not_genotypes(spark):
    data, _ = made(spark)
    plan = vectors.pack(data.variants, data.genotypes, tuple(f"p{k}" for k in range(70)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 2 and "bit_or" in plan
