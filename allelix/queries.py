"""Every operator as a query over the fixed genotype tables, with the same in DuckDB SQL."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.genotypes import alternate_count, natural_key
from .operators import exports, filters, formats, matrix, resolution, tree, vectors, windows
from .plans import execution, search, selections
from .plans.requests import PATTERNS, ChartRequest, FieldPlotRequest, Group, SearchRequest
from .runtime import running, shared_place
from .sources import eigenstrat, sinks, tables
from .sources.dataset import Dataset

Query = Callable[[SparkSession, str], DataFrame]

BINS = windows.Bins(1, 100_000, 20)
CHART = ChartRequest(displayed_sequence="chr1", range_min=1, range_max=100_000, intervals=20)

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# The same tables in SQL; every oracle below begins with those that it needs.
VARIANTS_SQL = """variants AS (
    SELECT 'v' || p_partkey AS variant_id, CASE p_type WHEN 'ECONOMY' THEN 'INDEL' WHEN 'PROMO' THEN 'MIXED' ELSE 'SNP' END AS type,
           CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE 'chr' || (p_size % 4 + 1) END AS chrom,
           CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE (p_partkey * 7919) % 100000 + 1 END AS start_site,
           CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE (p_partkey * 7919) % 100000 + 1 + CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 3 ELSE 0 END END AS end_site,
           CASE p_type WHEN 'PROMO' THEN ['A', 'G', 'T'] ELSE ['A', 'G'] END AS alleles FROM part)"""
GENOTYPES_SQL = """genotypes AS (
    SELECT 'v' || pk AS variant_id, 1 AS project_id, 'run' || run AS run_name, CAST(ind * 2 + run AS INT) AS callset_id, 'ind' || ind AS individual, 'pop' || (ind % 3) AS population,
           CASE WHEN s % 11 = 0 THEN NULL WHEN h < 4 THEN '0/0' WHEN h < 7 THEN '0/1' ELSE '1/1' END AS gt, CAST(dp AS INT) AS dp
    FROM (SELECT *, (pk * 37 + ind * (11 + pk % 5) + (pk % 7) * (ind % 3) * 3 + CASE WHEN s % 13 = 0 THEN 5 ELSE 0 END) % 10 AS h
          FROM (SELECT l_partkey AS pk, l_suppkey % 20 AS ind, l_linenumber % 2 + 1 AS run, SUM(l_linenumber) AS s, SUM(CAST(l_quantity AS INT)) AS dp FROM lineitem GROUP BY ALL)))"""
COHERENT_SQL = """resolved AS (SELECT variant_id, individual, population, min(gt) AS gt FROM genotypes WHERE gt IS NOT NULL GROUP BY ALL HAVING count(DISTINCT gt) = 1)"""
CHART_SQL = """chart AS (SELECT variant_id, CAST(1 + least(floor((start_site - 1) / 5000), 19) * 5000 AS BIGINT) AS bin_start FROM variants
    WHERE chrom = 'chr1' AND start_site BETWEEN 1 AND 100000 AND len(alleles) < 3)"""
SPINE_SQL = """spine AS (SELECT CAST(1 + 5000 * i AS BIGINT) AS bin_start FROM range(20) t(i))"""
COUNTED_SQL = """counted AS (SELECT variant_id, individual, population, gt, count(gt) AS n, max(dp) AS dp FROM genotypes GROUP BY variant_id, individual, population, gt),
    listed AS (SELECT variant_id, individual, population, coalesce(list(struct_pack(n := n, gt := gt, dp := dp) ORDER BY n DESC, gt) FILTER (n > 0), []) AS found FROM counted GROUP BY ALL)"""
MAJORITY_SQL = COUNTED_SQL + """,
    majority AS (SELECT variant_id, individual, population, CASE WHEN len(found) = 1 OR found[1].n <> found[2].n THEN found[1].gt END AS gt, len(found) > 1 AS conflict,
                        CASE WHEN len(found) = 1 OR found[1].n <> found[2].n THEN found[1].dp END AS dp FROM listed)"""


def _natural(column: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({column}, '(\d+|\D+)'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(x, 20, '0') ELSE x END), '')"


PEOPLE_SQL = f"""people AS (SELECT individual, population, row_number() OVER (ORDER BY {_natural("individual")}) - 1 AS k FROM (SELECT DISTINCT individual, population FROM genotypes))"""
ORD_SQL = rf"coalesce({_natural('chrom')}, '~') || ' ' || lpad(CAST(coalesce(start_site, 0) AS VARCHAR), 20, '0') || ' ' || variant_id"
#: One row for each marker and individual, with null genotypes where there are none.
CELLS_SQL = MAJORITY_SQL + f""", {PEOPLE_SQL},
    cells AS (SELECT v.*, {ORD_SQL.replace("variant_id", "v.variant_id")} AS ord, p.individual, p.population, p.k, m.gt, m.dp, coalesce(m.conflict, false) AS conflict,
                     CASE WHEN m.gt IS NOT NULL THEN v.alleles[CAST(split_part(m.gt, '/', 1) AS INT) + 1] END AS a1, CASE WHEN m.gt IS NOT NULL THEN v.alleles[CAST(split_part(m.gt, '/', 2) AS INT) + 1] END AS a2
              FROM variants v CROSS JOIN people p LEFT JOIN majority m ON m.variant_id = v.variant_id AND m.individual = p.individual)"""


def query(sql: str | None = None, *parts: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, and its SQL after the named common tables."""

    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (f"WITH {', '.join(parts)}" if parts else "") + (sql if sql.startswith(",") else f" {sql}")
        return f

    return add


def chart_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_variants(tables.variants(spark, sf_dir), CHART).where(filters.biallelic())


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes of the chart's variants only, so that others are never shuffled twice."""
    return resolution.coherent(tables.genotypes(spark, sf_dir).join(chart_variants(spark, sf_dir).select("variant_id"), "variant_id", "left_semi"))


def n_individuals(spark: SparkSession, sf_dir: str) -> int:
    return tables.individuals(spark, sf_dir).count()


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Filters


def _plain(df: DataFrame) -> DataFrame:
    return df.select("variant_id", "type", "chrom", "start_site")


def _filter_query(name: str, request: SearchRequest, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(filters.filter_variants(tables.variants(spark, sf_dir), request))

    run.__name__ = name
    query(f"SELECT variant_id, type, chrom, start_site FROM variants WHERE {condition}", VARIANTS_SQL)(run)


_filter_query("filter_types", SearchRequest(variant_types=("INDEL", "MIXED")), "type IN ('INDEL', 'MIXED')")
_filter_query("filter_position_overlap", SearchRequest(start=50_000, end=60_000), "(start_site >= 50000 OR end_site >= 50000) AND start_site <= 60000")
_filter_query("filter_position_snps", SearchRequest(start=50_000, end=60_000, variant_types=("SNP",)), "type = 'SNP' AND start_site BETWEEN 50000 AND 60000")
_filter_query("filter_allele_count", SearchRequest(allele_counts=(3,)), "len(alleles) IN (3)")
_filter_query("filter_sequences_null", SearchRequest(sequences=("chr2", None)), "chrom IN ('chr2') OR chrom IS NULL")
_filter_query(
    "filter_conjunction",
    ChartRequest(sequences=("chr1", "chr2"), start=10_000, end=80_000, displayed_sequence="chr1", range_min=20_000, range_max=90_000, displayed_type="SNP"),
    "chrom IN ('chr1', 'chr2') AND (start_site >= 10000 OR end_site >= 10000) AND start_site <= 80000 AND chrom = 'chr1' AND start_site BETWEEN 20000 AND 90000 AND type = 'SNP'",
)


@query("SELECT variant_id, type, chrom, start_site FROM variants WHERE variant_id IN (SELECT 'v' || l_partkey FROM lineitem WHERE l_quantity > 49)", VARIANTS_SQL)
def filter_ids_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tables.read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("variant_id"))
    return _plain(filters.filter_variants(tables.variants(spark, sf_dir), SearchRequest(), ids))


@query("SELECT variant_id, individual, run_name, gt FROM genotypes WHERE project_id = 1 AND run_name = 'run2'", GENOTYPES_SQL)
def filter_project_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_runs(tables.genotypes(spark, sf_dir), SearchRequest(projects=(1,), runs=((1, "run2"),))).select("variant_id", "individual", "run_name", "gt")


@query("SELECT variant_id FROM variants WHERE type = 'INDEL' AND start_site % 2 = 0", VARIANTS_SQL)
def filter_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    effect = F.when(F.col("type") == "INDEL", "frameshift_variant").otherwise("missense_variant")
    gene = F.when(F.col("start_site") % 2 == 0, "geneA").otherwise("geneB")
    runs = tables.variants(spark, sf_dir).select("variant_id", F.create_map(F.lit("ANN"), F.concat_ws("|", F.lit("G"), effect, F.lit("HIGH"), gene)).alias("info"))
    return filters.filter_annotations(runs, SearchRequest(gene_names=("geneA",), variant_effects=("frameshift_variant",)))


@query("SELECT DISTINCT chrom FROM variants WHERE chrom IS NOT NULL", VARIANTS_SQL)
def distinct_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.variants(spark, sf_dir).where("chrom is not null").select("chrom").distinct().orderBy(natural_key(F.col("chrom")))


@query("SELECT CAST(min(start_site) AS BIGINT) AS range_min, CAST(max(start_site) AS BIGINT) AS range_max FROM variants WHERE chrom = 'chr1'", VARIANTS_SQL)
def default_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.default_range(filters.filter_variants(tables.variants(spark, sf_dir), SearchRequest(sequences=("chr1",))))


@query("SELECT variant_id, chrom, start_site FROM variants", VARIANTS_SQL)
def marker_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.marker_order(tables.variants(spark, sf_dir)).select("variant_id", "chrom", "start_site")


@query("SELECT variant_id, start_site FROM variants WHERE type = 'SNP' ORDER BY start_site DESC NULLS LAST, variant_id LIMIT 50 OFFSET 100", VARIANTS_SQL)
def variant_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = SearchRequest(variant_types=("SNP",), sort_by="start_site", descending=True, page=2, page_size=50)
    return filters.page(filters.filter_variants(tables.variants(spark, sf_dir), request), request).select("variant_id", "start_site")


# Filters on the genotypes of groups

STATS_SQL = """stats AS (
    SELECT variant_id, sum(n) AS n, count(*) AS n_distinct, max(n) AS n_mode, arg_min(gt, (-n, gt)) AS mode, sum(CASE WHEN gt = '0/1' THEN n ELSE 0 END) AS het, sum(CASE WHEN gt = '0/0' THEN n ELSE 0 END) AS ref,
           sum(CASE WHEN gt = '1/1' THEN n ELSE 0 END) AS var, 50.0 * sum(n * CASE WHEN gt < '0/1' THEN 0 WHEN gt = '0/1' THEN 1 ELSE 2 END) / sum(n) AS f
    FROM (SELECT variant_id, gt, count(*) AS n FROM {cells} GROUP BY ALL) GROUP BY variant_id)"""
N_SQL = "(SELECT count(DISTINCT individual) FROM genotypes)"


def _group_query(name: str, group: Group, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.filter_group(tables.genotypes(spark, sf_dir), group, n_individuals(spark, sf_dir))

    run.__name__ = name
    query(f"SELECT variant_id FROM stats WHERE {condition}", GENOTYPES_SQL, COHERENT_SQL, STATS_SQL.format(cells="resolved"))(run)


_group_query("group_filter_maf", Group(maf=(30, 45)), "least(f, 100 - f) BETWEEN 30 AND 45")
_group_query("group_filter_heterozygosity", Group(heterozygosity=(20, 40)), "100.0 * het / n BETWEEN 20 AND 40")
_group_query("group_filter_missing", Group(missing=(0, 25)), f"100.0 * ({N_SQL} - n) / {N_SQL} BETWEEN 0 AND 25")
for _pattern, _condition in zip(
    PATTERNS,
    ("true", "n_distinct > 1", "100.0 * n_mode / n >= 60", "n_distinct = n", "n_distinct < n", "ref = n", "ref > 0", "var = n", "var > 0"),
    strict=True,
):
    _group_query("pattern_" + _pattern.lower().replace(" ", "_"), Group(pattern=_pattern, most_same_ratio=60), _condition)


@query(
    "SELECT variant_id FROM stats WHERE 100.0 * het / n >= 30",
    GENOTYPES_SQL,
    "resolved AS (SELECT variant_id, individual, population, min(gt) AS gt FROM genotypes WHERE gt IS NOT NULL AND dp >= 20 GROUP BY ALL HAVING count(DISTINCT gt) = 1)",
    STATS_SQL.format(cells="resolved"),
)
def group_field_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_group(tables.genotypes(spark, sf_dir), Group(field_thresholds={"dp": 20}, heterozygosity=(30, 100)), n_individuals(spark, sf_dir))


@query(
    "SELECT a.variant_id FROM one a JOIN other b USING (variant_id) WHERE a.mode <> b.mode",
    GENOTYPES_SQL,
    COHERENT_SQL,
    STATS_SQL.replace("stats AS", "one AS").format(cells="(SELECT * FROM resolved WHERE individual IN ('ind0', 'ind1', 'ind2', 'ind3', 'ind4'))"),
    STATS_SQL.replace("stats AS", "other AS").format(cells="(SELECT * FROM resolved WHERE individual IN ('ind5', 'ind6', 'ind7', 'ind8', 'ind9'))"),
)
def discriminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, other = (Group(individuals=tuple(f"ind{k}" for k in ks)) for ks in (range(5), range(5, 10)))
    return filters.discriminate(tables.genotypes(spark, sf_dir), one, other)


@query("SELECT individual FROM people WHERE population IN ('pop0', 'pop1')", GENOTYPES_SQL, PEOPLE_SQL)
def individuals_of_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = tables.individuals(spark, sf_dir)
    return filters.symmetric_difference(people.where("population <> 'pop0'").select("individual"), people.where("population <> 'pop1'").select("individual"))


# Resolution


@query("SELECT * FROM resolved", GENOTYPES_SQL, COHERENT_SQL)
def genotype_coherent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.coherent(tables.genotypes(spark, sf_dir))


@query("SELECT variant_id, individual, population, gt, conflict FROM majority", GENOTYPES_SQL, MAJORITY_SQL)
def genotype_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.majority(tables.genotypes(spark, sf_dir))


@query(
    "SELECT variant_id, individual, population, CASE WHEN len(found) = 1 OR len(list_distinct(list_transform(found, lambda x: x.n))) = 2 THEN found[1].gt END AS gt, len(found) > 1 AS conflict FROM listed",
    GENOTYPES_SQL,
    COUNTED_SQL,
)
def genotype_baypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.by_count_values(tables.genotypes(spark, sf_dir))


# Statistics by window

_CHART = (VARIANTS_SQL, GENOTYPES_SQL, COHERENT_SQL, CHART_SQL, SPINE_SQL)


@query("SELECT bin_start, count(variant_id) AS variants FROM spine LEFT JOIN chart USING (bin_start) GROUP BY bin_start", VARIANTS_SQL, CHART_SQL, SPINE_SQL)
def window_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.density(chart_variants(spark, sf_dir), BINS)


@query(
    "SELECT bin_start, round(least(t, 100 - t), 6) AS maf FROM (SELECT bin_start, avg(CASE WHEN f <= 50 THEN f ELSE 100 - f END) AS t FROM spine LEFT JOIN chart USING (bin_start) LEFT JOIN "
    "(SELECT variant_id, 50.0 * sum(CASE WHEN gt < '0/1' THEN 0 WHEN gt = '0/1' THEN 1 ELSE 2 END) / count(*) AS f FROM resolved GROUP BY 1) USING (variant_id) GROUP BY bin_start)",
    *_CHART,
)
def window_maf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.minor_allele_frequency(chart_variants(spark, sf_dir), resolved(spark, sf_dir), BINS), "maf")


@query(
    f"SELECT bin_start, round(CASE WHEN count(variant_id) > 0 THEN 100.0 * (count(variant_id) * any_value(n) - coalesce(sum(called), 0)) / (count(variant_id) * any_value(n)) END, 6) AS missing FROM spine LEFT JOIN chart USING (bin_start) "
    f"LEFT JOIN (SELECT variant_id, count(*) AS called FROM resolved GROUP BY 1) USING (variant_id), (SELECT {N_SQL} AS n) GROUP BY bin_start",
    *_CHART,
)
def window_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.missing_data(chart_variants(spark, sf_dir), resolved(spark, sf_dir), BINS, n_individuals(spark, sf_dir)), "missing")


@query(
    "SELECT bin_start, round(100 * avg(h), 6) AS heterozygosity FROM spine LEFT JOIN chart USING (bin_start) LEFT JOIN (SELECT variant_id, avg(CASE WHEN gt = '0/1' THEN 1.0 ELSE 0.0 END) AS h FROM resolved GROUP BY 1) USING (variant_id) GROUP BY bin_start",
    *_CHART,
)
def window_heterozygosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.heterozygosity(chart_variants(spark, sf_dir), resolved(spark, sf_dir), BINS), "heterozygosity")


@query(
    "SELECT bin_start, CAST(CASE WHEN count(dp) > 0 THEN floor(sum(dp) / count(dp)) ELSE 0 END AS BIGINT) AS mean FROM spine LEFT JOIN chart USING (bin_start) LEFT JOIN genotypes USING (variant_id) GROUP BY bin_start",
    VARIANTS_SQL, GENOTYPES_SQL, CHART_SQL, SPINE_SQL,
)
def window_field_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.field_mean(chart_variants(spark, sf_dir), tables.genotypes(spark, sf_dir), BINS, "dp")


@query(
    """, pops AS (SELECT variant_id, population, count(*)::DOUBLE AS n, sum(CASE WHEN gt = '0/1' THEN 1 ELSE 0 END)::DOUBLE AS het, sum(CASE gt WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE 0 END)::DOUBLE AS alt FROM resolved GROUP BY ALL),
    tops AS (SELECT variant_id, count(*)::DOUBLE AS r, sum(n) AS t, sum(n * n) AS nn, CASE WHEN sum(alt) > 0 THEN 1 ELSE 0 END AS top FROM pops GROUP BY 1 HAVING count(*) > 1),
    freq AS (SELECT variant_id, r, t, nn, allele, n, CASE allele WHEN 1 THEN alt ELSE 2 * n - alt END / (2 * n) AS p, het / n AS h FROM pops JOIN tops USING (variant_id) CROSS JOIN (VALUES (0), (1)) a(allele) WHERE allele <= top),
    mean AS (SELECT *, sum(n * p) OVER (PARTITION BY variant_id, allele) / t AS pm FROM freq),
    parts AS (SELECT variant_id, allele, r, t, t / r AS nb, t - (nn / t) / (r - 1) AS nc, pm, sum(n * h) / t AS hm, sum(n * (p - pm) * (p - pm)) / (t / r * (r - 1)) AS s2 FROM mean GROUP BY variant_id, allele, r, t, nn, pm),
    abc AS (SELECT variant_id, nb / nc * (s2 - (pm * (1 - pm) - (r - 1) / r * s2 - hm / 4) / (nb - 1)) AS a, nb / (nb - 1) * (pm * (1 - pm) - s2 * (r - 1) / r - hm * (2 * nb - 1) / (4 * nb)) AS b, hm / 2 AS c FROM parts WHERE nb > 1 AND nc <> 0)
    SELECT bin_start, round(CASE WHEN sum(a + b + c) <> 0 THEN sum(a) / sum(a + b + c) END, 6) AS fst FROM spine LEFT JOIN (chart JOIN abc USING (variant_id)) USING (bin_start) GROUP BY bin_start""",
    *_CHART,
)
def window_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.fst(chart_variants(spark, sf_dir), resolved(spark, sf_dir), BINS), "fst")


@query(
    f""", size AS (SELECT 2 * {N_SQL} AS n),
    a AS (SELECT n, (SELECT sum(1.0 / i) FROM range(1, (SELECT n FROM size)) t(i)) AS a1, (SELECT sum(1.0 / (i * i)) FROM range(1, (SELECT n FROM size)) t(i)) AS a2 FROM size),
    e AS (SELECT n, a1, ((n + 1) / (3.0 * (n - 1)) - 1 / a1) / a1 AS e1, (2.0 * (n * n + n + 3) / (9.0 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM a),
    sites AS (SELECT variant_id, sum(CASE gt WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE 0 END) / (2.0 * count(*)) AS p FROM resolved GROUP BY 1),
    sums AS (SELECT bin_start, count(*) AS s, sum(p * (1 - p)) AS k FROM chart JOIN sites USING (variant_id) WHERE p > 0 AND p < 1 GROUP BY 1)
    SELECT bin_start, coalesce(s, 0) AS segregating_sites, round((k * 2 * n / (n - 1) - s / a1) / sqrt(abs(e1 * s + e2 * s * (s - 1))), 6) AS tajima_d FROM spine LEFT JOIN sums USING (bin_start) CROSS JOIN e""",
    *_CHART,
)
def window_tajima_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.tajima_d(chart_variants(spark, sf_dir), resolved(spark, sf_dir), BINS, n_individuals(spark, sf_dir)), "tajima_d")


# Formats


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Individuals with their populations, a bounded dimension: as a table, names in natural order, and by name."""
    people = tables.individuals(spark, sf_dir)
    found = {r["individual"]: r["population"] for r in people.orderBy(natural_key(F.col("individual"))).collect()}
    return people, list(found), found


def _markers(spark: SparkSession, sf_dir: str, individuals: list[str], of: str | None = None) -> DataFrame:
    variants = tables.variants(spark, sf_dir)
    variants = formats.FORMATS[of].accepts(variants) if of else variants
    return formats.marker_table(variants, formats.resolved_rows(tables.genotypes(spark, sf_dir), individuals), individuals)


_CELLS = (VARIANTS_SQL, GENOTYPES_SQL, CELLS_SQL)
_PLACE = "coalesce(chrom, '0') || '{t}' || coalesce(start_site, 0)"


def _marker_lines(of: str | None, sql_line: str, head: str | None = None, where: str = "true") -> Callable[[Callable], Query]:
    """Lines with a row for each marker; sql_line: an aggregate over its cells, head: a scalar SQL expression."""
    sql = f"SELECT {sql_line} AS line FROM cells WHERE {where} GROUP BY variant_id, type, chrom, start_site, end_site, alleles"
    return query(sql + (f" UNION ALL SELECT {head}" if head else ""), *_CELLS)


def _joined(cell: str, separator: str = "'\t'", by: str = "k") -> str:
    return f"string_agg({cell}, {separator} ORDER BY {by})"


_NAMES = f"(SELECT {_joined('individual')} FROM people)"
_SNP_CELL = "CASE WHEN gt IS NULL THEN 'NN' WHEN type = 'SNP' THEN a1 || a2 ELSE a1 || '/' || a2 END"


@_marker_lines(
    "HAPMAP",
    f"variant_id || '\t' || array_to_string(alleles, '/') || '\t' || {_PLACE.format(t=chr(9))} || '\t+\tNA\tNA\tNA\tNA\tNA\tNA\t' || {_joined(_SNP_CELL)}",
    f"'rs#\talleles\tchrom\tpos\tstrand\tassembly#\tcenter\tprotLSID\tassayLSID\tpanelLSID\tQCcode\t' || {_NAMES}",
)
def hapmap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, _ = _people(spark, sf_dir)
    return formats.hapmap(_markers(spark, sf_dir, names, "HAPMAP"), names).select("line")


@_marker_lines("EIGENSTRAT", _joined("CASE gt WHEN '0/0' THEN '2' WHEN '0/1' THEN '1' WHEN '1/1' THEN '0' ELSE '9' END", "''"), where="type = 'SNP'")
def eigenstrat_geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, _ = _people(spark, sf_dir)
    return formats.eigenstrat_genotypes(_markers(spark, sf_dir, names, "EIGENSTRAT")).select("line")


@query("SELECT variant_id || '\t' || coalesce(chrom, '0') || '\t0\t' || coalesce(start_site, 0) AS line FROM variants WHERE type = 'SNP'", VARIANTS_SQL)
def eigenstrat_snp(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = formats.FORMATS["EIGENSTRAT"].accepts(tables.variants(spark, sf_dir)).select("*", F.col("variant_id").alias("name"), F.col("variant_id").alias("ord"))
    return formats.eigenstrat_markers(variants).select("line")


@query("SELECT individual || '\tU\t' || population AS line FROM people", GENOTYPES_SQL, PEOPLE_SQL)
def eigenstrat_ind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.eigenstrat_individuals(_people(spark, sf_dir)[0]).select("line")


@query(
    "SELECT variant_id AS marker, individual, CAST(CASE gt WHEN '0/0' THEN 2 WHEN '0/1' THEN 1 WHEN '1/1' THEN 0 END AS INT) AS dosage FROM cells WHERE type = 'SNP'",
    *_CELLS,
)
def eigenstrat_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, _ = _people(spark, sf_dir)
    markers = _markers(spark, sf_dir, names, "EIGENSTRAT")
    lines = formats.eigenstrat_genotypes(markers).select(F.element_at(F.split("ord", " "), -1).alias("marker"), "line")
    return tables.eigenstrat_genotypes(lines, names)


_BAYPASS = """counts AS (
    SELECT variant_id, chrom, start_site, alleles, population, sum(CASE gt WHEN '0/0' THEN 2 WHEN '0/1' THEN 1 ELSE 0 END) AS n0, sum(CASE gt WHEN '1/1' THEN 2 WHEN '0/1' THEN 1 ELSE 0 END) AS n1
    FROM cells WHERE type = 'SNP' GROUP BY ALL)"""


def _baypass(part: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, names, populations = _people(spark, sf_dir)
        return formats.baypass(_markers(spark, sf_dir, names, "BAYPASS"), populations)[part].select("line")

    return run


for _part, _sql in (
    ("baypass", f"SELECT {_joined(chr(110) + '0 || chr(32) || n1', chr(39) + ' ' + chr(39), 'population')} || ' ' AS line FROM counts GROUP BY variant_id HAVING sum(n0 + n1) > 0"),
    ("snpcode", "SELECT variant_id || ' ' || coalesce(chrom, '0') || ' ' || coalesce(start_site, 0) || ' ' || array_to_string(alleles, ' ') AS line FROM counts GROUP BY variant_id, chrom, start_site, alleles HAVING sum(n0 + n1) > 0 UNION ALL SELECT 'VariantID Chromo Position Allele1 Allele2'"),
    ("popnames", "SELECT DISTINCT population AS line FROM people"),
):
    _run = _baypass(_part)
    _run.__name__ = "baypass_" + _part.replace("baypass", "lines")
    query(_sql, *_CELLS, _BAYPASS)(_run)


@query(
    "SELECT variant_id, CASE WHEN start_site IS NULL THEN '0\t0\t0\t' || variant_id || '\t0\t+' ELSE chrom || '\t' || (start_site - 1) || '\t' || (end_site - 1) || '\t' || variant_id || '\t0\t+' END AS line FROM variants",
    VARIANTS_SQL,
)
def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.bed(tables.variants(spark, sf_dir))


@_marker_lines(
    None,
    "coalesce(chrom, '0') || '\t\t' || CASE type WHEN 'SNP' THEN 'SO:0000694' WHEN 'INDEL' THEN 'SO:1000032' ELSE 'SO:0001059' END || '\t' || coalesce(start_site, 0) || '\t' || coalesce(start_site, 0) || '\t.\t+\t.\tID=' || variant_id || ';alleles=' "
    f"|| array_to_string(alleles, '/') || ';refallele=' || alleles[1] || ';sample_genotypes=' || {_joined("individual || ':' || CASE WHEN gt IS NULL THEN '.' ELSE a1 || '/' || a2 END", chr(39) + ',' + chr(39))}",
    "'##gff-version 3'",
)
def gff3(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, _ = _people(spark, sf_dir)
    return formats.gff3(_markers(spark, sf_dir, names), names).select("line")


SITES_SQL = """sites AS (
    SELECT variant_id, start_site % 400 / 4.0 AS qual, CASE start_site % 3 WHEN 0 THEN '.' WHEN 1 THEN 'PASS' ELSE 'LowQual;q10' END AS filters,
           'AF=' || printf('%.3f', (start_site % 90 + 10) / 100.0) || CASE WHEN start_site % 2 = 0 THEN ';DB' ELSE '' END || CASE WHEN start_site % 5 > 0 THEN ';NS=' || (start_site % 20) ELSE '' END || ';SZ=' || (start_site % 7) || ',.' AS info
    FROM variants WHERE start_site IS NOT NULL)"""


def _vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = tuple((f"chr{k}", 100_000 + k) for k in range(1, 5))
    return exports.export(tables.dataset(spark, sf_dir, sites=tables.sites(spark, sf_dir), contigs=contigs, assembly="as1"), "VCF")["vcf"].select("line")


@query(
    f"SELECT {_PLACE.format(t=chr(9))} || '\t' || variant_id || '\t' || alleles[1] || '\t' || array_to_string(alleles[2:], ',') || '\t' || coalesce(any_value(regexp_replace(printf('%.2f', qual), '\\.00$', '')), '.') || '\t' || coalesce(any_value(filters), '.') "
    f"|| '\t' || coalesce(any_value(info), '.') || '\tGT:DP\t' || {_joined("coalesce(gt, './.') || ':' || coalesce(dp::VARCHAR, '.')")} AS line FROM cells LEFT JOIN sites USING (variant_id) GROUP BY variant_id, type, chrom, start_site, end_site, alleles",
    *_CELLS,
    SITES_SQL,
)
def vcf_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vcf(spark, sf_dir).where("not startswith(line, '#')")


@query(
    f"""SELECT unnest(['##fileformat=VCFv4.1', '##FORMAT=<ID=DP,Number=1,Type=Float,Description="dp">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        '##FILTER=<ID=LowQual,Description="LowQual">', '##FILTER=<ID=q10,Description="q10">', '##INFO=<ID=AF,Number=1,Type=Float,Description="AF">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="DB">',
        '##INFO=<ID=NS,Number=1,Type=Integer,Description="NS">', '##INFO=<ID=SZ,Number=.,Type=Integer,Description="SZ">', '##contig=<ID=chr1,length=100001,assembly=as1>', '##contig=<ID=chr2,length=100002,assembly=as1>',
        '##contig=<ID=chr3,length=100003,assembly=as1>', '##contig=<ID=chr4,length=100004,assembly=as1>', '#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t' || {_NAMES}]) AS line""",
    *_CELLS,
)
def vcf_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vcf(spark, sf_dir).where("startswith(line, '#')")


@query("SELECT variant_id, variant_id || '\t' || array_to_string(alleles, '/') || '\t' || coalesce(chrom, '0') || '\t' || coalesce(start_site, 0) AS line FROM variants", VARIANTS_SQL)
def igv_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.igv_sites(tables.variants(spark, sf_dir))


@_marker_lines(
    None,
    f"variant_id || '\t' || array_to_string(alleles, '/') || '\t' || {_PLACE.format(t=chr(9))} || '\t' || {_joined("coalesce(gt, '')")}",
    f"'variant\talleles\tchrom\tpos\t' || {_NAMES}",
)
def igv_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, _ = _people(spark, sf_dir)
    return formats.hapmap(_markers(spark, sf_dir, names), names, columns=False, indexes=True, separator=True, empty_missing=True).select("line")


def _individual_lines(sql_line: str, *heads: str, where: str = "true") -> Callable[[Callable], Query]:
    return query(f"SELECT {sql_line} AS line FROM cells WHERE {where} GROUP BY individual, population, k" + "".join(f" UNION ALL SELECT {h}" for h in heads), *_CELLS)


def _row(cell: str, separator: str) -> str:
    return _joined(cell, separator, "ord")


_MARKER_NAMES = "(SELECT string_agg(variant_id, chr(9) ORDER BY ord) FROM (SELECT DISTINCT variant_id, ord FROM cells))"


@_individual_lines(f"population || ' ' || individual || ' 0 0 0 U ' || {_row("CASE WHEN gt IS NULL THEN '0 0' ELSE a1 || ' ' || a2 END", "' '")}")
def plink_ped(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, populations = _people(spark, sf_dir)
    return formats.plink_ped(_markers(spark, sf_dir, names, "PLINK"), names, populations).select("line")


@query("SELECT coalesce(chrom, '0') || ' ' || variant_id || ' 0 ' || coalesce(start_site, 0) AS line FROM variants", VARIANTS_SQL)
def plink_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.plink_map(tables.variants(spark, sf_dir).select("*", F.col("variant_id").alias("name"), F.col("variant_id").alias("ord"))).select("line")


@_individual_lines(
    f"individual || '\t' || {_row("CASE WHEN gt IS NULL THEN '-' WHEN a1 = a2 THEN a1 ELSE a1 || '/' || a2 END", "chr(9)")}", "'# fjFile = GENOTYPE'", f"chr(9) || {_MARKER_NAMES}"
)
def flapjack_genotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, _ = _people(spark, sf_dir)
    return formats.flapjack_genotypes(_markers(spark, sf_dir, names), names).select("line")


@query("SELECT variant_id || '\t' || coalesce(chrom, '0') || '\t' || coalesce(start_site, 0) AS line FROM variants UNION ALL SELECT '# fjFile = MAP'", VARIANTS_SQL)
def flapjack_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.flapjack_map(tables.variants(spark, sf_dir).select("*", F.col("variant_id").alias("name"), F.col("variant_id").alias("ord"))).select("line")


@query("SELECT individual || '\t' || population AS line FROM people UNION ALL SELECT '# fjFile = PHENOTYPE' UNION ALL SELECT '\tpopulation'", GENOTYPES_SQL, PEOPLE_SQL)
def flapjack_phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.metadata_lines(_people(spark, sf_dir)[0], "# fjFile = PHENOTYPE").select("line")


@_individual_lines(
    f"(k + 1) || '\t' || {_row("CASE WHEN gt IS NULL THEN '-1' || chr(9) || '-1' ELSE (strpos('AGT', a1) - 1) || chr(9) || (strpos('AGT', a2) - 1) END", "chr(9)")}",
    "'@DARwin 5.0 - ALLELIC - 2'",
    "(SELECT count(*) FROM people) || chr(9) || 2 * (SELECT count(*) FROM variants)",
    "'N°' || chr(9) || (SELECT string_agg(variant_id || chr(9) || variant_id, chr(9) ORDER BY ord) FROM (SELECT DISTINCT variant_id, ord FROM cells))",
)
def darwin_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, _ = _people(spark, sf_dir)
    return formats.darwin_variables(_markers(spark, sf_dir, names), names).select("line")


@query(
    "SELECT (k + 1) || '\t' || individual || '\t' || population AS line FROM people UNION ALL SELECT '@DARwin 5.0 - DON -' UNION ALL SELECT count(*) || chr(9) || 2 FROM people UNION ALL SELECT 'N°\tindividual\tpopulation'",
    GENOTYPES_SQL,
    PEOPLE_SQL,
)
def darwin_don(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, names, _ = _people(spark, sf_dir)
    return formats.darwin_individuals(people, names).select("line")


def _sequence(missing: str) -> str:
    return _row(f"CASE WHEN gt IS NULL THEN '{missing * 2}' ELSE a1 || a2 END", "''")


_SITES = "2 * (SELECT count(*) FROM variants WHERE type = 'SNP')"


@_individual_lines(f"'>' || individual || chr(10) || {_sequence('-')}", where="type = 'SNP'")
def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, _ = _people(spark, sf_dir)
    return formats.fasta(_markers(spark, sf_dir, names, "FASTA"), names).select("line")


@_individual_lines(f"individual || '\t' || {_sequence('?')}", f"(SELECT count(*) FROM people) || ' ' || {_SITES}", where="type = 'SNP'")
def phylip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, _ = _people(spark, sf_dir)
    return formats.phylip(_markers(spark, sf_dir, names, "PHYLIP"), names).select("line")


@_individual_lines(
    f"individual || '\t' || {_sequence('?')}",
    "'#NEXUS' || chr(10) || 'begin data;'",
    f"'dimensions ntax=' || (SELECT count(*) FROM people) || ' nchar=' || {_SITES} || ';'",
    "'format datatype=dna missing=? gap=-;' || chr(10) || 'matrix'",
    "';' || chr(10) || 'end;'",
    where="type = 'SNP'",
)
def nexus(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, _ = _people(spark, sf_dir)
    return formats.nexus(_markers(spark, sf_dir, names, "NEXUS"), names).select("line")


# Matrices


@query(
    "SELECT individual, CAST(floor(100 * (n - count(gt)) / n) AS BIGINT) AS missing, floor(100 * (n - count(gt)) / n) <= 50 AS kept FROM majority, (SELECT count(*) AS n FROM variants) GROUP BY individual, n",
    VARIANTS_SQL, GENOTYPES_SQL, MAJORITY_SQL,
)
def individual_missing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.individual_missing(resolution.majority(tables.genotypes(spark, sf_dir)), tables.variants(spark, sf_dir).count())


@query("SELECT variant_id FROM cells WHERE type = 'SNP' GROUP BY variant_id HAVING 100.0 * count(*) FILTER (gt IS NULL) / count(*) <= 30", *_CELLS)
def variant_missing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, _ = _people(spark, sf_dir)
    return matrix.variant_missing(_markers(spark, sf_dir, names, "PCA"), 30).select("variant_id")


@query("SELECT variant_id, individual, CAST(CASE gt WHEN '0/0' THEN 0 WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 END AS INT) AS dosage FROM majority WHERE gt IS NOT NULL", GENOTYPES_SQL, MAJORITY_SQL)
def dosage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.majority(tables.genotypes(spark, sf_dir)).where("gt is not null").select("variant_id", "individual", alternate_count(F.col("gt")).alias("dosage"))


_PAIRS_SQL = "pairs AS (SELECT a.individual AS a, b.individual AS b, a.gt AS x, b.gt AS y FROM cells a JOIN cells b ON a.variant_id = b.variant_id AND a.k < b.k WHERE a.gt IS NOT NULL AND b.gt IS NOT NULL AND a.type = 'SNP' AND b.type = 'SNP')"
_DOSE = "(CASE {0} WHEN '0/0' THEN 0 WHEN '0/1' THEN 1 ELSE 2 END)"


def _distances(kind: Callable) -> Callable[[SparkSession, str], tuple[DataFrame, list[str]]]:
    def run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
        _, names, _ = _people(spark, sf_dir)
        return kind(_markers(spark, sf_dir, names, "ASD"), names), names

    return run


_shared, _substituted = _distances(matrix.allele_sharing_distance), _distances(matrix.jukes_cantor_distance)


@query(f"SELECT a, b, round(avg(abs({_DOSE.format('x')} - {_DOSE.format('y')})), 6) AS distance FROM pairs GROUP BY a, b", *_CELLS, _PAIRS_SQL)
def asd_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_shared(spark, sf_dir)[0].select("a", "b", "distance"), "distance")


@query(
    "SELECT a, b, round(CASE WHEN p >= 0.75 THEN 5.0 WHEN p = 0 THEN 0.0 ELSE -0.75 * ln(1 - 4 * p / 3) END, 6) AS distance FROM (SELECT a, b, sum(CASE WHEN split_part(x, '/', 1) <> split_part(y, '/', 1) THEN 1 ELSE 0 END + CASE WHEN split_part(x, '/', 2) <> split_part(y, '/', 2) THEN 1 ELSE 0 END) / (2.0 * count(*)) AS p FROM pairs GROUP BY a, b)",
    *_CELLS,
    _PAIRS_SQL,
)
def jukes_cantor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_substituted(spark, sf_dir)[0].select("a", "b", "distance"), "distance")


_TEXT_SQL = f"""apart AS (SELECT a, b, avg(abs({_DOSE.format('x')} - {_DOSE.format('y')})) AS d FROM pairs GROUP BY a, b),
    square AS (SELECT a, b, d FROM apart UNION ALL SELECT b, a, d FROM apart UNION ALL SELECT individual, individual, 0 FROM people)"""


@query(
    "SELECT chr(9) || count(*) AS line FROM people UNION ALL SELECT s.a || ' ' || string_agg(printf('%.6f', coalesce(s.d, 0)), ' ' ORDER BY p.k) FROM square s JOIN people p ON p.individual = s.b GROUP BY s.a",
    *_CELLS,
    _PAIRS_SQL,
    _TEXT_SQL,
)
def asd_matrix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.matrix_text(*_shared(spark, sf_dir)).select("line")


@query()
def nj_newick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.tree_of(*_shared(spark, sf_dir))


_Z_SQL = """dose AS (SELECT variant_id, k, CASE gt WHEN '0/0' THEN 0.0 WHEN '0/1' THEN 1.0 WHEN '1/1' THEN 2.0 END AS g FROM cells WHERE type = 'SNP'),
    filled AS (SELECT variant_id, k, coalesce(g, avg(g) OVER (PARTITION BY variant_id), 0) AS g FROM dose),
    z AS (SELECT variant_id, k, CASE WHEN stddev_samp(g) OVER (PARTITION BY variant_id) > 1e-12 THEN (g - avg(g) OVER (PARTITION BY variant_id)) / stddev_samp(g) OVER (PARTITION BY variant_id) ELSE 0 END AS z FROM filled)"""


def _standardized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    _, names, _ = _people(spark, sf_dir)
    return matrix.standardized(_markers(spark, sf_dir, names, "PCA")), names


@query("SELECT variant_id, CAST(k AS INT) AS k, round(z, 6) + 0.0 AS z FROM z", *_CELLS, _Z_SQL)
def pca_standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standardized(spark, sf_dir)[0].select("variant_id", F.posexplode("z").alias("k", "z")).withColumn("z", F.round("z", 6) + F.lit(0.0))


@query("SELECT CAST(a.k AS INT) AS i, CAST(b.k AS INT) AS j, round(sum(a.z * b.z), 4) AS product FROM z a JOIN z b ON a.variant_id = b.variant_id AND a.k <= b.k GROUP BY a.k, b.k", *_CELLS, _Z_SQL)
def pca_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, names = _standardized(spark, sf_dir)
    return matrix.gram(z, len(names)).withColumn("product", F.round("product", 4))


@query()
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.principal_components(*_standardized(spark, sf_dir))[1]


@query()
def pca_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, names = _standardized(spark, sf_dir)
    return matrix.pca_lines(*matrix.principal_components(z, names)).select("line")


@query()
def pca_thin_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading components without a matrix of individuals by individuals."""
    return matrix.thin_components(*_standardized(spark, sf_dir), components=5)[1]


# Exports by name: the files beside the lines above

#: Genotypes of which five individuals lack over half.
SPARSE_SQL = GENOTYPES_SQL.replace("genotypes AS (", "every_genotype AS (", 1) + ", genotypes AS (SELECT * FROM every_genotype WHERE CAST(individual[4:] AS INT) < 15 OR CAST(variant_id[2:] AS INT) % 2 = 0)"


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c, at: F.substring(c, at, 20).cast("int")
    return tables.genotypes(spark, sf_dir).where((number("individual", 4) < 15) | (number("variant_id", 2) % 2 == 0))


_DIGIT = "CASE gt WHEN '0/0' THEN 2 WHEN '0/1' THEN 1 ELSE 0 END"
_REMARK = "'- Dissimilar genotypes found for variant ' || variant_id || ', individual ' || individual || '. ' || CASE WHEN gt IS NULL THEN 'Exporting as missing data' ELSE {best} END"


def _remarks(format: str, best: str, where: str = "true", sparse: bool = False, more: str = "", cells: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = tables.dataset(spark, sf_dir, **({"genotypes": _sparse(spark, sf_dir)} if sparse else {}))
        return exports.export(data, format)["REMARKS"].select("line")

    run.__name__ = f"remarks_{format.lower().replace('-', '_')}"
    query(f"SELECT {_REMARK.format(best=best)} AS line FROM cells WHERE conflict AND {where}{more}", *(cells or (VARIANTS_SQL, SPARSE_SQL if sparse else GENOTYPES_SQL, CELLS_SQL)))(run)


_LEFT_OUT = " UNION ALL SELECT '- Excluding individual ' || individual || ' from {0} export, it has too much missing data: ' || m || '%' FROM (SELECT individual, CAST(floor(100.0 * count(*) FILTER (gt IS NULL) / count(*)) AS INT) AS m FROM cells WHERE type = 'SNP' GROUP BY individual) WHERE m > 50"
_BEST = "'Exporting most frequent: ' || "
_remarks("HAPMAP", _BEST + "CASE WHEN type = 'SNP' THEN a1 || a2 ELSE a1 || '/' || a2 END")
_remarks("GFF3", _BEST + "a1 || '/' || a2")
_remarks("EIGENSTRAT", _BEST + _DIGIT, "type = 'SNP'")
_remarks("ASD", _BEST + _DIGIT, "type = 'SNP'", True, _LEFT_OUT.format("ASD"))
_remarks("JUKES-CANTOR", _BEST + "a1 || a2", "type = 'SNP'", True, _LEFT_OUT.format("NJ"))
_remarks(
    "PCA", _BEST + _DIGIT, "type = 'SNP'", True,
    " UNION ALL SELECT '- Excluding variant ' || variant_id || ' from PCA export, it has too much missing data: ' || CAST(floor(m) AS INT) || '%' FROM (SELECT variant_id, 100.0 * count(*) FILTER (gt IS NULL) / count(*) AS m FROM cells WHERE type = 'SNP' GROUP BY 1) WHERE m > 50",
)
_remarks(
    "BAYPASS", "'Exporting most frequent'", cells=(
        VARIANTS_SQL, GENOTYPES_SQL, COUNTED_SQL,
        "cells AS (SELECT variant_id, individual, CASE WHEN len(found) = 1 OR len(list_distinct(list_transform(found, lambda x: x.n))) = 2 THEN found[1].gt END AS gt, len(found) > 1 AS conflict FROM listed JOIN variants USING (variant_id) WHERE type = 'SNP')",
    ),
)

_KEPT_SQL = """kept AS (SELECT individual, row_number() OVER (ORDER BY k) - 1 AS k FROM (SELECT individual, any_value(k) AS k FROM cells WHERE type = 'SNP' GROUP BY individual HAVING floor(100.0 * count(*) FILTER (gt IS NULL) / count(*)) <= 50))"""


@query(
    "SELECT chr(9) || count(*) AS line FROM kept UNION ALL SELECT s.a || ' ' || string_agg(printf('%.6f', coalesce(s.d, 0)), ' ' ORDER BY p.k) FROM square s JOIN kept p ON p.individual = s.b JOIN kept q ON q.individual = s.a GROUP BY s.a",
    VARIANTS_SQL, SPARSE_SQL, CELLS_SQL, _PAIRS_SQL, _TEXT_SQL, _KEPT_SQL,
)
def export_asd_mtx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the individuals that lack over half of the genotypes."""
    return exports.export(tables.dataset(spark, sf_dir, genotypes=_sparse(spark, sf_dir)), "ASD")["mtx"].select("line")


SYNONYMS_SQL = "named AS (SELECT *, CASE WHEN CAST(variant_id[2:] AS INT) % 3 = 0 THEN 'rs' || variant_id[2:] ELSE variant_id END AS name FROM variants)"


@query("SELECT coalesce(chrom, '0') || ' ' || name || ' 0 ' || coalesce(start_site, 0) AS line FROM named WHERE type = 'SNP'", VARIANTS_SQL, SYNONYMS_SQL)
def export_fasta_map_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.export(tables.dataset(spark, sf_dir, synonyms=tables.synonyms(spark, sf_dir)), "FASTA")["map"].select("line")


@_individual_lines(f"population || ' ' || individual || ' 0 0 0 U ' || {_row("CASE WHEN gt IS NULL THEN '0 0' ELSE a1 || ' ' || a2 END", "' '")}", where="chrom IN ('chr1', 'chr2')")
def export_ped_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the lines, joined here to be compared."""
    pieces = exports.export(tables.dataset(spark, sf_dir), "PLINK", SearchRequest(sequences=("chr1", "chr2")))["ped"]
    return pieces.groupBy("ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("line")).select("line")


@query(
    "SELECT coalesce(chrom, '0') || chr(9) || greatest(coalesce(start_site, 0) - 1, 0) || chr(9) || (CASE WHEN start_site IS NULL THEN 0 ELSE start_site - 1 + length(alleles[1]) - 1 END) || chr(9) || variant_id || chr(9) || '0' || chr(9) || '+' AS line FROM variants",
    VARIANTS_SQL,
)
def bed_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.export(tables.dataset(spark, sf_dir, variant_runs=tables.annotations(spark, sf_dir)), "BED")["bed"].select("line")


@query(
    "SELECT variant_id || chr(9) || chrom || ':' || start_site || chr(9) || CASE WHEN start_site % 2 = 0 THEN 'geneA' ELSE 'geneB' END || chr(9) || CASE WHEN type = 'INDEL' THEN 'frameshift_variant' ELSE 'missense_variant' END || chr(9) AS line "
    "FROM variants WHERE chrom IS NOT NULL UNION ALL SELECT '#Uploaded_variation' || chr(9) || 'Location' || chr(9) || 'Gene' || chr(9) || 'Consequence' || chr(9) || 'Feature'",
    VARIANTS_SQL,
)
def export_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.export(tables.dataset(spark, sf_dir, variant_runs=tables.annotations(spark, sf_dir)), "BED")["ann"].select("line")


# Requests carried out: groups, samples

_TWO = (Group("north", tuple(f"ind{k}" for k in range(6))), Group("south", tuple(f"ind{k}" for k in range(4, 10))))
_GROUPED = ChartRequest(groups=_TWO, sequences=("chr1", "chr2"), displayed_sequence="chr1", range_min=1, range_max=100_000, intervals=20)
_IN_TWO = "genotypes AS (SELECT * FROM every_genotype WHERE CAST(individual[4:] AS INT) < 10)"
_TWO_SQL = (VARIANTS_SQL, GENOTYPES_SQL.replace("genotypes AS (", "every_genotype AS (", 1), _IN_TWO, COHERENT_SQL, CHART_SQL, SPINE_SQL)
_SAMPLES = (VARIANTS_SQL, GENOTYPES_SQL.replace("genotypes AS (", "every_genotype AS (", 1), "genotypes AS (SELECT * REPLACE (individual || '_' || run_name AS individual) FROM every_genotype)", COHERENT_SQL, CHART_SQL, SPINE_SQL)


def _chart(name: str, statistic: str, of: str, parts: tuple[str, ...], request: ChartRequest, samples: bool = False) -> None:
    """A chart whose SQL is that of the plain query `of` over other genotypes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = execution.chart(tables.dataset(spark, sf_dir), request, statistic, samples)
        return rounded(found, *[c for c, kind in found.dtypes if kind == "double"])

    run.__name__ = name
    query(ORACLE_SQL[of].removeprefix(f"WITH {', '.join(_CHART)}"), *parts)(run)


for _statistic, _of in (("maf", "window_maf"), ("missing", "window_missing"), ("heterozygosity", "window_heterozygosity"), ("tajima_d", "window_tajima_d")):
    _chart(f"chart_groups_{_statistic}", _statistic, _of, _TWO_SQL, _GROUPED)
    _chart(f"chart_samples_{_statistic}", _statistic, _of, _SAMPLES, CHART, True)
_BY_GROUP = """resolved AS (SELECT variant_id, individual, g.name AS population, gt FROM agreed JOIN (VALUES ('north', 0, 5), ('south', 4, 9)) g(name, a, b) ON CAST(individual[4:] AS INT) BETWEEN g.a AND g.b)"""
_chart("chart_groups_fst", "fst", "window_fst", (*_TWO_SQL[:3], COHERENT_SQL.replace("resolved AS (", "agreed AS (", 1), _BY_GROUP, CHART_SQL, SPINE_SQL), _GROUPED)


@query(
    "SELECT bin_start, CAST(CASE WHEN count(dp) > 0 THEN floor(sum(dp) / count(dp)) ELSE 0 END AS BIGINT) AS mean FROM spine LEFT JOIN (SELECT variant_id, CAST(1 + least(floor((start_site - 1) / 5000), 19) * 5000 AS BIGINT) AS bin_start FROM variants "
    "WHERE chrom = 'chr1' AND start_site BETWEEN 1 AND 100000) USING (bin_start) LEFT JOIN genotypes USING (variant_id) GROUP BY bin_start",
    VARIANTS_SQL, *_TWO_SQL[1:3], SPINE_SQL,
)
def chart_groups_field_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = FieldPlotRequest(groups=_TWO, displayed_sequence="chr1", range_min=1, range_max=100_000, intervals=20, vcf_field="dp")
    return execution.chart(tables.dataset(spark, sf_dir), request, "field_mean")


_FIVE_EACH = tuple(tuple(f"ind{k}" for k in ks) for ks in (range(5), range(5, 10)))


@query(
    "SELECT variant_id, type, chrom, start_site FROM variants JOIN one a USING (variant_id) JOIN other b USING (variant_id) WHERE type = 'SNP' AND chrom = 'chr2' AND least(a.f, 100 - a.f) BETWEEN 10 AND 50 AND b.n_distinct > 1 AND a.mode <> b.mode",
    VARIANTS_SQL,
    GENOTYPES_SQL,
    COHERENT_SQL,
    STATS_SQL.replace("stats AS", "one AS").format(cells="(SELECT * FROM resolved WHERE individual IN ('ind0', 'ind1', 'ind2', 'ind3', 'ind4'))"),
    STATS_SQL.replace("stats AS", "other AS").format(cells="(SELECT * FROM resolved WHERE individual IN ('ind5', 'ind6', 'ind7', 'ind8', 'ind9'))"),
)
def search_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = (Group("a", _FIVE_EACH[0], maf=(10, 50)), Group("b", _FIVE_EACH[1], pattern="Not all the same", discriminate=0))
    return _plain(execution.selected_variants(tables.dataset(spark, sf_dir), SearchRequest(variant_types=("SNP",), sequences=("chr2",), groups=groups)))


@query(
    "SELECT variant_id, start_site, total, callset_id, individual, gt FROM (SELECT variant_id, start_site, count(*) OVER () AS total FROM variants WHERE type = 'SNP' AND chrom = 'chr2' ORDER BY start_site DESC, variant_id LIMIT 20 OFFSET 20) "
    "JOIN genotypes USING (variant_id) WHERE CAST(individual[4:] AS INT) < 5",
    VARIANTS_SQL,
    GENOTYPES_SQL,
)
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a search with its groups' genotypes, beside how many variants there are."""
    request = SearchRequest(variant_types=("SNP",), sequences=("chr2",), groups=(Group("a", _FIVE_EACH[0]),), sort_by="start_site", descending=True, page=1, page_size=20)
    found = search.search(tables.dataset(spark, sf_dir), request)
    cells = found.page.select("variant_id", "start_site", F.explode("genotypes").alias("g"))
    return cells.select("variant_id", "start_site", F.lit(found.count).cast("long").alias("total"), "g.callset_id", "g.individual", "g.gt")


# Files: written in parts by tasks, and read back in splits


@query(ORACLE_SQL["eigenstrat_reader"])
def eigenstrat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of an export, whose genotype lines meet their markers by line number."""
    files = exports.export(tables.dataset(spark, sf_dir), "EIGENSTRAT")
    places = sinks.write_export_parts({k: files[k] for k in ("eigenstratgeno", "snp", "ind")}, shared_place(spark, "eigenstrat"), "x")
    return eigenstrat.read_eigenstrat(spark, places["eigenstratgeno"], places["snp"], places["ind"]).select("marker", "individual", "dosage")


@query(ORACLE_SQL["vcf_records"])
def vcf_gz_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block-gzipped file, read in splits of a few blocks."""
    contigs = tuple((f"chr{k}", 100_000 + k) for k in range(1, 5))
    files = exports.export(tables.dataset(spark, sf_dir, sites=tables.sites(spark, sf_dir), contigs=contigs, assembly="as1"), "VCF.gz")
    places = sinks.write_export_parts({"vcf.gz": files["vcf.gz"]}, shared_place(spark, "vcf"), "x")
    return sinks.read_lines(spark, places["vcf.gz"], 4).where("not startswith(line, '#')")


# Packed genotypes: the same statistics without a shuffle of genotypes


def _packed(name: str, of: str, statistic: str, request: ChartRequest, parts: tuple[str, ...] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = execution.chart(execution.packed_dataset(tables.dataset(spark, sf_dir)), request, statistic)
        return rounded(found, *[c for c, kind in found.dtypes if kind == "double"])

    run.__name__ = name
    query(*((ORACLE_SQL[of],) if parts is None else (ORACLE_SQL[of].removeprefix(f"WITH {', '.join(_CHART)}"), *parts)))(run)


for _statistic in ("maf", "missing", "heterozygosity", "tajima_d", "fst"):
    _packed(f"packed_{_statistic}", f"window_{_statistic}", _statistic, CHART)
_packed("packed_groups_maf", "window_maf", "maf", _GROUPED, _TWO_SQL)


@query(ORACLE_SQL["search_groups"])
def packed_search_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = (Group("a", _FIVE_EACH[0], maf=(10, 50)), Group("b", _FIVE_EACH[1], pattern="Not all the same", discriminate=0))
    request = SearchRequest(variant_types=("SNP",), sequences=("chr2",), groups=groups)
    return _plain(execution.selected_variants(execution.packed_dataset(tables.dataset(spark, sf_dir)), request))


@query("SELECT variant_id, run_name, individual, gt FROM genotypes WHERE gt IS NOT NULL", GENOTYPES_SQL)
def packed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every called genotype, back from its vector."""
    return vectors.unpacked(execution.packed_dataset(tables.dataset(spark, sf_dir)).packed).select("variant_id", "run_name", "individual", "gt")


# Kept searches: written once, charted by their token


def _kept(spark: SparkSession, sf_dir: str) -> tuple[Dataset, str]:
    """A dataset in buckets, and the token of a search of it; both go when Python ends."""
    token = f"q{uuid.uuid4().hex}"
    data = selections.keep_dataset(tables.dataset(spark, sf_dir), token)
    groups = (Group("a", _FIVE_EACH[0], maf=(10, 50)), Group("b", _FIVE_EACH[1], pattern="Not all the same"))
    selections.keep_search(data, SearchRequest(variant_types=("SNP",), groups=groups), token)

    def drop() -> None:
        if running(spark):
            selections.forget(spark, token)
            selections.forget_dataset(spark, token)

    atexit.register(drop)
    return data, token


_KEPT_PARTS = (
    VARIANTS_SQL,
    GENOTYPES_SQL,
    COHERENT_SQL,
    STATS_SQL.replace("stats AS", "one AS").format(cells="(SELECT * FROM resolved WHERE individual IN ('ind0', 'ind1', 'ind2', 'ind3', 'ind4'))"),
    STATS_SQL.replace("stats AS", "other AS").format(cells="(SELECT * FROM resolved WHERE individual IN ('ind5', 'ind6', 'ind7', 'ind8', 'ind9'))"),
    "kept AS (SELECT v.* FROM variants v JOIN one a USING (variant_id) JOIN other b USING (variant_id) WHERE type = 'SNP' AND least(a.f, 100 - a.f) BETWEEN 10 AND 50 AND b.n_distinct > 1)",
)


@query("SELECT variant_id, type, chrom, start_site FROM kept", *_KEPT_PARTS)
def kept_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(selections.kept_search(spark, _kept(spark, sf_dir)[1]))


@query(ORACLE_SQL["window_heterozygosity"].removeprefix(f"WITH {', '.join(_CHART)}"), *_KEPT_PARTS, CHART_SQL.replace("FROM variants", "FROM kept"), SPINE_SQL)
def kept_heterozygosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selections.chart_of_kept(*_kept(spark, sf_dir), CHART, "heterozygosity"), "heterozygosity")


@query(
    "SELECT coalesce(chrom, '0') || ' ' || variant_id || ' 0 ' || coalesce(start_site, 0) AS line FROM kept WHERE type IN ('SNP', 'MNP', 'INDEL', 'MIXED', 'NO_VARIATION')",
    *_KEPT_PARTS,
)
def kept_plink_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of an export that takes its variants from a kept search."""
    data, token = _kept(spark, sf_dir)
    return exports.export(data, "PLINK", selected=selections.kept_search(spark, token))["map"].select("line")


# Other ploidies, phased genotypes and third alleles


def _ploidy_sql(ploidy: int) -> str:
    joined = lambda separator: f"array_to_string([CAST((h + c * c * (ind % 3 + 1)) % n AS VARCHAR) FOR c IN range({ploidy})], '{separator}')"
    gt = f"CASE WHEN (pk + ind) % 2 = 0 THEN {joined('|')} ELSE {joined('/')} END" if ploidy == 2 else joined("/")
    return f"""genotypes AS (
    SELECT 'v' || pk AS variant_id, 1 AS project_id, 'run' || run AS run_name, CAST(ind * 2 + run AS INT) AS callset_id, 'ind' || ind AS individual, 'pop' || (ind % 3) AS population,
           CASE WHEN s % 11 = 0 THEN NULL ELSE {gt} END AS gt, CAST(dp AS INT) AS dp
    FROM (SELECT r.*, pk * 37 + ind * (11 + pk % 5) + (pk % 7) * (ind % 3) * 3 + CASE WHEN s % 13 = 0 THEN 5 ELSE 0 END AS h, CASE WHEN p_type = 'PROMO' THEN 3 ELSE 2 END AS n
          FROM (SELECT l_partkey AS pk, l_suppkey % 20 AS ind, l_linenumber % 2 + 1 AS run, SUM(l_linenumber) AS s, SUM(CAST(l_quantity AS INT)) AS dp FROM lineitem GROUP BY ALL) r JOIN part ON p_partkey = pk))"""


def _of_ploidy(spark: SparkSession, sf_dir: str, ploidy: int) -> Dataset:
    return tables.dataset(spark, sf_dir, genotypes=tables.of_ploidy(spark, sf_dir, ploidy), ploidies={1: ploidy})


#: Each genotype's alleles by name.
_NAMED = "(CASE WHEN gt IS NOT NULL THEN list_transform(string_split_regex(gt, '[/|]'), lambda x: alleles[CAST(x AS INT) + 1]) END)"


def _poly_chart(ploidy: int, statistic: str, resolved_sql: str = COHERENT_SQL, edit: Callable[[str], str] = lambda sql: sql, packed: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = _of_ploidy(spark, sf_dir, ploidy)
        found = execution.chart(execution.packed_dataset(data) if packed else data, CHART, statistic)
        return rounded(found, *[c for c, kind in found.dtypes if kind == "double"])

    run.__name__ = f"ploidy{ploidy}_{statistic}" + "_packed" * packed
    query(edit(ORACLE_SQL[f"window_{statistic}"].removeprefix(f"WITH {', '.join(_CHART)}")), VARIANTS_SQL, _ploidy_sql(ploidy), resolved_sql, CHART_SQL, SPINE_SQL)(run)


#: Diploid codes whatever their phase and order, for statistics to which these are alike.
_UNPHASED = COHERENT_SQL.replace("min(gt) AS gt", "CASE WHEN min(gt) IN ('0/0', '0|0') THEN '0/0' WHEN min(gt) IN ('1/1', '1|1') THEN '1/1' ELSE '0/1' END AS gt")
for _packed_too in (False, True):
    _poly_chart(1, "maf", edit=lambda sql: sql.replace("'0/1'", "'1'"), packed=_packed_too)
    _poly_chart(2, "maf", packed=_packed_too)
    _poly_chart(2, "fst", _UNPHASED, packed=_packed_too)
    _poly_chart(2, "tajima_d", _UNPHASED, packed=_packed_too)
    _poly_chart(4, "maf", packed=_packed_too)


def _poly_lines(ploidy: int, format: str, kind: str, sql: str, *heads: str, by_marker: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = exports.export(_of_ploidy(spark, sf_dir, ploidy), format)[kind]
        if by_marker:
            return found.select("line")
        return found.groupBy("ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("line")).select("line")

    run.__name__ = f"ploidy{ploidy}_{format.lower()}"
    group = "variant_id, type, chrom, start_site, end_site, alleles" if by_marker else "individual, population, k"
    types = f"type IN ({', '.join(map(repr, formats.FORMATS[format].variant_types))})" if formats.FORMATS[format].variant_types else "true"
    query(f"SELECT {sql} AS line FROM cells WHERE {types} GROUP BY {group}" + "".join(f" UNION ALL SELECT {h}" for h in heads), VARIANTS_SQL, _ploidy_sql(ploidy), CELLS_SQL)(run)


for _n in (1, 2, 4):
    _poly_lines(
        _n, "FLAPJACK", "genotype", f"individual || '\t' || {_row(f"CASE WHEN gt IS NULL THEN '-' WHEN len(list_distinct({_NAMED})) = 1 THEN {_NAMED}[1] ELSE array_to_string({_NAMED}, '/') END", 'chr(9)')}",
        "'# fjFile = GENOTYPE'", f"chr(9) || {_MARKER_NAMES}",
    )
    _poly_lines(
        _n, "DARwin", "var", f"(k + 1) || '\t' || {_row(f"CASE WHEN gt IS NULL THEN array_to_string(list_transform(range({_n}), lambda x: '-1'), chr(9)) ELSE array_to_string(list_transform({_NAMED}, lambda a: CAST(strpos('AGT', a) - 1 AS VARCHAR)), chr(9)) END", 'chr(9)')}",
        f"'@DARwin 5.0 - ALLELIC - {_n}'", f"(SELECT count(*) FROM people) || chr(9) || {_n} * (SELECT count(*) FROM variants)",
        f"'N°' || chr(9) || (SELECT string_agg(array_to_string(list_transform(range({_n}), lambda x: variant_id), chr(9)), chr(9) ORDER BY ord) FROM (SELECT DISTINCT variant_id, ord FROM cells))",
    )
    _poly_lines(
        _n, "HAPMAP", "hapmap", f"variant_id || '\t' || array_to_string(alleles, '/') || '\t' || {_PLACE.format(t=chr(9))} || '\t+\tNA\tNA\tNA\tNA\tNA\tNA\t' || {_joined(f"CASE WHEN gt IS NULL THEN 'NN' WHEN type = 'SNP' THEN array_to_string({_NAMED}, '') ELSE array_to_string({_NAMED}, '/') END")}",
        "'rs#\talleles\tchrom\tpos\tstrand\tassembly#\tcenter\tprotLSID\tassayLSID\tpanelLSID\tQCcode\t' || " + _NAMES, by_marker=True,
    )
