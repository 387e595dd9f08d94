"""Ordered parts, block-gzipped parts, Eigenstrat files, and processes that are stopped."""

from __future__ import annotations

import gzip
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F
from test_selections import made

from allelix.operators import exports
from allelix.plans import progress
from allelix.plans.requests import ChartRequest, SearchRequest
from allelix.sources import archive, eigenstrat, sinks


def whole(path):
    return b"".join(sinks.stream(path))


@pytest.fixture(scope="module")
def data(spark):
    return made(spark, n_variants=12, n_people=9, codes=("0/0", "0/1", "1/1", None))[0]


@pytest.mark.parametrize("format", ["PLINK", "FLAPJACK", "DARwin", "FASTA", "PHYLIP", "NEXUS", "HAPMAP", "VCF.gz"])
def test_parts_are_the_lines_of_an_archive(spark, data, tmp_path, format):
    files = exports.export(data, format)
    places = sinks.write_export_parts(files, str(tmp_path), "x")
    assert set(places) | {"REMARKS"} == set(files)
    for kind, path in places.items():
        text = whole(path)
        assert (gzip.decompress(text) if kind.endswith(".gz") else text) == b"".join(archive.lines_of(files[kind])), kind


def test_failed_attempts_and_missing_commits_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.range(0, 2000, 1, 7).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("ord"), F.col("id").cast("string").alias("line"))
    sinks.write_parts(rows, path)
    assert whole(path) == b"".join(b"%d\n" % k for k in range(2000))
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="isn't empty"):
        sinks.write_parts(rows, path)
    assert sorted(os.listdir(path)) == before
    bad = rows.withColumn("line", F.when(F.col("line") == "1999", F.raise_error(F.lit("no"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no"):
        sinks.write_parts(bad, path, overwrite=True)
    try:
        assert whole(path) == b"".join(b"%d\n" % k for k in range(2000))  # it failed before anything was written
    except FileNotFoundError:
        pass  # what its tasks left is in no list
    with pytest.raises(FileNotFoundError):
        sinks.parts_of(str(tmp_path / "b"))
    (tmp_path / "a" / "part-000001-lost").write_bytes(b"of a lost attempt")
    sinks.write_parts(rows.limit(0), path, overwrite=True)
    assert whole(path) == b"" and not [f for f in os.listdir(path) if f.startswith("part-")]


@pytest.mark.parametrize("a_split", [1, 2, 1000])
def test_any_split_of_gzipped_parts_has_its_lines(spark, tmp_path, a_split):
    choose = random.Random(2)
    lines = ["", "short", "é" * 40_000, *("".join(choose.choices("abcdef", k=choose.choice([0, 5, 300, 90_000, 200_000]))) for _ in range(60)), ""]
    df = spark.createDataFrame([(f"{k:04d}", line) for k, line in enumerate(lines)], "ord string, line string").repartition(5)
    path = str(tmp_path / "z")
    sinks.write_parts(df, path, gzipped=True)
    text = whole(path)
    assert gzip.decompress(text) == "".join(f"{line}\n" for line in lines).encode()
    assert len(sinks.blocks_of(path)) > len(sinks.parts_of(path)["parts"]) > 1
    assert sorted(r.line for r in sinks.read_lines(spark, path, a_split).collect()) == sorted(lines)


def eigenstrat_files(tmp_path, lines, markers=None, people="abc"):
    made_ = {"geno": lines, "snp": [f"m{k} chr1 0 {10 * k} A G" for k in range(len(lines) if markers is None else markers)], "ind": [f"{p} U pop" for p in people]}
    for kind, text in made_.items():
        (tmp_path / f"x.{kind}").write_text("\n".join(text) + "\n")
    return [str(tmp_path / f"x.{k}") for k in ("geno", "snp", "ind")]


def test_eigenstrat_files_over_splits(spark, tmp_path):
    choose = random.Random(1)
    lines = ["".join(choose.choices("0129", k=3)) for _ in range(5000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {(r.marker, r.individual): (r.dosage, r.position) for r in eigenstrat.read_eigenstrat(spark, *eigenstrat_files(tmp_path, lines)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(f"m{k}", p): (None if line[i] == "9" else int(line[i]), 10 * k) for k, line in enumerate(lines) for i, p in enumerate("abc")}


@pytest.mark.parametrize(("lines", "markers", "what"), [(["012"] * 4, 5, "too few"), (["012"] * 4, 3, "too many"), (["012", "01"], 2, "right length"), (["012", "0x1"], 2, "right length")])
def test_wrong_eigenstrat_files(spark, tmp_path, lines, markers, what):
    with pytest.raises(Exception, match=what):
        eigenstrat.read_eigenstrat(spark, *eigenstrat_files(tmp_path, lines, markers)).collect()


def test_processes_tell_their_steps(spark, data, tmp_path):
    process = progress.Process(spark)
    assert process.state() == "waiting"
    places = progress.run_export(process, data, "VCF.gz", SearchRequest(), str(tmp_path))
    assert process.state() == "done" and process.share() == 1
    assert process.steps == ["Finding variants", "Preparing files", "Writing vcf.gz", "Writing REMARKS"]
    assert gzip.decompress(whole(places["vcf.gz"])).startswith(b"##fileformat=VCFv4.1")
    rows = progress.run_chart(progress.Process(spark), data, ChartRequest(intervals=3), "maf")
    assert len(rows) == 3
    failing = progress.Process(spark)
    with pytest.raises(ValueError, match="takes ploidy"):
        progress.run_export(failing, data.__class__(**{**data.__dict__, "ploidies": {1: 4}}), "PLINK", SearchRequest(), str(tmp_path / "f"))
    assert failing.state().startswith("failed: Preparing files: ValueError")


def test_a_running_export_is_stopped_from_another_thread(spark, data, tmp_path):
    slow = data.genotypes.withColumn("gt", F.udf(lambda g: (time.sleep(0.2), g)[1])("gt"))
    process, caught = progress.Process(spark), []

    def run():
        try:
            progress.run_export(process, data.__class__(**{**data.__dict__, "genotypes": slow}), "HAPMAP", SearchRequest(), str(tmp_path / "s"))
        except Exception as error:
            caught.append(error)

    thread = threading.Thread(target=run)
    began = time.time()
    thread.start()
    while process.state() != "step 3 of 4: Writing hapmap":
        assert thread.is_alive() and time.time() - began < 60
        time.sleep(0.05)
    time.sleep(1)
    process.abort()
    thread.join(30)
    assert not thread.is_alive() and isinstance(caught[0], progress.Aborted) and process.state() == "aborted"
    assert not (tmp_path / "s").exists() or not os.listdir(tmp_path / "s")
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [f for f in os.listdir(root) if process.token in f]
    with pytest.raises(progress.Aborted):
        with process.step("more"):
            pass
