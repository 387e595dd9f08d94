"""The pipeline against its stages by brute force, and on odd tables."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import test_operators as by_force  # noqa: E402

import corpus_pipeline  # noqa: E402
from allelix.llm import common, decontam, quality, secret_scan  # noqa: E402

SF = "/root/testdata/sf0.001"


def staged(spark, docs, sf_dir):
    """The rows that each stage keeps."""
    scratch, out = common.Scratch(spark), []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        out.append(docs.collect())
    return out


def test_stages_by_brute_force(spark):
    start = common.table(spark, SF, "documents")
    kept, unique, clean, masked, packed = staged(spark, start, SF)
    by_id = {r.doc_id: r for r in start.collect()}
    rules = quality.LineRules()
    want = {}
    for k, r in by_id.items():
        n, chars, *_, failed = by_force.quality_by_contract(r.text)
        text, _, lost = quality.clean_lines(r.text, rules)
        if not failed and lost <= rules.most_lost * chars:
            want[k] = text
    assert {r.doc_id: r.text for r in kept} == want
    assert all(r.n_chars == (len(r.text) if r.text != by_id[r.doc_id].text else by_id[r.doc_id].n_chars) for r in kept)

    ids = sorted(want)
    groups = by_force.components_by_force([want[k] for k in ids])
    assert sorted(r.doc_id for r in unique) == [ids[k] for k, _, c in groups if k == c]

    items = [r.text for r in common.table(spark, SF, "benchmark").collect()]
    assert {r.doc_id for r in unique} - {r.doc_id for r in clean} >= {r.doc_id for r in unique if any(i in r.text for i in items)}
    gone = {r.doc_id: r.text for r in unique if r.doc_id not in {c.doc_id for c in clean}}
    for text in gone.values():  # nothing clean goes: most of an item's words stand there
        words = set(decontam.terms_of(text))
        assert any(len(words & (own := set(decontam.terms_of(i)))) >= 0.6 * len(own) for i in items)

    assert [(r.doc_id, r.lang, r.source) for r in sorted(masked)] == [(r.doc_id, r.lang, r.source) for r in sorted(clean)]
    for r in masked:
        assert not [s for s in secret_scan.base_spans(r.text)]
    assert {r.doc_id for r in packed} == {r.doc_id for r in masked}
    assert all(r[c] is not None for r in packed for c in ("start", "length", "sequence_id", "offset"))


def test_run_gives_the_last_stage(spark):
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(corpus_pipeline.run(spark, SF).columns)


def test_odd_documents(spark):
    prose = " ".join(f"Word{k} follows here." for k in range(60))
    rows = [(1, prose, "en", None, None), (1, prose, "en", None, None), (2, None, None, None, 0), (3, "", "en", "s", 0), (None, prose.replace("Word", "Term"), "en", "s", 1), (4, prose + " more", None, "s", 7)]
    own = {"rank": 1, "kept": "own", "n_words": 9, "spans": "MINE", "cleaned": None, "row": 2.5, "_text": "t", "text_key": 3, "sid": 4, "component": "c", "redacted": "r"}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for name, value in own.items():
        docs = docs.withColumn(name, common.F.lit(value).cast("string") if value is None else common.F.lit(value))
    *stages, packed = staged(spark, docs, SF)
    for stage in stages:
        for r in stage:
            assert list(r.asDict()) == docs.columns
            assert {k: r[k] for k in own} == own
            assert (r.lang, r.source, r.n_chars) == {1: ("en", None, None), None: ("en", "s", 1), 4: (None, "s", 7)}[r.doc_id]
    assert sorted((r.doc_id for r in stages[-1]), key=repr) == [1, None]
    assert {r.doc_id for r in packed} == {1, None}
    assert all(not stage for stage in staged(spark, docs.limit(0), SF))


def test_columns_stay_where_texts_change(spark):
    prose = " ".join(f"Word{k} follows here." for k in range(60))
    rows = [(1, f"{prose}\nHome | About | Contact | Help\ntoken = abcdefgh12345678 end.", 5, "MINE", 9)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, spans string, n_words long")
    *stages, packed = staged(spark, docs, SF)
    (last,) = stages[-1]
    assert (last.doc_id, last.spans, last.n_words) == (1, "MINE", 9)
    assert "Home" not in last.text and "abcdefgh" not in last.text and "[SECRET]" in last.text
    assert last.n_chars == len(last.text)
    assert [f.dataType.simpleString() for f in docs.schema] == [f.dataType.simpleString() for f in corpus_pipeline.secret_scans(spark, docs, SF).schema]


def test_stages_of_two_pipelines_keep_what_they_read(spark):
    docs = common.table(spark, SF, "documents")
    first = corpus_pipeline.minhash_near_dedup(spark, docs, SF)
    second = corpus_pipeline.minhash_near_dedup(spark, docs.limit(50), SF)
    corpus_pipeline.benchmark_decontamination(spark, docs, SF)
    assert first.count() > second.count() > 0
