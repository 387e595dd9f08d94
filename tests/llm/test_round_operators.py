"""The Jaccard join, the fill-in-middle transformation and the filter audit against brute force, on nulls, ties, repeated rows and long texts."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from test_operators import DOCS, clashing, components_by_force, documents, family, rows, sets_of

from allelix.llm import audit, chat, common, fim, jaccard_join, near_dups, packing, quality, queries, secret_scan, tokens, urls

SF = "/root/testdata/sf0.001"


# N-gram Jaccard join

TEXTS = ["", None, "  \n", "one two", "ONE two", "one  two", "É É É É", "é é é é", *["same text again and again"] * 4]


def clusters():
    return [*family(1, 60, words=120, edits=3), *family(2, 30, words=12, edits=1), *family(3, 30, words=400, edits=12), *family(4, 25, words=90, edits=2)]


@pytest.mark.parametrize(("block", "led_from"), [(512, 256), (4, 256), (512, 3), (4, 3)])
def test_joined_components_by_brute_force(spark, block, led_from):
    texts = [*TEXTS, *clusters()]
    got = jaccard_join.similar_components(clashing(documents(spark, *texts), "component_id", "n", "sid"), block=block, led_from=led_from)
    want = components_by_force(texts, 3, 90)
    assert len({c for _, _, c in want}) < len(texts) - 20
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


@pytest.mark.parametrize(("percent", "led_from"), [(90, 256), (70, 256), (90, 2)])
def test_all_pairs_by_brute_force(spark, percent, led_from, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LED", led_from)
    texts = [*TEXTS, *clusters()]
    sets, first = sets_of(texts, 3), {}
    for k, s in enumerate(sets):
        if s:
            first.setdefault(frozenset(s), k)
    want = []
    for (s, a), (t, b) in itertools.combinations(first.items(), 2):
        if 100 * len(s & t) >= percent * len(s | t):
            want.append((min(a, b), max(a, b), len(s & t), len(s | t)))
    got = jaccard_join.similar_pairs(documents(spark, *texts), percent=percent)
    assert len(want) > 30
    assert rows(got, "doc_id", "other_id", "shared", "union") == sorted(want, key=repr)


def test_joined_rows_whose_ids_repeat_or_lack(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(3, text), (3, "quite another text"), (1, text), (None, text), (5, None), (3, text)], DOCS)
    got = rows(jaccard_join.similar_components(df), "doc_id", "n_shingles", "component_id")
    assert got == sorted([(3, 38, 1), (3, 38, 1), (3, 1, 3), (1, 38, 1), (None, 38, None), (5, 0, 5)], key=repr)
    assert jaccard_join.similar_components(df.limit(0)).count() == 0
    assert jaccard_join.similar_pairs(df.limit(0)).count() == 0


def test_texts_longer_than_a_batch_join(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(230_000)]
    other = words[:100] + ["changed"] + words[101:]
    got = jaccard_join.similar_components(documents(spark, " ".join(words), "short", " ".join(other)))
    assert rows(got, "doc_id", "component_id") == [(0, 0), (1, 1), (2, 0)]


@pytest.mark.parametrize("seed", range(5))
def test_filters_lose_no_pair_at_its_first_common_ngram(seed):
    """Each pair that is similar enough passes where the orders of both sets meet first."""
    rng = np.random.default_rng(seed)
    percent = int(rng.integers(60, 96))
    for _ in range(200):
        shared = rng.choice(2**62, int(rng.integers(1, 80)), replace=False).astype(np.uint64)
        x, y = (np.sort(np.concatenate([shared, rng.choice(2**62, int(rng.integers(0, 12)), replace=False).astype(np.uint64)])) for _ in range(2))
        if 100 * len(np.intersect1d(x, y)) < percent * len(np.union1d(x, y)):
            continue
        first = np.intersect1d(x, y).min()
        both = []
        for sid, s in enumerate((x, y)):
            at = int(np.searchsorted(s, first))
            assert at <= len(s) - -(-percent * len(s) // 100)  # within the prefix
            behind = np.bincount((s[at:] & np.uint64(7)).astype(int), minlength=8)
            both.append({"sid": np.array([sid]), "n": np.array([len(s)]), "pos": np.array([at]), "before": np.array([s[at - 1] if at else 0], np.uint64), "behind": behind[None, :]})
        one = np.zeros(1, int)
        assert jaccard_join.passing(both[0], one, both[1], one, percent).all()


def test_counters_are_of_all_documents(spark):
    texts = [*["a b c d"] * 50, "a b c", "x y z"]
    ranks = jaccard_join.frequencies(documents(spark, *texts), 3)
    abc, bcd, xyz = (ranks[jaccard_join.counter_of(np.unique(jaccard_join.sets_of([t], 3)[0]))][0] for t in ("a b c", "b c d", "x y z"))
    assert len(ranks) == jaccard_join.COUNTERS
    assert (abc, bcd, xyz) == tuple(min(255, int(8 * np.log2(1 + c))) for c in (51, 50, 1))


# Fill in the middle

ODD = ["", None, "a", "🙂", "né́e 日本語 🙂🙂 x", "has <P> inside", "<S", "x<M>", "<P", "a<", "<<<S>", "line\nline\r\n\n", "é" * 9000, "ab🙂" * 5000, "a\x00b", "<" * 50]


def fim_by_force(doc_id, text, units=None, plain_from=90, spm_below=20):
    text = text or ""
    units = list(text) if units is None else units(text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_below:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def words_and_rest(text):
    found, at = [], 0
    for m in re.finditer(r"[A-Za-z0-9]+", text):
        found.append(text[at : m.end()])
        at = m.end()
    return [*found, text[at:]] if at < len(text) else found


@pytest.mark.parametrize(("unit", "units", "run"), [(None, None, 4096), (None, None, 3), ("[A-Za-z0-9]+", words_and_rest, 4096)])
def test_transformed_texts_by_brute_force(spark, unit, units, run):
    given = [(k, ODD[k % len(ODD)]) for k in range(12 * len(ODD))] + [(None, "no id"), (7, "another text of id 7"), (7, ODD[7]), (7, ODD[7])]
    df = clashing(spark.createDataFrame(given, DOCS), "output", "FORM", "first", "n", "key", "id")
    got = fim.fill_in_middle(df, unit=unit, run=run)
    assert {"first", "key", "id", "text"} <= set(got.columns) and "FORM" not in got.columns
    found = got.withColumn("back", fim.restored(common.F.col("output"), common.F.col("form")))
    want = [(k, t, *fim_by_force(k, t, units), t or "") for k, t in given]
    assert len({w[3] for w in want}) == 3
    assert rows(found, "doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back") == sorted(want, key=repr)


def test_transformation_of_none_and_of_documents_of_one_form(spark):
    df = documents(spark, *["some words here"] * 30)
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    assert {r.form for r in fim.fill_in_middle(df, plain_from=100, spm_below=100).collect()} == {"spm"}
    assert {r.form for r in fim.fill_in_middle(df, plain_from=0).collect()} == {"plain"}


def test_texts_are_shuffled_once(spark):
    plan = queries.op12_fill_in_middle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


# Filter audit


def audit_by_force(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    flags = []
    for i, t, part in docs:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        flags.append((part or "", f, i in good, i in toxic))
    out = []
    for part in {f[0] for f in flags}:
        mine, share, found = [f for f in flags if f[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [f for f in left if f[1][name]]
                left = [f for f in left if not f[1][name]]
                failing = [f for f in mine if f[1][name]]
                share[name] += len(gone)
                found.append((part, "".join(order), step, name, len(left), len(gone), len(failing) - len(gone), sum(sum(f[1].values()) == 1 for f in failing), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        out += [(*f, share[f[3]]) for f in found]
    return out


@pytest.mark.parametrize("hot_copies", [1000, 2])
def test_audit_by_brute_force(spark, hot_copies):
    rng = random.Random(3)
    texts = ["", None, "Short TEXT", "x" * 10, "a|b", *(" ".join(rng.choice(["word", "Other", "thing", f"n{rng.randrange(99)}", "100%"][: rng.randrange(1, 6)]) for _ in range(rng.randrange(30, 90))) for _ in range(40))]
    docs = [(k, rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for k in range(150)] + [(None, texts[7], "s1"), (3, texts[8], "s2"), (3, texts[8], "s2")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string, source string"), "good", "part", "digest", "E")
    got = audit.audit_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), hot_copies=hot_copies)
    names = ("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert rows(got, *names) == sorted(audit_by_force(docs, labels), key=repr)


def test_audit_of_none_and_of_other_filters(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.audit_filters(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    flags = spark.createDataFrame([("p", True, None, False, False)], "part string, X boolean, Y boolean, good boolean, toxic boolean")
    got = rows(audit.replay(flags, "XY"), "filter_order", "step", "kept", "removed", "redundant", "shapley")
    assert got == [("XY", 1, 0, 1, 0, 2), ("XY", 2, 0, 0, 0, 0), ("YX", 1, 1, 0, 0, 0), ("YX", 2, 0, 1, 0, 2)]
    with pytest.raises(ValueError, match="different"):
        audit.replay(flags, "XX")


# Rules mended


def test_very_long_urls_make_no_more_expressions(spark):
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    deep = "/".join(["a"] * 20_000)
    given = [f"http://a.b.c.d.example.com/en/{deep}", f"http://a.b.c.example.com/{deep}/en/", "http://" + "a." * 5_000 + "net/es/x", f"http://x.net/{deep}", None, ""]
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    for most in (100, 1):
        got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df, rules, most_broadcast=most).collect()}
        assert got == {0: ("example.com/en/", "block"), 1: ("com/", "allow"), 2: ("net/es/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow")}
    assert urls.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, rules.limit(0)).collect()} == {"allow"}
    plan = urls.judge_urls(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


PROSE = (
    "Their market share on Monday rose by two points, which pleased everyone.",
    "I share this view with most of my colleagues in the lab.",
    "He decided to sign up for the army in 1914, when he was barely nineteen.",
    "La société exploite le site sous licence depuis dix ans.",
    "Se registrate en el hotel antes de comer.",
    "The court held that the privacy policy of the firm had misled its customers for years.",
    "The drug was licensed under the Medicines Act of 1968 and sold until the war.",
    "She uses cookies to bribe the children of her neighbours into silence.",
    "Sie sagte, man solle hier klicken oder warten, bis jemand aus dem Dorf zurück sei.",
)


def test_prose_that_only_holds_a_phrase_stays(spark):
    for line in PROSE:
        assert quality.failed_rule(line, quality.LineRules()) is None, line
    text = "\n".join(f"{line} Chapter {k} tells of it." for k, line in enumerate(PROSE))
    (found,) = quality.judge_quality(documents(spark, text)).collect()
    assert found.kept and found.cleaned == text
    for line in ("Sign up for our letter today.", "See more. Share on Facebook or print.", "Read the privacy policy and terms of use.", "This website uses cookies to give you a better time on all of our pages.", "Das Bild ist lizenziert unter CC BY."):
        assert quality.failed_rule(line, quality.LineRules()) == "boilerplate", line


def test_paths_of_long_slugs_are_no_secrets_and_keys_around_a_word_are():
    assert secret_scan.entropy_spans("https://example.com/articles/2024/05/how-to-cook-rice-and-beans-42") == []
    for key in ("q7Zp2XvK9mLdexampleR4tW8yB3nHs6", "q7Zp2XvK9mLdR4tW8yB3nHs6"):
        assert [s[2] for s in secret_scan.entropy_spans(f"key {key} here")] == ["entropy_base64"]


def test_a_conversation_over_many_tasks_is_hashed_and_rendered_whole(spark):
    rng = random.Random(8)
    long = [(1, k, "user", f"turn {k}") for k in range(3000)]
    snapshot, other = [(2, k, r, t) for _, k, r, t in long[:2500]], [(3, k, r, t if k != 1234 else "else") for _, k, r, t in long]
    short = [(k, j, "user", str(rng.randrange(2))) for k in range(4, 60) for j in range(rng.randrange(1, 6))]
    rows_ = [*long, *snapshot, *other, *short, *long[:50]]
    rng.shuffle(rows_)
    df = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.format_chats(df).collect()}
    said = {}
    for c, _, _, t in sorted({*rows_}):
        said.setdefault(c, []).append(t)
    heads = {tuple(ts[:k]) for ts in said.values() for k in range(len(ts))}
    want, seen = {}, set()
    for c, ts in sorted(said.items()):
        if tuple(ts) not in heads and tuple(ts) not in seen:
            seen.add(tuple(ts))
            want[c] = (len(ts), "".join(f"<|user|>\n{t}\n" for t in ts))
    assert got == want and set(got) >= {1, 3} and 2 not in got
    pieces = chat.chat_pieces(df, piece=100).where("conv_id = 1").orderBy("piece").collect()
    assert len(pieces) == 30 and "".join(p.rendered for p in pieces) == want[1][1]


def test_stretches_of_turns_hash_as_the_whole():
    turns = [bytes([k]) * 16 for k in range(9)]

    def whole(ts):
        state = 0
        for t in ts:
            state = (state * chat.BASE + int.from_bytes(t, "big")) % chat.PRIME
        return state

    ends = [(p, "c", 3, whole(turns[3 * p : 3 * p + 3]).to_bytes(16, "big")) for p in range(3)]
    found = chat.offsets(ends[::-1])
    assert found == {(p, "c"): (3 * p, whole(turns[: 3 * p]), p < 2) for p in range(3)}


@pytest.mark.parametrize(("block_bytes", "led_from"), [(1 << 12, 256), (1 << 12, 3), (1, 256)])
def test_near_duplicates_in_blocks_of_few_bytes(spark, monkeypatch, block_bytes, led_from):
    monkeypatch.setattr(near_dups, "BLOCK_BYTES", block_bytes)
    texts = [*TEXTS, *family(1, 40), *family(2, 20, words=400, edits=20), *family(4, 15, edits=9)]
    got = near_dups.near_duplicates(documents(spark, *texts), led_from=led_from)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(components_by_force(texts), key=repr)


def test_light_groups_are_whole(monkeypatch):
    rng = np.random.default_rng(4)
    for rows_, most in ((5, 100), (50, 10**9), (10**6, 64), (3, 1)):
        monkeypatch.setattr(near_dups, "BLOCK_BYTES", most)
        frame = pd.DataFrame({"tag": np.sort(rng.integers(0, 40, 200)), "masked": 0, "block_a": 0, "block_b": 0, "n": rng.integers(1, 9, 200), "at": np.arange(200)})
        found = list(near_dups.light_groups((frame.iloc[k : k + 17] for k in range(0, 200, 17)), rows_))
        assert [x for f, _ in found for x in f["at"]] == list(range(200))
        tags = [set(f["tag"]) for f, _ in found]
        assert all(not a & b for a, b in zip(tags, tags[1:], strict=False))
        assert all(len(set(zip(f["tag"], numbers, strict=True))) == f["tag"].nunique() for f, numbers in found)


# Packing


class Counted:
    """A tokenizer that counts the words it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.words += sum(len(t.replace(f" {packing.BETWEEN} ", " ").split()) for t in texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def spelled(n):
    """Some distinct word for each number."""
    return "q" + "".join(chr(97 + int(c, 36) % 26) + ("z" if int(c, 36) > 25 else "") for c in np.base_repr(n, 36).lower())


def test_known_words_are_encoded_once_and_kept_in_little_memory():
    counted = Counted(tokens.load_tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    texts = [" ".join(map(spelled, range(k, k + 500))) for k in range(0, 250_000, 500)]
    distinct = len({w for t in texts for w in t.split()})
    words = packing.WordIds(counted, 1)
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    for k in range(0, len(texts), 50):
        list(words.of_texts(pa.array(texts[k : k + 50])))
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert kept < 80 * distinct
    for k in range(0, len(texts), 50):
        list(words.of_texts(pa.array(texts[k : k + 50])))
    assert counted.words <= distinct + 100


@pytest.mark.parametrize(("most", "part"), [(400_000, 1_000_000), (40, 1_000_000), (0, 1), (7, 300)])
def test_ids_of_texts_are_the_tokenizers(monkeypatch, most, part):
    monkeypatch.setattr(packing, "PART_BYTES", part)
    tokenizer, rng = tokens.load_tokenizer(public_tokenizers.path("word_bpe_49k.json")), random.Random(5)
    some = ["the", "The", "THE,", "end.", "it's", "don't!?", "a;b", ";", ";;", "École,", "e\u0301t\u00e9", "\u0130x", "x1y22", "word" * 30, ",", "...", "\U0001f600", "<unk>", "\u4e2d\u6587"]
    odd = ["", " ", "\n\t ", "a\u00a0b\u3000c", "one\x1ctwo", "\x85", "x\u180ey end.", "\x1c", " lead", "trail ", "the " * 3000]
    texts = [*odd, *(rng.choice([" ", "  ", "\n"]).join(rng.choices(some, k=rng.randrange(40))) for _ in range(300))]
    words = packing.WordIds(tokenizer, 1, most)
    for _ in range(3):
        rng.shuffle(texts)
        for k in range(0, len(texts), 60):
            batch = texts[k : k + 60]
            found = [(list(flat), list(sizes)) for flat, sizes in words.of_texts(pa.array(["cut off", *batch]).slice(1))]
            want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in batch]
            assert [i for flat, _ in found for i in flat] == [i for ids in want for i in ids]
            assert [n for _, sizes in found for n in sizes] == list(map(len, want))
            assert len(words.known.words) == len(words.known.sizes) == len(words.known.asked) <= most
            assert words.known.sizes.sum() == len(words.known.ids)


def test_texts_that_are_kept_are_measured_once(spark):
    kept = quality.judge_quality(documents(spark, *TEXTS)).where("kept").select("cleaned")
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
