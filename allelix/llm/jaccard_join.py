"""Similarity join on sets of word n-grams: rare-first prefix filtering with length, positional and suffix filters.

N-grams are ordered by how many documents have them, rare ones first. That takes no count of each n-gram: each task counts
its documents' n-grams in a fixed number of counters, whose sum is small, and the order is that of an n-gram's counter,
then of its hash. Any order common to all sets gives the same links; this one makes few candidates. Two sets with the
similarity asked share an n-gram among the first few of each, their prefixes, so prefixes are joined on n-grams. What meets
passes if the sizes allow the similarity (length), if enough n-grams are left behind the place where they meet (positional),
and if enough of these can be common (suffix: the n-grams behind are counted in eight classes, and common ones are at most
the sum of the smaller counts). A pair passes at its first common n-gram; where the n-grams before are equal too, it has met
before. Pairs that pass are verified once, on full sets.

Documents with equal sets are one set throughout. For components, pairs that links connect already need no verification:
each set is first verified against one partner, those of a frequent n-gram against one leader; what is linked is
contracted, and of what remains only pairs that are still apart go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sub_batches, whole_groups, word_hashes
from .components import connected_components
from .near_dups import likeness, shingle_sets, shingles_of, text_key

#: Counters of n-grams, and how many make a row on their way to the sum.
COUNTERS, IN_ROW = 1 << 20, 1 << 12
#: The classes of the suffix filter, four counts of 16 bits in a long; a full count says nothing.
CLASSES, FULL = 8, 65_535
#: N-grams in more prefixes than this are led; what is left is compared block against block.
LED, BLOCK = 256, 512
POSTING = "token long, sid long, n long, pos long, before long, s0 long, s1 long"


def sets_of(texts: list[str], size: int) -> list[np.ndarray]:
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    hashes, ends = word_hashes([w for ws in words for w in ws]), np.cumsum([len(w) for w in words])
    return [np.unique(shingles_of(hashes[e - len(w) : e], size)) for w, e in zip(words, ends, strict=True)]


def counter_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """For each counter a byte that grows with its count, over all documents; a megabyte, whatever their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for texts in sub_batches(batch.column(0).to_pylist()):
                every = np.concatenate([np.zeros(0, np.uint64), *sets_of(texts, size)])
                total += np.bincount(counter_of(every), minlength=COUNTERS)
        parts = total.reshape(-1, IN_ROW)
        some = [k for k, p in enumerate(parts) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        ranks = [np.minimum(255, 8 * np.log2(1 + s)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], ["part", "ranks"])

    summed = docs.select("text").mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, ranks binary")
    found = np.zeros((COUNTERS // IN_ROW, IN_ROW), np.uint8)
    for row in summed.collect():
        found[row.part] = np.frombuffer(row.ranks, np.uint8)
    return found.reshape(-1)


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The common n-grams that sets of n and m need."""
    return -(-percent * (n + m) // (100 + percent))


def class_counts(tokens: np.ndarray) -> np.ndarray:
    return np.bincount((tokens & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)


def summarised(docs: DataFrame, ranks, size: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n, set_hash, prefix, counts) of (doc_id, text_key, text): the first n-grams in order, and all by class; null without words."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_counter = ranks.value
        for batch in batches:
            at = 0
            for texts in sub_batches(batch.column(2).to_pylist()):
                found = sets_of(texts, size)
                digests, prefixes, counts = [], [], []
                for s in found:
                    n = len(s)
                    if not n:
                        digests.append(None), prefixes.append(None), counts.append(None)
                        continue
                    length = n - -(-percent * n // 100) + 1
                    rank = of_counter[counter_of(s)]
                    if length < n:  # the first few, with all that tie with the last of them
                        most = np.partition(rank, length - 1)[length - 1]
                        chosen = s[rank <= most]
                        prefix = chosen[np.argsort(rank[rank <= most], kind="stable")][:length]
                    else:
                        prefix = s[np.argsort(rank, kind="stable")][:length]
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    prefixes.append(prefix.tobytes())
                    counts.append(class_counts(s).tobytes())
                columns = [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array([len(s) for s in found], pa.int64()), *[pa.array(c, pa.binary()) for c in (digests, prefixes, counts)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "set_hash", "prefix", "counts"])
                at += len(texts)

    kind = df_type(docs)
    return docs.select("doc_id", "text_key", "text").mapInArrow(summary, f"doc_id {kind}, text_key long, n long, set_hash binary, prefix binary, counts binary")


def df_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def postings(unique: DataFrame, most: int = 200_000) -> DataFrame:
    """A row for each n-gram of a prefix: its place, the n-gram before it, and by class how many follow from there on."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, n, prefix, counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                tokens, left = np.frombuffer(prefix, np.uint64), np.frombuffer(counts, np.int64)
                for at in range(0, len(tokens), most):
                    some = tokens[at : at + most]
                    one = np.zeros((len(some), CLASSES), np.int64)
                    one[np.arange(len(some)), (some & np.uint64(CLASSES - 1)).astype(np.int64)] = 1
                    behind = left - np.cumsum(one, 0) + one
                    before = np.concatenate([tokens[at - 1 : at] if at else np.zeros(1, np.uint64), some[:-1]])
                    packed = np.minimum(behind, FULL).astype(np.uint16).view(np.int64)
                    yield some.view(np.int64), sid, n, at, before.view(np.int64), packed
                    left = left - one.sum(0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch_of() -> pa.RecordBatch:
            lengths = [len(h[0]) for h in held]
            columns = [
                np.concatenate([h[0] for h in held]), np.repeat([h[1] for h in held], lengths), np.repeat([h[2] for h in held], lengths),
                np.concatenate([h[3] + np.arange(len(h[0])) for h in held]), np.concatenate([h[4] for h in held]), *np.concatenate([h[5] for h in held]).T,
            ]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], ["token", "sid", "n", "pos", "before", "s0", "s1"])

        for piece in explode(batches):
            held.append(piece)
            size += len(piece[0])
            if size > 50_000:
                yield batch_of()
                held, size = [], 0
        if held:
            yield batch_of()

    return unique.select("sid", "n", "prefix", "counts").mapInArrow(rows, POSTING)


def passing(x: dict[str, np.ndarray], a: np.ndarray, y: dict[str, np.ndarray], b: np.ndarray, percent: int, first_only: bool = True) -> np.ndarray:
    """Which rows a of x and b of y, of one n-gram each, pass all filters."""
    n, m, i, j = x["n"][a], y["n"][b], x["pos"][a], y["pos"][b]
    needed = least_overlap(n, m, percent)
    good = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= needed) & (x["sid"][a] != y["sid"][b])
    if first_only:
        good &= ~((i > 0) & (j > 0) & (x["before"][a] == y["before"][b]))
    at = np.flatnonzero(good)
    common = np.minimum(x["behind"][a[at]], y["behind"][b[at]]).sum(1)
    good[at[common < needed[at]]] = False
    return good


def columns_of(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    found = {c: frame[c].to_numpy() for c in ("sid", "n", "pos", "before")}
    behind = np.ascontiguousarray(frame[["s0", "s1"]].to_numpy()).view(np.uint16).reshape(len(frame), CLASSES).astype(np.int64)
    behind[behind == FULL] = 1 << 40
    return found | {"behind": behind}


def pairs_frame(x: dict[str, np.ndarray], y: dict[str, np.ndarray], found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b = np.concatenate([x["sid"][p] for p, _ in found]), np.concatenate([y["sid"][q] for _, q in found])
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def pairs_of_lists(rows: DataFrame, percent: int, most: int = 200_000) -> DataFrame:
    """Candidates (a, b), a < b, of n-grams that few prefixes hold."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups, numbers in whole_groups(batches, ["token"]):
            x, found = columns_of(groups), []
            later = np.searchsorted(numbers, numbers, "right") - np.arange(len(groups)) - 1
            total, low = np.cumsum(later), 0
            while low < len(groups):
                high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")))
                k = later[low:high]
                a = np.repeat(np.arange(low, high), k)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
                good = passing(x, a, x, b, percent)
                found.append((a[good], b[good]))
                low = high
            yield pairs_frame(x, x, found)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "token").sortWithinPartitions("token").mapInPandas(meet, "a long, b long").distinct()


def pairs_of_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of frequent n-grams: of rows (token, .., label, apart, left, right), a block of those that are apart with one of any."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups, numbers in whole_groups(batches, ["token", "left", "right"], 4_000):
            for frame in np.split(np.arange(len(groups)), np.flatnonzero(np.diff(numbers)) + 1):
                group = groups.iloc[frame]
                mine, other = group[group["side"] == 0], group[group["side"] == 1]
                if not len(mine) or not len(other):
                    continue
                x, y, labels = columns_of(mine), columns_of(other), other["label"].to_numpy()
                found, step = [], max(1, 200_000 // len(other))
                for low in range(0, len(mine), step):
                    a = np.repeat(np.arange(low, min(low + step, len(mine))), len(other))
                    b = np.tile(np.arange(len(other)), len(a) // len(other))
                    differs = mine["label"].to_numpy()[a] != labels[b]
                    a, b = a[differs], b[differs]
                    good = passing(x, a, y, b, percent)
                    found.append((a[good], b[good]))
                yield pairs_frame(x, y, found)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["token", "left", "right"]
    return rows.repartition(tasks, *by).sortWithinPartitions(*by).mapInPandas(meet, "a long, b long").distinct()


def star_pairs(star: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of (leader .., sid ..) that meet under a frequent n-gram."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            lead = frame[[f"l_{c}" for c in ("sid", "n", "pos", "before", "s0", "s1")]].rename(columns=lambda c: c[2:])
            x, y, every = columns_of(lead), columns_of(frame), np.arange(len(frame))
            good = np.flatnonzero(passing(x, every, y, every, percent, first_only=False))
            yield pairs_frame(x, y, [(good, good)])

    return star.mapInPandas(meet, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are as similar as asked, by their full sets, with what they share."""
    found = likeness(pairs.select(F.col("a").alias("leader"), F.col("b").alias("sid")), sets)
    union = F.col("n_leader") + F.col("n") - F.col("shared")
    return found.where(100 * F.col("shared") >= percent * union).select(F.col("leader").alias("a"), F.col("sid").alias("b"), "shared", union.alias("union"))


def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that no label connects."""
    of = lambda c: labels.select(F.col("sid").alias(c), F.col("label").alias(f"label_{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def apart_blocks(large: DataFrame, leaders: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Of frequent n-grams' rows, those that links don't connect to the leader, in blocks that meet blocks of all rows."""
    of_leader = leaders.select("token", F.col("leader")).join(labels.select(F.col("sid").alias("leader"), F.col("label").alias("leading")), "leader", "left")
    rows = large.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    rows = rows.join(of_leader.select("token", F.coalesce("leading", "leader").alias("leading")), "token").withColumn("apart", F.col("label") != F.col("leading")).drop("leading")
    sizes = rows.groupBy("token").agg(F.count("*").alias("all_rows"), F.sum(F.col("apart").cast("long")).alias("apart_rows")).where("apart_rows > 0")
    sized = rows.join(sizes, "token").withColumn("lefts", F.ceil(F.col("apart_rows") / block).cast("int")).withColumn("rights", F.ceil(F.col("all_rows") / block).cast("int"))
    place = lambda parts: F.pmod(F.xxhash64("sid"), parts).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    kept = ["token", "sid", "n", "pos", "before", "s0", "s1", "label"]
    mine = sized.where("apart").select(*kept, place("lefts").alias("left"), each("rights").alias("right"), F.lit(0).alias("side"))
    other = sized.select(*kept, each("lefts").alias("left"), place("rights").alias("right"), F.lit(1).alias("side"))
    return mine.unionByName(other)


def candidates(unique: DataFrame, percent: int, led_from: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b) of the n-grams in up to led_from prefixes, and the postings of more frequent ones."""
    able = unique.where((100 - percent) * F.col("n") >= percent)  # smaller sets can't be so similar without being equal
    every = postings(able)
    counts = scratch.write(every.groupBy("token").agg(F.count("*").alias("members")).where("members > 1"), "frequencies")
    met = scratch.write(every.join(counts.hint("shuffle_hash"), "token"), "postings")
    small = met.where(F.col("members") <= led_from).drop("members")
    return scratch.write(pairs_of_lists(small, percent), "candidates"), met.where(F.col("members") > led_from).drop("members")


def prepared(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("text"))


def summaries(docs: DataFrame, size: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, n, set_hash) of all documents, and the different sets, numbered."""
    ranks = docs.sparkSession.sparkContext.broadcast(frequencies(docs, size))
    found = scratch.write(summarised(docs, ranks, size, percent), "summaries")
    sets = found.where("doc_id is not null and set_hash is not null").groupBy("set_hash")
    one = sets.agg(F.min(F.struct("doc_id", "text_key")).alias("one"), *[F.first(c).alias(c) for c in ("n", "prefix", "counts")])
    # the table is written before its numbers are used, so they stay
    unique = scratch.write(one.select(F.monotonically_increasing_id().alias("sid"), "set_hash", "one.*", "n", "prefix", "counts"), "sets")
    return found.select("doc_id", "text_key", "n", "set_hash"), unique


def full_sets(docs: DataFrame, unique: DataFrame, wanted: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    chosen = unique.join(wanted, "sid", "left_semi").select("sid", "doc_id", "text_key", "set_hash")
    return scratch.write(shingle_sets(docs, chosen, size), "full sets")


def ends(*pairs: DataFrame) -> DataFrame:
    both = [p.select(F.col(c).alias("sid")) for p in pairs for c in ("a", "b")]
    found = both[0]
    for p in both[1:]:
        found = found.union(p)
    return found.distinct()


def first_partners(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def linking(unique: DataFrame, docs: DataFrame, size: int, percent: int, led_from: int, block: int, scratch: Scratch) -> DataFrame:
    """(sid, label) of the sets with a link."""
    small, large = candidates(unique, percent, led_from, scratch)
    frequent = not large.isEmpty()
    sets = full_sets(docs, unique, ends(small).union(large.select("sid")).distinct() if frequent else ends(small), size, scratch)

    def labels_of(links: DataFrame) -> DataFrame:
        return scratch.write(connected_components(links.select("a", "b"), scratch).select(F.col("node").alias("sid"), F.col("component").alias("label")), "labels")

    tried = first_partners(small)
    if frequent:
        weight = large.groupBy("sid").agg(F.count("*").alias("weight"))
        leaders = scratch.write(large.join(weight, "sid").groupBy("token").agg(F.max(F.struct("weight", "sid"))["sid"].alias("leader")), "leaders")
        whole = large.join(leaders, "token")
        leading = whole.where("sid = leader").select("token", *[F.col(c).alias(f"l_{c}") for c in ("sid", "n", "pos", "before", "s0", "s1")])
        tried = tried.union(star_pairs(whole.where("sid <> leader").join(leading, "token").drop("token", "leader"), percent)).distinct()
    tried = scratch.write(tried, "first partners")
    links = scratch.write(verified(tried, sets, percent).select("a", "b"), "links")
    labels = labels_of(links)
    left = labelled(small.join(tried, ["a", "b"], "left_anti"), labels)
    if frequent:
        left = left.union(pairs_of_blocks(apart_blocks(large, leaders, labels, block), percent).join(tried, ["a", "b"], "left_anti")).distinct()
    left = scratch.write(left, "still apart")
    if left.isEmpty():
        return labels
    tried = scratch.write(first_partners(left), "second partners")
    links = links.union(scratch.write(verified(tried, sets, percent).select("a", "b"), "links"))
    labels = labels_of(links)
    left = scratch.write(labelled(left.join(tried, ["a", "b"], "left_anti"), labels), "apart to the end")
    if left.isEmpty():
        return labels
    return labels_of(links.union(scratch.write(verified(left, sets, percent).select("a", "b"), "links")))


def similar_components(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 3, percent: int = 90, led_from: int = LED, block: int = BLOCK, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of df; extra columns, whatever their names, are dropped.

    A-Z are lower-cased, words end at ASCII white space. Documents link if their sets of distinct n-grams have
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable. Documents with fewer words than
    an n-gram are one n-gram; those without words (also null texts) link with nothing and are their own component. Rows
    without an id have none. Rows that repeat an id are judged by their own texts. An empty table gives no rows; texts of
    any length count whole. The id may be of any orderable type. Sets are compared by 64-bit hashes of their n-grams.
    """
    scratch = scratch or Scratch(df.sparkSession)
    docs = prepared(df, doc_id, text)
    with Scratch(df.sparkSession) as own:
        found, unique = summaries(docs, shingle_words, percent, own)
        labels = linking(unique, docs, shingle_words, percent, led_from, block, own)
        members = own.write(unique.select("sid", "set_hash", "doc_id").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")), "members")
        first = members.groupBy("label").agg(F.min("doc_id").alias("component"))
        of_sets = members.join(first, "label").select("set_hash", "component")
        result = found.join(of_sets, "set_hash", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        return scratch.write(result, "components")


def similar_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 3, percent: int = 90, scratch: Scratch | None = None) -> DataFrame:
    """All links (doc_id, other_id, shared, union) between different sets, as many as there are: each set stands under its smallest doc_id, and the smaller id comes first.

    Rows are judged as by similar_components; documents with equal sets are one class, not a link. Every candidate is
    verified, so a group of n texts that are all alike gives n (n - 1) / 2 rows.
    """
    scratch = scratch or Scratch(df.sparkSession)
    docs = prepared(df, doc_id, text)
    with Scratch(df.sparkSession) as own:
        _, unique = summaries(docs, shingle_words, percent, own)
        small, large = candidates(unique, percent, LED, own)
        if not large.isEmpty():
            nobody = large.select("sid").limit(0).withColumn("label", F.col("sid"))
            leaders = large.groupBy("token").agg(F.lit(-1).cast("long").alias("leader"))  # led by none, so all are apart
            small = own.write(small.union(pairs_of_blocks(apart_blocks(large, leaders, nobody, BLOCK), percent)).distinct(), "all candidates")
        links = verified(small, full_sets(docs, unique, ends(small), shingle_words, own), percent)
        of = lambda c, name: unique.select(F.col("sid").alias(c), F.col("doc_id").alias(name))
        named = links.join(of("a", "one"), "a").join(of("b", "two"), "b")
        return scratch.write(named.select(F.least("one", "two").alias("doc_id"), F.greatest("one", "two").alias("other_id"), "shared", "union"), "similar pairs")
