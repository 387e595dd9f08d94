"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's signature is 40 MinHash values of 16 bits, held as 10 chunks of four in a 64-bit integer each. Two
signatures that differ in at most 19 of the 40 values have, by the pigeonhole principle, a chunk with at most one
differing value. So each chunk is indexed four times, each time with another value blanked (the enumeration of its
allowed error): every pair within that distance meets under some key. At a similarity of exactly 0.75, a pair differs
in 10 values on average, and misses all keys with a probability of 1.5e-6; the more alike, the less. What meets is
counted only under its first common key, passes if it differs in at most 25 values and the sizes allow the similarity,
and is then confirmed on the full shingle sets. Documents with equal sets are one document throughout.

The members of a large bucket are first confirmed against one of them, its leader, and what is linked is contracted.
Only members that are still apart from the leader are then compared with others in pairs, and only with those that the
triangle inequality (one less the similarity is a metric) leaves: so many near copies of one text cost one comparison each.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, mixed, sub_batches, whole_groups, word_hashes
from .components import connected_components

CHUNKS, IN_CHUNK = 10, 4
VALUES = CHUNKS * IN_CHUNK
SIGNATURE = [f"s{k}" for k in range(CHUNKS)]
#: At a similarity of 0.75, a pair differs in more values than this with a probability below 1e-7.
MOST_DIFFERING = 25
#: At a similarity of 0.5, a pair differs in more values than this with a probability below 1e-6.
MOST_DIFFERING_HALF = 35
#: Buckets of more members are led; what is left of them is compared block against block.
LED, BLOCK = 256, 512
#: Nor does a block hold sets of more bytes together, on average, unless one set alone does.
BLOCK_BYTES = 16 << 20

_RANDOM = np.random.default_rng(20_240_607)
FACTORS = _RANDOM.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(0, 2**63, VALUES, dtype=np.uint64)
SHINGLE_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of all shingles of a text, A-Z lower-cased, repeated ones too; of all words together if they are fewer."""
    return shingles_of(word_hashes((text or "").encode("utf-8", "surrogatepass").lower().split()), size)


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    width = min(size, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    total = words[:n] + np.uint64(width)
    for k in range(1, width):
        total = total * SHINGLE_FACTOR + words[k : k + n]
    return mixed(total)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of CHUNKS integers, for sets that aren't empty."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    every, out = np.concatenate(sets), np.zeros((len(sets), CHUNKS), np.uint64)
    for k in range(VALUES):
        least = np.minimum.reduceat(every * FACTORS[k] + TERMS[k], starts)
        out[:, k // IN_CHUNK] |= (mixed(least) >> np.uint64(48)) << np.uint64(16 * (k % IN_CHUNK))
    return out


def sign(df: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, n, set_hash, s0 ..) of (doc_id, text_key, text); set_hash and signature are null for documents without words."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in sub_batches(batch.column(2).to_pylist()):
                words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
                hashes = word_hashes([w for ws in words for w in ws])
                ends = np.cumsum([len(w) for w in words])
                sets = [np.unique(shingles_of(hashes[e - len(w) : e], size)) for w, e in zip(words, ends, strict=True)]
                some = [k for k, s in enumerate(sets) if len(s)]
                chunks = np.zeros((len(texts), CHUNKS), np.int64)
                if some:
                    chunks[some] = signatures([sets[k] for k in some]).view(np.int64)
                none = np.array([len(s) == 0 for s in sets])
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                columns = [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(chunks[:, k], pa.int64(), mask=none) for k in range(CHUNKS)]], ["doc_id", "text_key", "n", "set_hash", *SIGNATURE])
                at += len(texts)
        give_back()

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text_key", "text").mapInArrow(signed, f"doc_id {kind}, text_key long, n long, set_hash binary, " + ", ".join(f"{s} long" for s in SIGNATURE))


def index_keys() -> Column:
    """One struct (tag, masked) for each chunk and each of its values that may differ."""
    signed = [(~(0xFFFF << 16 * e) + 2**63) % 2**64 - 2**63 for e in range(IN_CHUNK)]
    return F.array(*[F.struct(F.lit(IN_CHUNK * c + e).cast("byte").alias("tag"), F.col(s).bitwiseAND(F.lit(signed[e]).cast("long")).alias("masked")) for c, s in enumerate(SIGNATURE) for e in range(IN_CHUNK)])


def lanes(chunks: np.ndarray) -> np.ndarray:
    """The values of signatures, VALUES a row."""
    return np.ascontiguousarray(chunks).view(np.uint16).reshape(len(chunks), VALUES)


def candidate_pairs(group: pd.DataFrame, numbers: np.ndarray, percent: int, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Rows that go on as pairs, of groups one after the other (numbers: that of each row's group), about `most` pairs at once.

    They are close enough, their sizes allow the similarity, `tag` is their first common key, they aren't linked yet (by
    label), and of a group of two blocks they aren't of the same one.
    """
    values, sizes, labels, blocks, tags = lanes(group[SIGNATURE].to_numpy()), *(group[c].to_numpy() for c in ("n", "label", "block", "tag"))
    across = (group["block_a"] != group["block_b"]).to_numpy()
    later = np.searchsorted(numbers, numbers, "right") - np.arange(len(group)) - 1
    total, found, low = np.cumsum(later), [], 0
    while low < len(group):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")))
        n = later[low:high]
        a = np.repeat(np.arange(low, high), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        ok = (labels[a] != labels[b]) & ~(across[a] & (blocks[a] == blocks[b])) & (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b]))
        a, b = a[ok], b[ok]
        same = (values[a] == values[b]).reshape(-1, CHUNKS, IN_CHUNK)
        in_chunk = same.sum(-1, dtype=np.uint8)
        chunk = (in_chunk >= IN_CHUNK - 1).argmax(-1)
        own = same[np.arange(len(a)), tags[a] // IN_CHUNK]
        blanked = own.argmin(-1)  # 0 if all four agree
        good = (chunk == tags[a] // IN_CHUNK) & (in_chunk.sum(-1) >= VALUES - MOST_DIFFERING) & (blanked == tags[a] % IN_CHUNK)
        found.append((a[good], b[good]))
        low = high
    a, b = zip(*found, strict=True)
    return np.concatenate(a), np.concatenate(b)


def confirmed(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs are as similar as asked, by their full sets."""
    sizes = np.array([len(s) for s in sets])
    if len(a) < 500:
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    else:  # many pairs of few documents: count common shingles by matrix products
        used = np.unique(np.concatenate([a, b]))
        every = np.concatenate([sets[k] for k in used])
        row = np.repeat(np.arange(len(used)), sizes[used])
        _, column, times = np.unique(every, return_inverse=True, return_counts=True)
        often = times > 1
        number = np.cumsum(often) - 1
        keep = often[column]
        row, column = row[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common, width = np.zeros((len(used), len(used)), np.float32), 2048
        for begin in range(0, int(often.sum()), width):
            lo, hi = np.searchsorted(column, [begin, begin + width])
            block = np.zeros((len(used), min(width, int(often.sum()) - begin)), np.float32)
            block[row[lo:hi], column[lo:hi] - begin] = 1
            common += block @ block.T
        shared = common[np.searchsorted(used, a), np.searchsorted(used, b)].astype(np.int64)
    return 100 * shared >= percent * (sizes[a] + sizes[b] - shared)


def spanning(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the links (a, b), as many as connect what they connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            yield x, y


GROUP = ["tag", "masked", "block_a", "block_b"]


def by_group(df: DataFrame) -> DataFrame:
    """Groups in as many tasks as the session has shuffle partitions: few bytes here are much work, so they aren't to be coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *GROUP).sortWithinPartitions(*GROUP, "block")


def surviving(members: DataFrame, percent: int) -> DataFrame:
    """Of a bucket's members, those in a candidate pair."""

    def survive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups, numbers in whole_groups(batches, GROUP):
            a, b = candidate_pairs(groups, numbers, percent)
            if len(a):
                yield groups.iloc[np.union1d(a, b)]

    return by_group(members).mapInPandas(survive, members.schema)


def light_runs(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The rows in frames whose sets hold at most so many bytes, or one set."""
    for batch in batches:
        total = np.cumsum(8 * batch["n"].to_numpy())
        low = 0
        while low < len(batch):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")))
            yield batch.iloc[low:high]
            low = high


def light_groups(batches: Iterator[pd.DataFrame], rows: int = 2_000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Runs of whole groups, as many as have about so many rows and BLOCK_BYTES of sets: where a group is over, what is held is given."""
    held: list[pd.DataFrame] = []
    count = size = 0

    def given() -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        yield from whole_groups(iter(held), GROUP, 1 << 40)

    for batch in light_runs(batches, BLOCK_BYTES):
        keys = batch[GROUP].to_numpy()
        change = np.append(True, (keys[1:] != keys[:-1]).any(1))
        if held:
            change[0] = (held[-1][GROUP].to_numpy()[-1] != keys[0]).any()
        begins = np.flatnonzero(change)
        if len(begins) and held and (count + len(batch) > rows or size + 8 * int(batch["n"].sum()) > BLOCK_BYTES):
            if begins[0]:
                held.append(batch.iloc[: begins[0]])
            yield from given()
            held, count, size, batch = [], 0, 0, batch.iloc[begins[0] :]
        held.append(batch)
        count, size = count + len(batch), size + 8 * int(batch["n"].sum())
    if held:
        yield from given()


def links(members: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between members that carry their full set, as many as connect what is linked in each group."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups, numbers in light_groups(batches):
            a, b = candidate_pairs(groups, numbers, percent)
            if not len(a):
                continue
            sets, names, found = [np.frombuffer(s, np.uint64) for s in groups["shingles"]], groups["sid"].to_numpy(), []
            for x, y in zip(*(np.split(c, np.flatnonzero(np.diff(numbers[a])) + 1) for c in (a, b)), strict=True):  # group by group
                first, last = x.min(), y.max() + 1
                good = confirmed(sets[first:last], x - first, y - first, percent)
                found += spanning(x[good], y[good])
            if found:
                yield pd.DataFrame({"a": names[[x for x, _ in found]], "b": names[[y for _, y in found]]})

    return by_group(members).mapInPandas(link, "a long, b long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(sid, shingles): the full sets, as sorted 64-bit hashes, of the texts that stand for the wanted sets (sid, doc_id, text_key, set_hash)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at = batch.column(0), 0
            for texts in sub_batches(batch.column(1).to_pylist()):
                sets = [np.unique(shingle_hashes(t, size)).tobytes() for t in texts]
                right = pa.array([hashlib.blake2b(s, digest_size=16).digest() == d.as_py() for s, d in zip(sets, batch.column(2).slice(at), strict=False)], pa.bool_())
                yield pa.RecordBatch.from_arrays([names.slice(at, len(texts)), pa.array(sets, pa.binary())], ["sid", "shingles"]).filter(right)
                at += len(texts)
        give_back()

    texts = docs.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["sid"]).select("sid", "text", "set_hash")
    return texts.mapInArrow(gather, "sid long, shingles binary")


def near_leaders(pairs: DataFrame) -> DataFrame:
    """Of (leader, sid) with both signatures (l0 .., s0 ..) and sizes (n_leader, n), those that can be half alike."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda names: np.column_stack([batch.column(c).to_numpy() for c in names])  # noqa: B023, E731
            n, m = batch.column("n_leader").to_numpy(), batch.column("n").to_numpy()
            good = ((lanes(of(LEADING)) != lanes(of(SIGNATURE))).sum(1) <= MOST_DIFFERING_HALF) & (2 * np.minimum(n, m) >= np.maximum(n, m))
            yield batch.select(["leader", "sid"]).filter(pa.array(good))

    return pairs.mapInArrow(near, "leader long, sid long")


def likeness(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(leader, sid, n_leader, n, shared) of (leader, sid): set sizes and common shingles. A leader's set is sent once for some hundred members."""
    parts = scaled(pairs.groupBy("leader").agg(F.count("*").alias("members")))
    members = pairs.join(parts, "leader").select("leader", F.pmod(F.xxhash64("sid"), "parts").cast("int").alias("part"), "sid")
    members = members.join(sets, "sid").select("leader", "part", "sid", "shingles")
    own = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = own.join(sets, own["leader"] == sets["sid"]).select("leader", "part", F.lit(None).cast("long").alias("sid"), "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            for leader, sid, data in zip(batch.column("leader").to_pylist(), batch.column("sid").to_pylist(), batch.column("shingles"), strict=True):
                found = np.frombuffer(data.as_buffer(), np.uint64)
                if sid is None:
                    held = found.copy()
                else:
                    rows.append((leader, sid, len(held), len(found), len(np.intersect1d(held, found, assume_unique=True))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["leader", "sid", "n_leader", "n", "shared"])

    both = own.unionByName(members)
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(tasks, "leader", "part").sortWithinPartitions("leader", "part", F.col("sid").asc_nulls_first())
    return ordered.mapInArrow(compare, "leader long, sid long, n_leader long, n long, shared long")


def scaled(counted: DataFrame) -> DataFrame:
    return counted.select("leader", F.ceil(F.col("members") / BLOCK).cast("int").alias("parts"))


LEADING = [f"l{k}" for k in range(CHUNKS)]


def led(rows: DataFrame, unique: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of large buckets' rows (tag, masked, sid): links (a, b), and the rows that are still to be compared, with their labels.

    The leader is the member in most large buckets: of near copies that is what they are copies of. A member that no
    link connects to its leader is apart. It can be linked with a member x that is connected only if x isn't much more
    like the leader than it is itself; where no bound is known, x is compared. sets: the full sets of all members.
    """
    weight = rows.groupBy("sid").agg(F.count("*").alias("weight"))
    leaders = rows.join(weight, "sid").groupBy("tag", "masked").agg(F.max(F.struct("weight", "sid"))["sid"].alias("leader"))
    star = scratch.write(rows.join(leaders, ["tag", "masked"]).where("sid <> leader").select("tag", "masked", "sid", "leader"), "led")
    mine = unique.select("sid", "n", *SIGNATURE)
    theirs = unique.select(F.col("sid").alias("leader"), F.col("n").alias("n_leader"), *[F.col(s).alias(x) for s, x in zip(SIGNATURE, LEADING, strict=True)])
    near = scratch.write(near_leaders(star.select("leader", "sid").distinct().join(mine, "sid").join(theirs, "leader")), "near leaders")
    alike = scratch.write(likeness(near, sets), "likeness")
    union = F.col("n_leader") + F.col("n") - F.col("shared")
    found = alike.where(100 * F.col("shared") >= percent * union).select(F.col("leader").alias("a"), F.col("sid").alias("b"))
    labels = scratch.write(connected_components(found, scratch).select(F.col("node").alias("sid"), F.col("component").alias("label")), "labels")

    judged = star.join(alike.select("leader", "sid", (F.col("shared") / union).alias("share")), ["leader", "sid"], "left")
    judged = judged.join(labels, "sid", "left").join(labels.select(F.col("sid").alias("leader"), F.col("label").alias("leading")), "leader", "left")
    judged = judged.select("tag", "masked", "sid", "share", F.coalesce("label", "sid").alias("label"), F.coalesce("leading", "leader").alias("leading"))
    judged = scratch.write(judged.withColumn("apart", F.col("label") != F.col("leading")), "judged by leaders")
    most = judged.where("apart").groupBy("tag", "masked").agg(F.greatest(F.max(F.coalesce("share", F.lit(0.5))), F.lit(0.5)).alias("most"))
    open_ = F.col("apart") | F.col("share").isNull() | (F.col("share") <= F.col("most") + (1 - percent / 100) + 1e-9)
    return found, judged.join(most, ["tag", "masked"]).where(open_).select("tag", "masked", "sid", "label")


def compared(rows: DataFrame, unique: DataFrame, block: int) -> DataFrame:
    """The rows (tag, masked, sid, label, members, shingles) of buckets by pairs of blocks, with what their comparison takes.

    A block has at most about `block` members and BLOCK_BYTES of their sets, so a pair of blocks fits a task however long texts are.
    """
    heavy = F.ceil(8 * F.col("shingles") / BLOCK_BYTES)
    placed = rows.withColumn("blocks", F.greatest(F.ceil(F.col("members") / block), F.least(heavy, F.col("members"))).cast("int")).withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
    placed = placed.select("sid", "label", "tag", "masked", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("sid", "label", "tag", "masked", "block", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"))
    return placed.join(unique.select("sid", "n", *SIGNATURE), "sid")


def judged(docs: DataFrame, size: int, percent: int, block: int, led_from: int, scratch: Scratch) -> DataFrame:
    """Of (doc_id, text_key, text): (doc_id, text_key, n, component, first_key) for every row; component is null without words or id.

    first_key: the text_key of the row with the smallest (doc_id, text_key) in the component, whose doc_id is `component`.
    What the result reads stays in scratch.
    """
    signed = scratch.write(sign(docs, size), "signed")
    with Scratch(docs.sparkSession) as own:
        of_sets = scratch.write(components_of_sets(signed, docs, size, percent, block, led_from, own), "components")
    has_set = F.col("set_hash").isNotNull()
    return signed.select("doc_id", "text_key", "n", "set_hash").join(of_sets, "set_hash", "left").select(
        "doc_id", "text_key", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.when(has_set, F.col("doc_id")))).alias("component"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("first_key", F.when(has_set, F.col("text_key")))).alias("first_key"),
    )


def components_of_sets(signed: DataFrame, docs: DataFrame, size: int, percent: int, block: int, led_from: int, scratch: Scratch) -> DataFrame:
    """(set_hash, component, first_key) of the sets that several rows have or that are linked with others."""
    sets = signed.where("doc_id is not null and set_hash is not null").groupBy("set_hash")
    one = sets.agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.first("n").alias("n"), F.count("*").alias("copies"), *[F.first(s).alias(s) for s in SIGNATURE])
    # numbers are short keys; the table is written before they are used, so they stay
    unique = scratch.write(one.select(F.monotonically_increasing_id().alias("sid"), "set_hash", "one.*", "n", "copies", *SIGNATURE), "unique")

    keyed = unique.select("sid", "n", F.explode(index_keys()).alias("key")).select("sid", "n", "key.tag", "key.masked")
    buckets = scratch.write(keyed.groupBy("tag", "masked").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).where("members > 1"), "buckets")
    rows = scratch.write(keyed.drop("n").join(buckets, ["tag", "masked"]).select("tag", "masked", "sid", "members", "shingles"), "rows")
    small, large = rows.where(F.col("members") <= led_from).withColumn("label", F.col("sid")), rows.where(F.col("members") > led_from).drop("members", "shingles")
    left, several = scratch.write(surviving(compared(small, unique, block), percent), "candidates"), not large.isEmpty()

    # all full sets in one pass over the documents
    wanted = left.select("sid").union(large.select("sid")).distinct()
    full = scratch.write(shingle_sets(docs, unique.join(wanted, "sid").select("sid", "doc_id", "text_key", "set_hash"), size), "shingle sets")
    found = None
    if several:
        found, open_ = led(large, unique, full, percent, scratch)
        open_ = scratch.write(open_.join(unique.select("sid", "n"), "sid"), "left to compare")
        sizes = open_.groupBy("tag", "masked").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
        open_ = open_.drop("n").join(sizes, ["tag", "masked"])
        left = left.unionByName(scratch.write(surviving(compared(open_, unique, block), percent), "candidates left"))
    linked = links(left.join(full, "sid"), percent)
    components = connected_components(linked if found is None else linked.unionByName(found), scratch)

    members = scratch.write(components.join(unique.select(F.col("sid").alias("node"), "set_hash", "doc_id", "text_key"), "node"), "members")
    first = members.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    several = members.join(first, "component").select("set_hash", F.col("first.doc_id").alias("component"), F.col("first.text_key").alias("first_key"))
    alone = unique.where("copies > 1").join(members, "set_hash", "left_anti").select("set_hash", F.col("doc_id").alias("component"), F.col("text_key").alias("first_key"))
    return several.unionByName(alone)


def _prepared(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("text"))


def text_key(text: str) -> Column:
    """Rows are told apart by id and this: null texts are empty ones."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 5, percent: int = 75, block: int = BLOCK, led_from: int = LED, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of df; extra columns, whatever their names, are dropped.

    A-Z are lower-cased, words end at ASCII white space. Documents are linked if their sets of distinct shingles have
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable, kept marks rows of that id.
    Documents with fewer words than a shingle are one shingle; those without words (also null texts) are linked with
    nothing, and are their own component. Rows without a doc_id have no component and are kept. Rows are judged by their
    own text: of rows that repeat an id, equal ones are judged alike, and others belong where their texts do. An empty
    table gives no rows. Texts of any length count whole. The id may be of any orderable type. Full sets are compared by
    64-bit shingle hashes. Buckets of over led_from members are led, the rest of them is compared by blocks of `block`.
    """
    found = judged(_prepared(df, doc_id, text), shingle_words, percent, block, led_from, scratch or Scratch(df.sparkSession))
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 5, percent: int = 75, scratch: Scratch | None = None) -> DataFrame:
    """df with one row of each group of near duplicates: of the smallest id, and of several texts with that id the one with the smallest hash.

    Rows that repeat an id with other texts are judged by their texts, so none goes for another's sake; of rows with
    equal id and text any one stays. Rows without an id, and those without words but for such repeats, stay. All columns
    of df stay as they are, whatever their names; an empty table stays empty; texts of any length count whole.
    """
    scratch = scratch or Scratch(df.sparkSession)
    id_, key, lone = (f"_{uuid.uuid4().hex}" for _ in range(3))
    with Scratch(df.sparkSession) as own:
        found = judged(_prepared(df, doc_id, text), shingle_words, percent, BLOCK, LED, own)
        gone = found.where((F.col("doc_id") != F.col("component")) | (F.col("text_key") != F.col("first_key")))
        gone = scratch.write(gone.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct(), "near duplicates")
    rows = df.select("*", F.col(doc_id).alias(id_), text_key(text).alias(key))
    left = rows.join(gone, [id_, key], "left_anti")
    # rows without an id are told apart, so that they don't count as repeated
    return left.withColumn(lone, F.when(F.col(id_).isNull(), F.monotonically_increasing_id())).dropDuplicates([id_, key, lone]).drop(id_, key, lone)
