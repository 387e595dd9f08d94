"""Audit of how filters interact, by direct relational replay: each document's flags meet all orders in which filters can run.

Flags are made in one pass over the texts; what goes on is an id, a digest and flags. Documents' flags are crossed with a
broadcast table of the orders (120 for five filters), the step at which a document first fails is computed for each, the
steps are exploded, and what they keep, remove and find redundant is aggregated, combined within each task before the
shuffle: that holds parts x orders x steps rows of a task at most, so no part is hot.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Texts of more copies than this are looked up, if they are at most so many (some megabytes); other texts are joined.
HOT_COPIES, MOST_HOT = 1000, 100_000
WHITE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_flags(text: Column) -> dict[str, Column]:
    """What the filters A to D find in a text, itself."""
    words = F.array_remove(F.split(text, WHITE), "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": F.rlike(text, F.lit(r"[#$%&*|]")),
    }


def flagged(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", part: str = "source", hot_copies: int = HOT_COPIES, most_hot: int = MOST_HOT) -> DataFrame:
    """(doc_id, part, A, B, C, D, E) for each row. E: the text is that of a smaller doc_id, anywhere in the table; rows without an id are neither.

    Texts are read once; what is kept of them is a digest. Copies are counted within tasks before they are shuffled. Rows
    of a text with very many copies meet its smallest id by a broadcast of such texts, whose number is counted first, and
    are dealt out by id in the join of the others.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *[c.alias(k) for k, c in own_flags(F.col("text")).items()])
    rows = scratch.write(rows, "flags")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("copies")).where("first_id < last_id")
    first = scratch.write(first.select("digest", "first_id", "copies"), "first of each text")
    hot = first.where(F.col("copies") > hot_copies).select("digest", F.col("first_id").alias("hot_id"))
    if hot.limit(most_hot + 1).count() <= most_hot:
        rows = rows.join(F.broadcast(hot), "digest", "left").withColumn("deal", F.when(F.col("hot_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.lit(0)))
    else:
        rows = rows.withColumn("hot_id", F.lit(None).cast(docs.schema[doc_id].dataType)).withColumn("deal", F.lit(0).cast("long"))
    joined = rows.join(first.select("digest", F.lit(0).cast("long").alias("deal"), "first_id"), ["digest", "deal"], "left")
    return joined.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.coalesce("hot_id", "first_id") < F.col("doc_id"), F.lit(False)).alias("E"))


def replay(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, ..., shapley) of rows (part, a boolean for each filter, good, toxic).

    Each part has a row for every order of the filters and every step, zeros included; an empty table gives no rows. The
    orders are n! for n filters, up to six.
    """
    if not 1 <= len(filters) <= 6 or len(set(filters)) != len(filters):
        raise ValueError("one to six different filters")
    steps = len(filters)
    orders = flags.sparkSession.createDataFrame([("".join(o), [filters.index(f) for f in o]) for o in permutations(filters)], "filter_order string, filter_at array<int>")
    bits = F.array(*[F.coalesce(F.col(f), F.lit(False)) for f in filters])
    fails = F.aggregate(F.array(*[F.coalesce(F.col(f), F.lit(False)).cast("int") for f in filters]), F.lit(0), lambda a, b: a + b)
    crossed = flags.select("part", bits.alias("bits"), fails.alias("fails"), "good", "toxic").crossJoin(F.broadcast(orders))
    ordered = [F.get("bits", F.get("filter_at", F.lit(k))) for k in range(steps)]
    first = F.coalesce(*[F.when(b, k + 1) for k, b in enumerate(ordered)], F.lit(steps + 1))
    each = crossed.select("part", "filter_order", "fails", "good", "toxic", first.alias("first"), F.posexplode(F.array(*ordered)).alias("at", "failed"))
    step = F.col("at") + 1
    removed = F.col("first") == step
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    counted = each.groupBy("part", "filter_order", step.alias("step")).agg(
        count(F.col("first") > step).alias("kept"),
        count(removed).alias("removed"),
        count(F.col("failed") & (F.col("first") < step)).alias("redundant"),
        count(F.col("failed") & (F.col("fails") == 1)).alias("unique_fails"),
        count(removed & F.col("good")).alias("good_lost"),
        count(removed & F.col("toxic")).alias("toxic_lost"),
    )
    named = counted.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    shares = named.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return named.join(shares, ["part", "filter"]).select("part", "filter_order", "step", "filter", *COUNTS, "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", scratch: Scratch | None = None, hot_copies: int = HOT_COPIES) -> DataFrame:
    """What each of the filters A to E does at each step of each of their 120 orders, by part; see replay.

    A: under 50 words. B: fewer distinct words than 65 %. C: more capital letters A-Z than 5 % of the code points. D: one
    of `#$%&*|`. E: the text of a smaller doc_id, whether that is removed or not. Null texts are empty (and fail A); null
    parts are the empty string. Rows are documents, repeated or not; a repeated row isn't its own predecessor. Labels with
    the same id count once each way: good if one says quality 1, toxic if one says toxic 1; those without an id are of no document. Texts of any length count
    whole; further columns are ignored; an empty table gives no rows.
    """
    said = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = flagged(docs, scratch or Scratch(docs.sparkSession), doc_id, text, part, hot_copies).join(said, "doc_id", "left")
    return replay(joined.select("part", *FILTERS, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))
