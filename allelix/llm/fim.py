"""Fill-in-the-middle transformation by relational units: offsets come from exploded matches, window sums and a join, texts are cut once.

The matches of a unit's pattern are exploded with their ordinals, a window sums up their lengths, and a document's cut
requests (after how many units) meet the unit that ends there, which gives offsets; these are aggregated per document,
and substrings cut the text. Units of one code point need no row each: a row is then a match of up to `run` of them, and a
request finds its row by division. What is exploded and summed up is lengths; texts are shuffled once, to meet their offsets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import without

#: Fixed marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: So many code points are one row at most.
RUN = 4096
OWN = ("n", "form", "prefix_chars", "middle_chars", "output")


def drawn(doc_id: Column, k: int) -> Column:
    """The k-th number (from 0) of a document: a group of eight hexadecimal digits of sha256 of `1:` and its id."""
    digest = F.sha2(F.concat(F.lit("1:"), doc_id.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def form_of(doc_id: Column, text: Column, plain_from: int, spm_below: int) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = doc_id.isNull() | (F.length(text) == 0) | marked | (drawn(doc_id, 2) % 100 >= plain_from)
    return F.when(plain, "plain").when(drawn(doc_id, 3) % 100 < spm_below, "spm").otherwise("psm")


def covering(unit: str) -> str:
    """A pattern whose matches cover a text: each unit with what no unit covers before it, and what follows the last."""
    return f"(?s).*?(?:{unit})|.+"


def unit_count(text: Column, unit: str | None) -> Column:
    return F.length(text) if unit is None else F.regexp_count(text, F.lit(covering(unit)))


def unit_lengths(text: Column, unit: str | None, run: int) -> Column:
    """The lengths, in code points, of all matches: of single units, or of runs of code points."""
    pattern = f"(?s).{{1,{run}}}" if unit is None else covering(unit)
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)


def cut_offsets(texts: DataFrame, unit: str | None, run: int) -> DataFrame:
    """(id, key, first, second): of texts (id, key, text, n), the code points before the two cuts; 0 is left out or null."""
    by = ["id", "key"]
    # rows of equal id and text count once, before they are exploded
    lengths = texts.select(*by, unit_lengths(F.col("text"), unit, run).alias("lengths")).groupBy(*by).agg(F.first("lengths").alias("lengths"))
    matches = lengths.select(*by, F.posexplode("lengths").alias("ordinal", "chars"))
    before = Window.partitionBy(*by).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    units = matches.select(*by, "ordinal", "chars", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("start"))

    drawn_cuts = [drawn(F.col("id"), k) % (F.col("n") + 1) for k in (0, 1)]
    cuts = F.array(F.struct(F.lit(1).alias("which"), F.least(*drawn_cuts).alias("after")), F.struct(F.lit(2).alias("which"), F.greatest(*drawn_cuts).alias("after")))
    requests = texts.select(*by, F.explode(cuts).alias("cut")).select(*by, "cut.which", "cut.after").where("after > 0").distinct()
    per_row = run if unit is None else 1
    requests = requests.withColumn("ordinal", F.floor((F.col("after") - 1) / per_row).cast("int"))  # the row of the unit that ends at the cut
    whole = F.col("start") + (F.col("chars") if unit else F.col("after") - F.col("ordinal").cast("long") * run)
    met = requests.join(units, [*by, "ordinal"])
    return met.groupBy(*by).agg(*[F.max(F.when(F.col("which") == k, whole)).alias(name) for k, name in ((1, "first"), (2, "second"))])


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str | None = None, plain_from: int = 90, spm_below: int = 20, run: int = RUN) -> DataFrame:
    """df with n, form, prefix_chars, middle_chars and output, which replace columns of these names.

    A text of n units is cut after two drawn numbers of units (0 to n each) into prefix, middle and suffix; a unit is a code
    point, or a match of the pattern `unit` (which matches no empty text) with what stands between it and the match
    before; what follows the last match is one more. Matching goes from left to right. Form: `plain` for empty texts and those
    with a mark, for rows without an id, and where the third number drawn, modulo 100, is plain_from or more; else `spm`
    where the fourth is below spm_below, else `psm`. output is the text, or its parts with marks. prefix_chars and
    middle_chars are code points, null if plain. Null texts are empty. Numbers come from the id alone, so rows that repeat
    an id with equal length are cut alike, whatever their order; each row stays. An empty table gives no rows. Texts of
    any length are cut whole.
    """
    id_, key, whole, one, two = (f"_{uuid.uuid4().hex}" for _ in range(5))
    kept = without(df, OWN)
    filled = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*[df[c] for c in kept], F.col(doc_id).alias(id_), F.xxhash64(filled).alias(key), filled.alias(whole))
    if text in kept:  # one copy of each text is shuffled; whether it was null comes back with its hash
        rows = rows.withColumn(text, F.when(F.col(text).isNotNull(), F.lit(True)))
    rows = rows.withColumn("form", form_of(F.col(id_), F.col(whole), plain_from, spm_below)).withColumn("n", unit_count(F.col(whole), unit).cast("long"))
    texts = rows.where("form <> 'plain'").select(F.col(id_).alias("id"), F.col(key).alias("key"), F.col(whole).alias("text"), "n")
    offsets = cut_offsets(texts, unit, run).select(F.col("id").alias(id_), F.col("key").alias(key), F.col("first").alias(one), F.col("second").alias(two))
    # offsets are small beside their texts, so each task hashes its share of them, and texts needn't be sorted
    joined = rows.join(offsets.hint("shuffle_hash"), [id_, key], "left")
    first, second, body = F.coalesce(one, F.lit(0)), F.coalesce(two, F.lit(0)), F.col(whole)
    prefix, middle, suffix = F.substring(body, F.lit(1), first), F.substring(body, first + 1, second - first), F.substring(body, second + 1, F.length(body))
    is_plain = F.col("form") == "plain"
    output = F.when(is_plain, body).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(
        F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    )
    back = [F.when(F.col(c).isNotNull(), body).alias(c) if c == text else F.col(c) for c in kept]
    return joined.select(
        *back, "n", "form", F.when(~is_plain, first.cast("long")).alias("prefix_chars"), F.when(~is_plain, (second - first).cast("long")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text, from what fill_in_middle put out. Texts hold no mark, so each mark's first place is its own."""

    def split(marks: tuple[str, str]) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(4), F.length(output))
        one = F.substring_index(body, marks[0], 1)
        rest = F.substring(body, F.length(one) + 4, F.length(body))
        two = F.substring_index(rest, marks[1], 1)
        return one, two, F.substring(rest, F.length(two) + 4, F.length(rest))

    prefix, suffix, middle = split((SUFFIX, MIDDLE))
    suffix_, prefix_, middle_ = split((PREFIX, MIDDLE))
    return F.when(form == "plain", output).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(F.concat(prefix, middle, suffix))
