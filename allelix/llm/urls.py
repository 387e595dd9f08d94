"""URL filters: host-suffix and path-prefix expressions, found by short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, without

#: Up to so many rules, their table is broadcast: below 100 MB at 500 bytes a rule.
MOST_BROADCAST = 200_000


def host_of(url: Column) -> Column:
    """From after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, url)
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host up to ? # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, url)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def directory(path: Column) -> Column:
    """The path up to its last /: what a rule's path and every path that it begins have in common."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def key_prefix(host: Column, path: Column, hex_digits: int) -> Column:
    return F.substring(F.sha2(F.concat(host, F.lit("\n"), path), 256), 1, hex_digits)


def expressions(host: Column, path: Column, labels: int, directories: int) -> Column:
    """Structs (suffix, start) of a URL: its last 1 to `labels` host labels, each with the first 0 to `directories` directories of its path."""
    named = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(named) - (labels - 1)), F.size(named)), lambda k: F.array_join(F.slice(named, k, F.size(named)), "."))
    parts = F.split(directory(path), "/", directories + 1)  # the last part is what no rule's directories reach
    starts = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.when(k > 0, "/").otherwise("")))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.struct(h.alias("suffix"), p.alias("start")))))


def prepared(rules: DataFrame, hex_digits: int) -> DataFrame:
    """Rules with their join key, digest and length. Rules with nulls fit nothing; of equal rules that differ, block wins."""
    host = ascii_lower(F.col("host"))
    one = rules.where("host is not null and path is not null and verdict is not null").groupBy(host.alias("r_host"), F.col("path").alias("r_path"))
    return one.agg(F.max("verdict").alias("r_verdict")).select(
        "r_host", "r_path", "r_verdict",
        F.concat("r_host", "r_path").alias("r_rule"),
        key_prefix(F.col("r_host"), directory(F.col("r_path")), hex_digits).alias("key"),
        F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256).alias("r_digest"),
    )


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", hex_digits: int = 8, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Every row of df with host, path, rule and verdict ("allow" or "block").

    rules: (host, path, verdict). A rule fits its host and all subdomains if the URL's path starts with its path; the
    longest host and path together win, then the longer host. Without a fitting rule, rule is null and verdict the
    default. Null URLs and those without :// have an empty host and path. Repeated rows stay; columns of df that clash
    with an output are replaced. A URL is tried under each host suffix and each directory of its path: the first hex
    digits of the expression's SHA-256 are joined with those of the rules, and what meets is kept only if the full
    digest of the rule equals that of the URL's own suffix and prefix of the rule's length. Suffixes of more labels and
    paths of more directories than any rule has can fit none and aren't made, so a very long URL makes no more
    expressions than a short one. Without rules every row gets the default; an empty table gives no rows.

    Up to most_broadcast rules are broadcast (counted first). Beyond, both sides are shuffled by the key, which holds
    the expressions of a hot host together: they are then joined once for each distinct host and path.
    """
    own = ["host", "path", "rule", "verdict"]
    rest = without(df, own)
    known = prepared(rules, hex_digits)
    depth = known.agg(F.count("*").alias("rules"), F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.max(F.regexp_count("r_path", F.lit("/"))).alias("directories")).first()
    few, deepest = depth["rules"] <= most_broadcast, (depth["labels"] or 1, depth["directories"] or 0)
    parsed = df.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if few:
        rows = parsed.select(F.struct(*rest, "host", "path").alias("row"), "host", "path", F.monotonically_increasing_id().alias("id"))
        best = best_rule(rows, F.broadcast(known), hex_digits, deepest, ["id"], [F.first("row").alias("row")])
        return best.select("row.*", F.col("best.r_rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
    judged = Scratch(df.sparkSession).write(best_rule(parsed.select("host", "path").distinct(), known, hex_digits, deepest, ["host", "path"], []), "judged urls")
    joined = parsed.join(judged, ["host", "path"])
    return joined.select(*rest, "host", "path", F.col("best.r_rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


def best_rule(urls: DataFrame, known: DataFrame, hex_digits: int, deepest: tuple[int, int], by: list[str], more: list[Column]) -> DataFrame:
    """For each row of urls, `best`: the winning rule or null. Expressions are folded into one row before any shuffle."""
    tried = urls.select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), *deepest)).alias("e"))
    tried = tried.withColumn("key", key_prefix(F.col("e.suffix"), F.col("e.start"), hex_digits))
    own_digest = F.sha2(F.concat("e.suffix", F.lit("\n"), F.expr("left(path, length(r_path))")), 256)
    fits = F.col("r_digest").isNotNull() & (own_digest == F.col("r_digest"))
    rank = F.struct(F.length("r_rule").alias("n"), F.length("r_host").alias("n_host"), "r_rule", "r_verdict")
    return tried.join(known, "key", "left").groupBy(*by).agg(F.max(F.when(fits, rank)).alias("best"), *more)
