"""Searches that are kept: a search is written once, and charts and exports of the same user read it by its token.

A kept search is a table in buckets by variant_id, and so are the variants and genotypes of a kept dataset. Tables with as
many buckets meet without a shuffle, so a chart of a kept search shuffles no genotypes to find those of its variants, nor
to bring a variant's genotypes together.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.dataset import Dataset
from .execution import Selection, chart, selected_variants, selection
from .requests import ChartRequest, SearchRequest


class TokenNotFound(LookupError):
    """No search is kept under a token; the user has to search again."""


def table_name(kind: str, token: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_]{1,100}", token):
        raise ValueError("tokens are letters, digits and underscores")
    return f"{kind}_{token.lower()}"


def write_buckets(df: DataFrame, name: str, buckets: int) -> None:
    """A table in sorted buckets by variant_id, one file each."""
    df.repartition(buckets, "variant_id").write.bucketBy(buckets, "variant_id").sortBy("variant_id").mode("overwrite").format("parquet").saveAsTable(name)


def keep_dataset(data: Dataset, name: str, buckets: int | None = None) -> Dataset:
    """The dataset with its variants and genotypes as tables in buckets, which replace those of that name."""
    spark = data.variants.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for kind, df in (("variants", data.variants), ("genotypes", data.genotypes)):
        write_buckets(df, table_name(kind, name), buckets)
    return kept_dataset(data, name)


def kept_dataset(data: Dataset, name: str) -> Dataset:
    """A dataset that was kept under a name; the small tables are those of data."""
    spark = data.people.sparkSession
    missing = [t for t in (table_name("variants", name), table_name("genotypes", name)) if not spark.catalog.tableExists(t)]
    if missing:
        raise TokenNotFound(f"no dataset is kept as {name}")
    return replace(data, variants=spark.table(table_name("variants", name)), genotypes=spark.table(table_name("genotypes", name)), placed=True)


def keep_search(data: Dataset, request: SearchRequest, token: str, samples: bool = False, buckets: int | None = None) -> int:
    """Write what a request finds under a user's token, in the place of what was there; how many variants these are."""
    spark = data.variants.sparkSession
    name = table_name("search", token)
    write_buckets(selected_variants(data, request, samples), name, buckets or buckets_of(data) or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.table(name).count()


def buckets_of(data: Dataset) -> int | None:
    """How many buckets a kept dataset's tables have."""
    if not data.placed:
        return None
    files = data.genotypes.inputFiles()
    numbers = {m[1] for f in files if (m := re.search(r"_(\d{5})(?:\.c\d+)?\.[^/]*$", f))}
    described = max((int(n) for n in numbers), default=-1) + 1
    return described or None


def kept_search(spark: SparkSession, token: str) -> DataFrame:
    name = table_name("search", token)
    if not spark.catalog.tableExists(name):
        raise TokenNotFound(f"temporary records of token {token} not found: search again")
    return spark.table(name)


def chart_of_kept(data: Dataset, token: str, request: ChartRequest, statistic: str, samples: bool = False) -> DataFrame:
    """A chart of a kept search: of the request, only what it shows and whose genotypes, not which variants it finds."""
    return chart(data, request, statistic, samples, kept_search(data.people.sparkSession, token))


def selection_of_kept(data: Dataset, token: str, request: SearchRequest = SearchRequest(), samples: bool = False) -> Selection:
    """What an export of a kept search takes."""
    return selection(data, request, samples, kept_search(data.people.sparkSession, token))


def forget(spark: SparkSession, token: str) -> None:
    """Drop a kept search; nothing happens if there is none."""
    spark.sql(f"DROP TABLE IF EXISTS {table_name('search', token)}")


def forget_dataset(spark: SparkSession, name: str) -> None:
    for kind in ("variants", "genotypes"):
        spark.sql(f"DROP TABLE IF EXISTS {table_name(kind, name)}")


def page_of_kept(spark: SparkSession, token: str, number: int, size: int, by: str = "variant_id") -> DataFrame:
    """A page of a kept search."""
    return kept_search(spark, token).orderBy(F.col(by), "variant_id").offset(number * size).limit(size)
