"""Window statistics kept up to date while files of variants arrive, by Structured Streaming's own state.

Windows are ranges of positions, not of time: nothing is ever late, so there is no watermark, and the state is one
counter a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.windows import Bins


def arriving(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def running_density(variants: DataFrame, bins: Bins) -> DataFrame:
    """(bin_start, variants) so far; windows that are still empty are left out."""
    return bins.binned(variants).groupBy("bin_start").agg(F.count("*").alias("variants"))


def running_call_rate(genotypes: DataFrame) -> DataFrame:
    """(variant_id, called, seen) so far."""
    return genotypes.groupBy("variant_id").agg(F.count("gt").alias("called"), F.count("*").alias("seen"))


def keep_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Replace the table at `path` by the result after each batch that changes it; stops when all present files are read."""

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return df.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
