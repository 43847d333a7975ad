"""Incremental scans: blocks as a stream, findings per file kept up to date.

Detectors are stateless, so a stream runs them as a batch does. ``findings_stream`` drops repeated deliveries within a
watermark and is appended to as it comes; ``keep_totals`` sums a stream by file and category in its state.
Selections under global caps need the whole inventory and belong in foreachBatch (see ``each_batch``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siftline.operators.detect import detect


def blocks_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """New parquet files of text blocks in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def findings_stream(blocks: DataFrame, late: str = "7 days", only: tuple[str, ...] = ()) -> DataFrame:
    """Findings of a stream of blocks; a block delivered again within the watermark counts once."""
    first = blocks.withWatermark("extracted_at", late).dropDuplicatesWithinWatermark(["block_id"])
    return detect(first.select("block_id", "file_path", "block_index", "extracted_at", "text"), only=only)


def keep_totals(findings: DataFrame) -> DataFrame:
    """Running totals by file and category, for the update or complete output mode."""
    return findings.groupBy("file_path", "category").agg(F.sum("count").alias("total"))


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``work`` on each batch, once for all that is there now; ``checkpoint`` is on shared storage."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
