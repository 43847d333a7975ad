"""Aggregates of findings, blocks, plans and assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, at: str = "loaded_at") -> DataFrame:
    """The last delivery of each record."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(at))
    return df.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def file_categories(findings: DataFrame) -> DataFrame:
    """(file_path, category, count, first): summed counts, and where the category first appears in the file."""
    return findings.groupBy("file_path", "category").agg(F.sum(F.col("count").cast("bigint")).alias("count"), F.min(F.struct("block_index", "finding_id")).alias("first"))


def file_summary(findings: DataFrame) -> DataFrame:
    """(file_path, total_count, categories, blocks_with_pii): categories by count, ties by first appearance."""
    by = file_categories(findings).groupBy("file_path").agg(
        F.sum("count").alias("total_count"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), F.col("first"), F.col("category"), F.col("count")))), lambda x: F.struct(x["category"].alias("category"), x["count"].alias("count"))).alias("categories"),
    )  # a file has no more categories than there are
    blocks = findings.groupBy("file_path").agg(F.count_distinct("block_index").alias("blocks_with_pii"))
    return by.join(blocks, "file_path")


def counter(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows by key."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def drop_repeats(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows without empty values and without those equal to the row before in the same group."""
    window = Window.partitionBy(*keys).orderBy(*order)
    held = df.where(F.col(value).isNotNull() & (F.col(value) != ""))
    return held.withColumn("_before", F.lag(value).over(window)).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def hint_sums(blocks: DataFrame) -> DataFrame:
    """(file_path, hint, n): table hints summed over a file; mentions of physical persons are added to their rows."""
    hints = blocks.where("table_semantic_hints is not null").select("file_path", F.explode("table_semantic_hints").alias("hint", "n"))
    persons = blocks.where("coalesce(physical_person_mentions, 0) <> 0").select("file_path", F.lit("physical_person_rows").alias("hint"), F.col("physical_person_mentions").alias("n"))
    return hints.unionByName(persons).groupBy("file_path", "hint").agg(F.sum(F.col("n").cast("bigint")).alias("n"))


def block_flags(blocks: DataFrame) -> DataFrame:
    """(file_path, ocr_used, embedded_document, blocks, chars, with_text, warnings) of each file; from texts, or from their ``chars`` and ``filled``."""
    if "chars" not in blocks.columns:
        blocks = blocks.withColumns({"chars": F.length("text").cast("bigint"), "filled": F.trim("text") != ""})
    return blocks.groupBy("file_path").agg(
        F.coalesce(F.bool_or("ocr"), F.lit(False)).alias("ocr_used"),
        F.coalesce(F.bool_or(F.col("embedded_payload") & F.col("embedded_document_like")), F.lit(False)).alias("embedded_document"),
        F.count("*").alias("blocks"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
        F.coalesce(F.bool_or("filled"), F.lit(False)).alias("with_text"),
        F.sum(F.coalesce(F.size("warnings"), F.lit(0)).cast("bigint")).alias("warnings"),
    )


def ner_quota(blocks: DataFrame, files: int, per_file: int) -> DataFrame:
    """The first blocks of the first files that are worth the costly detector: no tables, in input order; blank ones count."""
    worth = blocks.where("source_type not in ('table', 'json', 'workbook')")
    own = Window.partitionBy("file_path").orderBy("block_index", "block_id")
    ranked = worth.withColumn("k", F.row_number().over(own)).where(F.col("k") <= per_file)
    # Only the wanted number of files is kept on each task before they are ranked.
    chosen = worth.groupBy("file_path").agg(F.min("block_id").alias("first")).orderBy("first", "file_path").limit(files).select("file_path")
    return ranked.join(chosen, "file_path", "left_semi")
