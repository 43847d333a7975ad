"""Queries of the text operators, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import boilerplate, chunking, encoding, language, leakage, lookalike, mixing, personal, scans, truncation
from siftline.session import checkpoint, read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.defects(read_table(spark, sf_dir, "text_blocks"))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair(read_table(spark, sf_dir, "text_blocks")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike.same_look_pairs(read_table(spark, sf_dir, "text_blocks"), "block_id")
    return pairs.select(F.col("a").alias("block_id_a"), F.col("b").alias("block_id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookalike.look_classes(read_table(spark, sf_dir, "text_blocks"), "block_id")
    return found.groupBy("look_key").agg(F.min("id").alias("class_id"), F.first("variants").alias("variants"), F.count("*").alias("rows"), F.sum("links").alias("links")).drop("look_key")


def p2_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lookalike.normalise(read_table(spark, sf_dir, "text_blocks").select("block_id", "text").distinct())
    return made.select("block_id", "clean_text", "look_key")


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "text_blocks").where("source_type = 'html'")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.furniture_lines(_html(spark, sf_dir)).distinct()


def p3_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.bodies(_html(spark, sf_dir))


def p3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.expression_texts(_html(spark, sf_dir))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_oversized(read_table(spark, sf_dir, "text_blocks"), read_table(spark, sf_dir, "chunk_limits"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("pieces > 1").select("block_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "text_blocks")).select("rec_table", "rec_id", "lang").distinct()


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.records(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "text_blocks"))
    model = language.fit(found.select(language.label(F.col("label")).alias("lang"), "text"))
    return language.label_texts(found, model, ["rec_table", "rec_id"]).distinct()


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.pieces(read_table(spark, sf_dir, "text_blocks"), read_table(spark, sf_dir, "findings"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpoint(personal.spans(_personal(spark, sf_dir)))
    return personal.accepted(found, personal.fit(found)).select("rec_table", "rec_id", "line_no", "category").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _personal(spark, sf_dir)
    found = checkpoint(personal.spans(texts))
    return personal.redact(texts, found, personal.fit(found))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.texts(read_table(spark, sf_dir, "text_blocks"), read_table(spark, sf_dir, "file_inventory"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decoded(spark, sf_dir)
    return encoding.garbled(found, encoding.fit(found)).select("rec_table", "rec_id").distinct()


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decoded(spark, sf_dir)
    return encoding.garbled(found, encoding.fit(found), restore=True).distinct()


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("item_id", "doc_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("held_words").alias("most_words"), F.max("similarity").alias("best_similarity"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.mark_cut(read_table(spark, sf_dir, "documents")).where("cut").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_rates(truncation.mark_cut(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p2_normalised": p2_normalised,
    "p3_found": p3_found,
    "p3_bodies": p3_bodies,
    "p3_wrappers": p3_wrappers,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_segments": p5_segments,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p7_restored": p7_restored,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}
