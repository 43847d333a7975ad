"""Extraction plans from metadata alone: one strategy a file, and its steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import has_any
from siftline.settings import setting

STEP = "stage string, extractor string, priority int"


def flags(inventory: DataFrame) -> DataFrame:
    """The inventory with the lower-case path and what its words say."""
    low, words = F.lower("path"), setting("planner")
    return inventory.withColumns({"path_low": low, "name_low": F.lower("name"), "suspicious_name": has_any(low, words["suspicious"]), "business_context": has_any(low, words["business"]), "scan_context": has_any(low, words["scan_folders"])})


def ocr_priority() -> Column:
    return F.when(F.col("extension").isin("tif", "tiff"), 10).when(F.col("scan_context") | F.col("suspicious_name"), 15).when(F.col("business_context"), 65).otherwise(40)


def plans(inventory: DataFrame) -> DataFrame:
    """strategy, skip_reason, steps and escalation of each file; the first rule that holds decides."""
    family, ext = F.col("family"), F.col("extension")

    def plan(strategy: str, steps: tuple[tuple[str, str, Column | int], ...] = (), more: tuple[tuple[str, str, Column | int], ...] = (), skip: str | None = None) -> Column:
        def made(items: tuple) -> Column:
            structs = [F.struct(F.lit(s).alias("stage"), F.lit(e).alias("extractor"), (F.lit(p) if isinstance(p, int) else p).cast("int").alias("priority")) for s, e, p in items]
            return F.array(*structs) if structs else F.array().cast(f"array<struct<{STEP.replace(' ', ':')}>>".replace(",:", ","))

        return F.struct(F.lit(strategy).alias("strategy"), F.lit(skip).cast("string").alias("skip_reason"), made(steps).alias("steps"), made(more).alias("escalation"))

    ocr = ocr_priority()
    rules = [
        (F.col("status") == "error", plan("skip", skip="scanner_error")),
        (F.col("size_bytes") == 0, plan("skip", skip="empty_file")),
        (family == "executable", plan("binary_embedded_payload_probe", (("probe", "binary_payload_extractor", 35),))),
        (family == "archive", plan("defer_archive", (("inventory", "archive_inventory", 70),))),
        ((family == "structured") & ext.isin("csv", "tsv"), plan("structured_parse", (("parse", "csv_extractor", 10),))),
        ((family == "structured") & (ext == "json"), plan("structured_parse", (("parse", "json_extractor", 10),))),
        ((family == "structured") & (ext == "parquet"), plan("structured_parse", (("parse", "parquet_extractor", 10),))),
        (family == "structured", plan("structured_parse", (("parse", "structured_extractor", 10),))),
        (family == "web", plan("cheap_text", (("text", "html_text_extractor", 10),))),
        (family == "text", plan("cheap_text", (("text", "plain_text_extractor", 10),))),
        (family == "spreadsheet", plan("table_parse", (("parse", "spreadsheet_extractor", 15),))),
        ((family == "document") & (F.col("mime") == "application/vnd.ms-office"), plan("legacy_office_container", (("text", "legacy_office_extractor", 40),))),
        ((family == "document") & (ext == "pdf"), plan("pdf_text_then_ocr", (("text", "pdf_text_extractor", 10),), (("ocr", "ocr_extractor", ocr),))),
        ((family == "document") & (ext == "docx"), plan("docx_text_then_embedded_ocr", (("text", "docx_text_extractor", 10),), (("ocr", "embedded_image_ocr_extractor", ocr),))),
        ((family == "document") & (ext == "rtf"), plan("cheap_text", (("text", "rtf_text_extractor", 20),))),
        ((family == "document") & (ext == "doc"), plan("office_conversion", (("text", "legacy_doc_extractor", 35),))),
        (family == "document", plan("generic_document", (("text", "document_extractor", 50),))),
        (family == "presentation", plan("presentation_text_then_embedded_ocr", (("text", "presentation_text_extractor", 25),), (("ocr", "embedded_image_ocr_extractor", ocr),))),
        ((family == "image") & (F.col("size_bytes") < setting("planner.small_image_bytes")) & ~F.col("suspicious_name"), plan("skip", skip="tiny_image")),
        (family == "image", plan("image_prefilter_then_ocr", (("prefilter", "image_prefilter", 15),), (("ocr", "ocr_extractor", ocr),))),
        (family == "video", plan("video_sparse_frame_ocr", (("metadata", "video_metadata", 40),), (("ocr", "ocr_extractor", ocr),))),
        (~F.coalesce("is_binary", F.lit(False)), plan("cautious_text_fallback", (("text", "plain_text_extractor", 60),))),
    ]
    chain = F
    for holds, made in rules:
        chain = chain.when(F.coalesce(holds, F.lit(False)), made)
    warnings = F.array_compact(F.array(F.when(F.col("size_bytes").between(1, setting("planner.tiny_bytes")), F.lit("tiny_file")), F.when(F.col("confidence") < setting("planner.low_confidence"), F.lit("low_confidence"))))
    return flags(inventory).withColumn("_p", chain.otherwise(plan("manual_review_or_custom_extractor"))).select("*", "_p.*", warnings.alias("plan_warnings")).drop("_p")


def ordered_steps(planned: DataFrame, escalate: bool) -> DataFrame:
    """(path, k, stage, extractor, priority): steps in the order in which they run."""
    steps = F.concat("steps", "escalation") if escalate else F.col("steps")
    placed = F.array_sort(F.transform(steps, lambda s, k: F.struct(s["priority"].alias("priority"), k.alias("k"), s["stage"].alias("stage"), s["extractor"].alias("extractor"))))
    return planned.where("skip_reason is null").select("path", F.posexplode(placed).alias("k", "s")).select("path", "k", "s.stage", "s.extractor", "s.priority")
