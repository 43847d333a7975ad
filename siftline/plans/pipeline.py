"""The whole scan of a folder: inventory, plans, selection, extraction, findings, scores, and what is written."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.operators import detect, entities, formats, planner, risk, triage
from siftline.session import checkpoint
from siftline.settings import setting
from siftline.sources import files
from siftline.sources.recognition import Engine


@dataclass
class Scan:
    """The tables of a scan."""

    inventory: DataFrame
    plans: DataFrame
    chosen: DataFrame
    blocks: DataFrame
    findings: DataFrame
    assessed: DataFrame


def typed_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with the columns that scoring looks at. Whether a payload looks like a document is told by its recognised text; payloads are not recognised."""
    return blocks.withColumns({
        "block_id": F.xxhash64("file_path", "block_index", "extraction_method"), "ocr": F.col("source_type") == "ocr", "embedded_payload": F.exists("warnings", lambda w: w.startswith("embedded")),
        "embedded_document_like": F.lit(False),
    })


def to_recognise(planned: DataFrame, read: DataFrame) -> DataFrame:
    """Plans (path) whose pictures are worth recognising after what was read of them without: by name, folder and kind."""
    seen = read.groupBy("file_path").agg(F.bool_or(F.trim("text") != "").alias("has_text"), F.bool_or(F.array_contains("warnings", "empty page")).alias("empty_page"))
    joined = planned.join(seen.withColumnRenamed("file_path", "path"), "path", "left")
    archive = F.col("path_low").contains("архив сканы")
    bare, marked = ~F.coalesce("has_text", F.lit(False)), F.col("suspicious_name") | F.col("scan_context")
    wanted = (
        F.when(F.col("family") == "image", archive | F.col("extension").isin("tif", "tiff") | F.col("suspicious_name")).when(F.col("extension") == "pdf", (bare | F.coalesce("empty_page", F.lit(False))) & (marked | bare))
        .when(F.col("family") == "video", marked | (F.col("extension") == "mp4")).otherwise(marked | bare)
    )
    return joined.where(F.coalesce(wanted, F.lit(False))).select("path")


def scan_folder(
    spark: SparkSession, root: str, mode: str = "fast", most: int | None = None, *, engine: Engine | None = None, model: entities.Model | None = None, ocr_files: int | None = None, ml_files: int | None = None, extract_limit: int | None = None, recognise: bool | None = None
) -> Scan:
    """Scan every file below ``root``. Contents are read in tasks by path: a head for the format, all of what the selection takes.

    Where the mode escalates (or ``recognise`` says so), pictures of the best files within the OCR budget are recognised
    after the rest is read. ``extract_limit`` keeps so many files in the order of selection; ``model`` finds names.
    """
    inventory = checkpoint(formats.detect_format(files.heads(files.listing(spark, root), formats.SAMPLE_BYTES)))
    planned = planner.plans(inventory)
    scored = triage.scored(planned, mode)
    settings = setting(f"modes.{mode}")
    if mode == "fast":
        chosen = scored.withColumn("reason", triage.fast_reason()).withColumn("include", F.col("reason").startswith("include") & F.col("skip_reason").isNull())
    else:
        total = most or settings["max_candidates"]
        chosen = triage.select(scored, triage.scaled_caps(mode, total), total, settings["min_score"])
    chosen = checkpoint(chosen)
    taken = chosen.where("include")
    if extract_limit is not None:
        taken = taken.orderBy(F.desc("triage_score"), "path").limit(extract_limit)
    names = inventory.select("path", "name")
    made = checkpoint(files.extract(planner.ordered_steps(taken, False).select("path", "extractor").join(names, "path")))
    if settings["escalate"] if recognise is None else recognise:
        best = triage.ocr_budget(taken, setting("limits.ocr_files") if ocr_files is None else ocr_files).select("path")
        steps = taken.join(best, "path", "left_semi").join(to_recognise(taken, made), "path", "left_semi").select("path", F.explode("escalation.extractor").alias("extractor"))
        made = made.unionByName(files.extract(steps.join(names, "path"), engine))
    # Extractors may give several blocks of one number to a file; they are numbered anew in the order of the steps.
    order = Window.partitionBy("file_path").orderBy("extraction_method", "block_index")
    blocks = checkpoint(typed_blocks(made.withColumn("block_index", (F.row_number().over(order) - 1).cast("int"))))
    found = detect.detect(blocks.select("block_id", "file_path", "block_index", "extraction_method", "text"))
    if model is not None:
        found = found.unionByName(entities.detect_entities(blocks, model, ml_files), allowMissingColumns=True)
    findings = checkpoint(found.withColumn("finding_id", F.xxhash64("block_id", "category", "detector")))
    assessed = risk.assess(risk.features(planned, findings, blocks), mode=mode).withColumn("submit_path", risk.submit_path(F.col("file_path"), root))
    return Scan(inventory, planned, chosen, blocks, findings, checkpoint(assessed))


def write_submit(assessed: DataFrame, path: str | Path, threshold: float | None = None) -> int:
    """The submit paths from the threshold on, sorted, one a line; an empty file if there are none."""
    least = setting("risk.submit") if threshold is None else threshold
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    count = 0
    with Path(path).open("w", encoding="utf-8") as file:  # a partition at a time
        for row in assessed.where(F.col("score") >= least).select("submit_path").orderBy("submit_path").toLocalIterator():
            file.write(f"{row[0]}\n")
            count += 1
    return count
