"""The engine's own queries over the tables, by name; each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import checks, masks, text
from siftline.operators import aggregate, detect, formats, planner, risk, rows, triage
from siftline.plans import reports
from siftline.session import read_table
from siftline.settings import setting

Query = Callable[[SparkSession, str], DataFrame]


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    """One row a file, without repeated deliveries."""
    return read_table(spark, sf, "file_inventory").drop("loaded_at", "details").distinct()


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "findings").distinct()


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "text_blocks").drop("loaded_at", "extra", "extracted_at").dropDuplicates(["block_id"])


def _assessed(spark: SparkSession, sf: str) -> DataFrame:
    """The last assessment of each file."""
    best = read_table(spark, sf, "assessments").groupBy("file_path").agg(F.max(F.struct("assessed_at", "assessment_id")).alias("top"))
    own = read_table(spark, sf, "assessments").dropDuplicates(["assessment_id"])
    return own.join(best.select(F.col("top.assessment_id").alias("assessment_id")), "assessment_id", "left_semi")


def _keyed(spark: SparkSession, sf: str, digits: int) -> DataFrame:
    """Numbers of so many digits made from order keys."""
    key = F.col("o_orderkey") * 7919 % F.lit(10**digits)
    return read_table(spark, sf, "orders").select("o_orderkey", F.lpad(key.cast("string"), digits, "0").alias("v"))


def findings_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.file_summary(_findings(spark, sf)).select("file_path", "total_count", "blocks_with_pii", F.size("categories").alias("n_categories"))


def categories_ordered(spark: SparkSession, sf: str) -> DataFrame:
    ranked = aggregate.file_summary(_findings(spark, sf)).select("file_path", F.posexplode("categories").alias("k", "c"))
    return ranked.select("file_path", "k", "c.category", "c.count")


def pii_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).groupBy("category").agg(F.sum(F.col("count").cast("long")).alias("total"), F.count_distinct("file_path").alias("files"), F.count("*").alias("findings"))


def top_files(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.file_summary(_findings(spark, sf)).orderBy(F.desc("total_count"), "file_path").limit(10).select("file_path", "total_count")


def finding_examples(spark: SparkSession, sf: str) -> DataFrame:
    shown = _findings(spark, sf).select("finding_id", F.explode("examples").alias("example")).groupBy("finding_id").agg(F.count("*").alias("examples"), F.count_distinct("example").alias("distinct_examples"))
    return shown


def base_scores(spark: SparkSession, sf: str) -> DataFrame:
    by = aggregate.file_categories(_findings(spark, sf))
    return by.groupBy("file_path").agg(F.round(F.sum(risk.base_score(F.col("category"), F.col("count"))), 4).alias("base"))


def findings_by_family(spark: SparkSession, sf: str) -> DataFrame:
    files = _inventory(spark, sf).select(F.col("path").alias("file_path"), "family").dropDuplicates(["file_path"])
    return _findings(spark, sf).join(files, "file_path", "left").groupBy("family", "category").agg(F.sum(F.col("count").cast("long")).alias("total"))


def only_by_model(spark: SparkSession, sf: str) -> DataFrame:
    found = _findings(spark, sf)
    regular = found.where("detector like 'regex%'").select("block_id", "category").distinct()
    return found.where("detector like 'ner:%'").join(regular, ["block_id", "category"], "left_anti").select("finding_id", "block_id", "category")


def check_digits(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select("o_orderkey")
    kinds = [(11, "is_snils"), (10, "is_inn_legal"), (12, "is_inn_person"), (16, "is_luhn")]
    each = F.array(*(F.struct(F.lit(name).alias("kind"), checks.CHECKS[name](F.lpad((F.col("o_orderkey") * 7919 % F.lit(10**n)).cast("string"), n, "0")).alias("valid")) for n, name in kinds))
    return orders.select("o_orderkey", F.explode(each).alias("x")).select("o_orderkey", "x.kind", "x.valid")


def masked_values(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    address = F.concat(F.lit("user"), F.col("o_orderkey").cast("string"), F.lit("@mail.test"))
    return _keyed(spark, sf, 16).select("o_orderkey", masks.email(address).alias("email"), masks.number(v).alias("number"), masks.ends(6, 4)(v).alias("card"), masks.snils(F.substring(v, 1, 11)).alias("snils"), masks.passport(v).alias("passport"), masks.every_digit(F.lit("12.03.1985")).alias("birth_date"), masks.initials(F.lit("Anna Maria Berg")).alias("name"))


def synthetic_findings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    pad = lambda n: F.lpad((k % F.lit(10**n)).cast("string"), n, "0")
    line = F.concat(F.lit("Дата рождения: 12.03.1985, БИК 04"), pad(7), F.lit(" CVV "), pad(3), F.lit(" тел. 8 9"), pad(9), F.lit(", р/с 40817"), pad(15), F.lit(", user"), k.cast("string"), F.lit("@mail.test"))
    found = detect.detect(read_table(spark, sf, "orders").select("o_orderkey", line.alias("text")), only=("email", "phone", "bik", "bank_account", "cvv", "birth_date"))
    return found.select("o_orderkey", "category", "count", "detector", F.col("examples")[0].alias("example"))


def detect_blocks(spark: SparkSession, sf: str) -> DataFrame:
    found = detect.detect(_blocks(spark, sf).select("block_id", "file_path", "block_index", "text"))
    return found.select("block_id", "file_path", "block_index", "category", "count", "confidence", "examples", "detector")


def normalized_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).where("text is not null").select("block_id", text.normalize_text(F.col("text")).alias("clean_text"))


def text_quality(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").where("text is not null").select("doc_id", F.round(text.quality(F.col("text")), 6).alias("quality"))


def packed_lines(spark: SparkSession, sf: str) -> DataFrame:
    chunks = F.posexplode(text.pack_lines(F.col("text"), 600)).alias("k", "chunk")
    return read_table(spark, sf, "documents").where("text is not null").select("doc_id", chunks)


def scan_types(spark: SparkSession, sf: str) -> DataFrame:
    return formats.scan_counts(_inventory(spark, sf))


def scan_states(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.counter(_inventory(spark, sf), "status", "method")


def file_extensions(spark: SparkSession, sf: str) -> DataFrame:
    return _inventory(spark, sf).select("scan_id", formats.extension_of(F.col("name")).alias("extension"), risk.submit_path(F.col("path"), "/share").alias("submit_path"))


def registered_formats(spark: SparkSession, sf: str) -> DataFrame:
    known = formats.registry(spark)
    files = _inventory(spark, sf).select("scan_id", "extension")
    return files.join(F.broadcast(known), "extension", "left").groupBy("family", "is_binary").agg(F.count("*").alias("files"))


def _plans(spark: SparkSession, sf: str) -> DataFrame:
    return planner.plans(_inventory(spark, sf).dropDuplicates(["path"]))


def plan_strategies(spark: SparkSession, sf: str) -> DataFrame:
    return _plans(spark, sf).select("path", "strategy", "skip_reason", F.size("steps").alias("steps"), F.size("escalation").alias("escalations"))


def plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _plans(spark, sf).groupBy("strategy").agg(F.count("*").alias("files"), F.count_if(F.size("escalation") > 0).alias("with_escalation"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"))


def plan_steps(spark: SparkSession, sf: str) -> DataFrame:
    return planner.ordered_steps(_plans(spark, sf), escalate=True).groupBy("extractor", "priority", "k").agg(F.count("*").alias("n"))


def triage_scores(spark: SparkSession, sf: str) -> DataFrame:
    return triage.scored(_plans(spark, sf), "normal").select("path", "bucket", "triage_score", F.array_join("signals", ",").alias("signals"))


def fast_selection(spark: SparkSession, sf: str) -> DataFrame:
    return triage.scored(_plans(spark, sf), "fast").select("path", triage.fast_reason().alias("reason"), triage.mode_reason("normal").alias("normal_reason"), triage.mode_reason("hard").alias("hard_reason"))


def plan_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return _plans(spark, sf).select("path", F.array_join("plan_warnings", ",").alias("plan_warnings"))


def category_counters(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).groupBy("category", "detector").agg(F.count("*").alias("findings"), F.sum(F.col("count").cast("long")).alias("total"), F.round(F.max("confidence"), 4).alias("most_confidence"))


def block_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("extraction_method", F.explode("warnings").alias("warning")).groupBy("extraction_method", "warning").agg(F.count("*").alias("blocks"))


def latest_assessments(spark: SparkSession, sf: str) -> DataFrame:
    return _assessed(spark, sf).select("file_path", "assessment_id", "document_type", F.size("categories").alias("n_categories"))


def risk_summary(spark: SparkSession, sf: str) -> DataFrame:
    own = _assessed(spark, sf).withColumn("level", risk.level(F.col("score")))
    return reports.risk_summary(own, setting("risk.submit"))


def best_risks(spark: SparkSession, sf: str) -> DataFrame:
    best = _assessed(spark, sf).orderBy(F.desc("score"), "submit_path", "assessment_id").limit(reports.BEST)
    return reports.rows_of(best).select("score", "submit_path", "document_type", "kinds", "rules")


def file_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """The warnings of each file in the order of its blocks."""
    own = _small_blocks(spark, sf).where("size(warnings) > 0").join(read_table(spark, sf, "text_blocks").select("block_id", "block_index").distinct(), "block_id")
    listed = own.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("block_index", "block_id", "warnings"))).alias("all"))
    return listed.select("file_path", F.array_join(F.flatten(F.transform("all", lambda b: b["warnings"])), "; ").alias("warnings"))


def failed_extractions(spark: SparkSession, sf: str) -> DataFrame:
    """Ten examples of files that gave no text: the first warning of their first block with one."""
    small = _small_blocks(spark, sf)
    empty = small.groupBy("file_path").agg(F.coalesce(F.bool_or("filled"), F.lit(False)).alias("filled"), F.min(F.when(F.size("warnings") > 0, F.struct("block_id", F.element_at("warnings", 1).alias("warning")))).alias("first"))
    return empty.where("not filled").orderBy("file_path").limit(10).select("file_path", F.col("first.warning").alias("warning"))


def triage_selection(spark: SparkSession, sf: str) -> DataFrame:
    mode = setting("modes.normal")
    chosen = triage.select(triage.scored(_plans(spark, sf), "normal"), triage.scaled_caps("normal", mode["max_candidates"]), mode["max_candidates"], mode["min_score"])
    return chosen.select("path", "bucket", "triage_score", "include", "reason")


def ocr_budget(spark: SparkSession, sf: str) -> DataFrame:
    return triage.ocr_budget(_plans(spark, sf), setting("limits.ocr_files"))


def _small_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """One row a block without its text: length and whether there is any are known before repeated deliveries meet."""
    own = read_table(spark, sf, "text_blocks").select("block_id", "file_path", "extraction_method", "warnings", "ocr", "embedded_payload", "embedded_document_like", F.length("text").cast("long").alias("chars"), (F.trim("text") != "").alias("filled"))
    return own.dropDuplicates(["block_id"])


def block_flags(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.block_flags(_small_blocks(spark, sf))


def extraction_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _small_blocks(spark, sf).groupBy("extraction_method").agg(F.count("*").alias("blocks"), F.count_distinct("file_path").alias("files"), F.sum("chars").alias("chars"), F.count_if(F.size("warnings") > 0).alias("with_warnings"))


def table_hints(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.hint_sums(_blocks(spark, sf))


def row_blocks(spark: SparkSession, sf: str) -> DataFrame:
    made = rows.row_blocks(read_table(spark, sf, "customer"), "c_nationkey", "c_custkey", rows.row_line(["c_custkey", "c_name", "c_mktsegment"]), 50)
    return made.select("c_nationkey", "block_index", "row_start", "row_end", "lines", "text")


def table_headers(spark: SparkSession, sf: str) -> DataFrame:
    first = F.split(F.split("text", "\n")[0], r"\s*[|,;\t]\s*")
    return _blocks(spark, sf).where("source_type in ('table', 'workbook') and text is not null").select("block_id", rows.is_header(first).alias("header"), F.array_join(rows.line_hints(F.col("text")), ",").alias("hints"))


def recurring_lines(spark: SparkSession, sf: str) -> DataFrame:
    return rows.recurring_lines(_blocks(spark, sf).where("source_type in ('pages', 'ocr')"))


def without_recurring_lines(spark: SparkSession, sf: str) -> DataFrame:
    return rows.without_recurring_lines(_blocks(spark, sf).where("source_type in ('pages', 'ocr')"))


def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.drop_repeats(read_table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


def json_members(spark: SparkSession, sf: str) -> DataFrame:
    return rows.flatten_json(read_table(spark, sf, "events"), ["event_id"], "props")


def ner_quota(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.ner_quota(_blocks(spark, sf), setting("limits.ner_files"), setting("limits.ner_blocks")).select("block_id", "file_path", "k")


def rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _assessed(spark, sf).select(F.explode("rule_hits").alias("h")).groupBy("h.rule").agg(F.count("*").alias("n"), F.round(F.sum("h.score_delta"), 2).alias("score"))


def level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _assessed(spark, sf).groupBy(risk.level(F.col("score")).alias("level")).agg(F.count("*").alias("files"))


def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    return risk.score_bands(_assessed(spark, sf))


def submit_list(spark: SparkSession, sf: str) -> DataFrame:
    return _assessed(spark, sf).where(F.col("score") >= setting("risk.submit")).select("submit_path").orderBy("submit_path")


def review_bands(spark: SparkSession, sf: str) -> DataFrame:
    return risk.bands(_assessed(spark, sf), setting("risk.submit"), 35.0).groupBy("band").agg(F.count("*").alias("files"), F.round(F.max("score"), 2).alias("best"))


def risk_assessment(spark: SparkSession, sf: str) -> DataFrame:
    ready = risk.features(_plans(spark, sf), _findings(spark, sf), _blocks(spark, sf))
    return risk.assess(ready).select("file_path", "score", "level", "recommendation", "document_type", F.transform("rule_hits", lambda h: h["rule"]).alias("rules"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        findings_by_file, categories_ordered, pii_summary, top_files, finding_examples, base_scores, findings_by_family, only_by_model, check_digits, masked_values, synthetic_findings, detect_blocks,
        normalized_texts, text_quality, packed_lines, scan_types, scan_states, file_extensions, registered_formats, plan_strategies, plan_summary, plan_steps, triage_scores, fast_selection, plan_warnings, triage_selection, ocr_budget, category_counters, block_warnings, latest_assessments, risk_summary, best_risks, file_warnings, failed_extractions,
        block_flags, extraction_summary, table_hints, row_blocks, table_headers, recurring_lines, without_recurring_lines, event_runs, json_members, ner_quota, rule_counts, level_counts, score_bands,
        submit_list, review_bands, risk_assessment,
    )
}
