"""Scores by category and rule, levels, submission, and review bands.

Rules are data: a name, a score and a condition in SQL over one row of features a file (category counts by name, table
hints, flags of the plan and the path). Users bring their own; RULES holds those that the data itself suggests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import count_any, has_any, weight_of
from siftline.operators import aggregate
from siftline.settings import setting

#: Words in a path: fixed values.
SUSPICIOUS_PATH = ["выгруз", "subscribers", "subscriber", "backup", "dump", "full", "scan", "скан", "паспорт", "passport", "анкета", "заявка", "пропуск", "дмс", "dms", "личн", "копия", "card", "карта"]
CATEGORIES = tuple(setting("risk.weights")) + ("inn",)
HINTS = ("person_name_column", "address_column", "contact_column", "identifier_column", "sensitive_column_value", "person_type_column", "physical_person_rows")

#: (rule, score, condition). Counts of categories are columns of their names; missing ones are 0.
RULES: list[tuple[str, float, str]] = [
    ("high_risk_identifier", 35, "high_risk > 0"),
    ("identity_document_media", 95, "identity_document > 0 and (family in ('image', 'video') or ocr_used)"),
    ("form_identity_document", 80, "identity_document > 0 and family in ('document', 'rtf', 'web')"),
    ("embedded_identity_document_payload", 170, "embedded_document"),
    ("mass_bank_cards", 35, "bank_card >= 5"),
    ("mass_snils", 30, "snils >= 5"),
    ("person_profile_combo", 30, "fio > 0 and (passport_rf + snils + inn_person + birth_date + bank_account + bank_card) > 0"),
    ("contact_profile_combo", 18, "fio > 0 and (phone + email + address) > 0 and n_categories >= 3"),
    ("special_categories", 20, "special > 0 and strong_profile"),
    ("mass_table_pii", 28, "is_table and total_count >= 100"),
    ("sensitive_export", 35, "is_table and high_risk > 0"),
    ("table_sensitive_schema", 45, "is_table and (identifier_column + sensitive_column_value) > 0"),
    ("table_physical_person_names", 42, "is_table and physical_person_rows > 0 and person_name_column > 0"),
    ("table_name_address_schema", 34, "is_table and person_name_column > 0 and address_column > 0"),
    ("table_name_contact_schema", 26, "is_table and person_name_column > 0 and contact_column > 0"),
    ("informal_employee_folder", 50, "total_count > 0 and (path_low like '%мои бумажки%' or path_low like '%employes%' or path_low like '%employees%')"),
    ("high_ocr_context", 10, "total_count > 0 and scan_context"),
    ("scan_archive_image", 55, "family = 'image' and path_low like '%архив сканы%'"),
    ("web_snapshot_without_profile", -110, "family = 'web' and not strong_profile"),
]


def base_score(category: Column, count: Column) -> Column:
    """A category's weight, growing with repeats up to a cap."""
    s = setting("risk")
    weight = weight_of(category, s["weights"], s["default_weight"])
    growth = F.greatest(count - 1, F.lit(0)) * F.least(weight * s["repeat_factor"], F.lit(float(s["repeat_cap"])))
    return F.least(weight + growth, weight * s["max_multiplier"])


def features(plans: DataFrame, findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row for each planned file: counts by category, hints, flags; files without findings have zeros."""
    high, special = setting("risk.high_risk"), setting("risk.special")
    counts = aggregate.file_categories(findings)
    wide = counts.groupBy("file_path").agg(
        *(F.coalesce(F.sum(F.when(F.col("category") == c, F.col("count"))), F.lit(0)).alias(c) for c in CATEGORIES),
        F.sum("count").alias("total_count"), F.count("*").alias("n_categories"), F.sum(base_score(F.col("category"), F.col("count"))).alias("base"),
        F.sum(F.when(F.col("category").isin(*high), F.col("count")).otherwise(0)).alias("high_risk"), F.sum(F.when(F.col("category").isin(*special), F.col("count")).otherwise(0)).alias("special"),
        F.sort_array(F.collect_list(F.struct("category", "count"))).alias("categories"),
    )
    hints = aggregate.hint_sums(blocks).groupBy("file_path").agg(*(F.coalesce(F.sum(F.when(F.col("hint") == h, F.col("n"))), F.lit(0)).alias(h) for h in HINTS))
    flags = aggregate.block_flags(blocks).select("file_path", "ocr_used", "embedded_document")
    joined = plans.withColumnRenamed("path", "file_path").join(wide, "file_path", "left").join(hints, "file_path", "left").join(flags, "file_path", "left")
    zeros = dict.fromkeys([*CATEGORIES, *HINTS, "total_count", "n_categories", "base", "high_risk", "special"], 0) | {"ocr_used": False, "embedded_document": False}
    full = joined.fillna(zeros)
    is_table = F.coalesce(F.col("strategy").isin("structured_parse", "table_parse") | F.col("family").isin("structured", "spreadsheet") | F.col("extension").isin("csv", "tsv", "json", "parquet", "xls", "xlsx"), F.lit(False))
    strong = F.expr("(passport_rf + snils + inn_person + mrz + cvv) > 0 or (identity_document > 0 and (birth_date + fio) > 0) or bank_card >= 3 or (fio > 0 and (birth_date + bank_account + bank_card) > 0)")
    return full.withColumns({"is_table": is_table, "strong_profile": strong})


#: Rules on the columns of tables hold only where a mode reads more than the cheap formats: fixed values.
NOT_IN_FAST = {"table_sensitive_schema", "table_physical_person_names", "table_name_address_schema", "table_name_contact_schema"}


def assess(rows: DataFrame, rules: list[tuple[str, float, str]] | None = None, mode: str = "normal") -> DataFrame:
    """score, level, rule_hits and recommendation of each file."""
    s = setting("risk")
    rules = [r for r in (RULES if rules is None else rules) if mode != "fast" or r[0] not in NOT_IN_FAST]
    hits = [F.when(F.coalesce(F.expr(condition), F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(float(score)).alias("score_delta"))) for name, score, condition in rules]
    in_path = count_any(F.col("path_low"), SUSPICIOUS_PATH)
    hits.append(F.when(in_path > 0, F.struct(F.lit("suspicious_path").alias("rule"), F.least(F.lit(25.0), 8.0 + 4.0 * in_path).alias("score_delta"))))
    found = rows.withColumn("rule_hits", F.array_compact(F.array(*hits)))
    raw = F.col("base") + F.aggregate("rule_hits", F.lit(0.0), lambda a, h: a + h["score_delta"])
    scan = has_any(F.col("path_low"), ["архив сканы"]) & F.col("family").isin("image", "document") & (in_path > 0)
    capped = F.when((F.col("total_count") == 0) & ~F.coalesce((F.col("family") == "video") | F.col("embedded_document") | scan, F.lit(False)), F.least(raw, F.lit(s["no_evidence_cap"]))).otherwise(raw)
    score = F.greatest(F.round(capped, 2), F.lit(0.0))
    done = found.withColumn("score", score)
    return done.withColumns({"level": level(F.col("score")), "recommendation": F.when(F.col("score") >= s["priority"], "manual_review_priority").when(F.col("score") >= s["submit"], "manual_review").otherwise("do_not_submit_baseline"), "document_type": document_type()})


def level(score: Column) -> Column:
    s = setting("risk")
    return F.when(score >= s["high"], "high").when(score >= s["submit"], "submit").when(score >= s["review"], "review").otherwise("low")


def document_type() -> Column:
    return (
        F.when(F.col("embedded_document"), "embedded_identity_document").when(F.col("bank_card") >= 5, "card_dataset").when(F.col("identity_document") > 0, "identity_document_media")
        .when(F.col("snils") >= 5, "identifier_list").when((F.col("fio") > 0) & ((F.col("passport_rf") + F.col("birth_date") + F.col("inn_person")) > 0), "personal_profile")
        .when(has_any(F.col("path_low"), ["анкета", "заявка"]), "form_or_request").when(F.col("is_table"), "table_or_export").when(F.col("family") == "image", "image_candidate")
        .otherwise(F.coalesce("family", F.lit("unknown")))
    )


def submit_path(path: Column, root: str) -> Column:
    """The path below the root with a leading slash; else what follows a folder named share; else the name."""
    below = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 1, 10_000))
    shared = F.nullif(F.regexp_extract(path, r"/share(/.*)$", 1), F.lit(""))
    return F.coalesce(below, shared, F.concat(F.lit("/"), F.regexp_extract(path, r"([^/]*)$", 1)))


def bands(assessed: DataFrame, threshold: float, floor: float) -> DataFrame:
    """submit, review or suppressed."""
    return assessed.withColumn("band", F.when(F.col("score") >= threshold, "submit").when(F.col("score") >= floor, "review").otherwise("suppressed"))


def score_bands(assessed: DataFrame, width: int = 25) -> DataFrame:
    """(band, files): a histogram of scores."""
    low = (F.floor(F.col("score") / width) * width).cast("long")
    return assessed.groupBy(F.concat(low.cast("string"), F.lit("-"), (low + width).cast("string")).alias("band")).agg(F.count("*").alias("files"))


def report(assessed: DataFrame, path_col: str, title: str, most: int) -> str:
    """The best ``most`` as a table in Markdown; the driver holds no more than these."""
    lines = [f"# {title}", "", "| score | path | level | categories | rules |", "|---:|---|---|---|---|"]
    for r in assessed.orderBy(F.desc("score"), path_col).limit(most).select("score", path_col, "level", "categories", "rule_hits").collect():
        categories = ", ".join(f"{c.category}:{c['count']}" for c in (r.categories or [])[:6])
        lines.append(f"| {r.score:.1f} | `{r[1]}` | {r.level} | {categories} | {'; '.join(h.rule for h in (r.rule_hits or [])[:6])} |")
    return "\n".join(lines) + "\n"
