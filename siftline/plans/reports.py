"""Reports of a scan in Markdown, and its tables as JSON. Counts and orders are made in Spark; the driver holds what a report shows."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from typing import TYPE_CHECKING, TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators import risk

if TYPE_CHECKING:
    from siftline.plans.pipeline import Scan

#: Rows that a report shows: files to review, suppressed ones, rejected candidates, best risks, counters.
REVIEW, SUPPRESSED, REJECTED, BEST, COUNTERS = 250, 50, 80, 100, 50
FLOOR = 35.0
HEAD = ["| score | path | type | categories | strongest rules |", "|---:|---|---|---|---|"]


def rows_of(assessed: DataFrame) -> DataFrame:
    """score, submit_path, document_type, categories and rules (four that add to the score and three that lower it) as text."""
    hits = lambda up, n: F.slice(F.filter("rule_hits", lambda h: (h["score_delta"] > 0) if up else (h["score_delta"] < 0)), 1, n)
    shown = F.transform(F.concat(hits(True, 4), hits(False, 3)), lambda h: F.format_string("%s(%+.0f)", h["rule"], F.bround(h["score_delta"], 0)))
    ranked = F.array_sort(F.transform(F.coalesce("categories", F.array().cast("array<struct<category:string,count:bigint>>")), lambda c: F.struct((-c["count"]).alias("n"), c["category"].alias("c"))))
    kinds = F.transform(F.slice(ranked, 1, 8), lambda c: F.concat_ws(":", c["c"], (-c["n"]).cast("string")))
    return assessed.select("score", "submit_path", "document_type", F.array_join(kinds, ", ").alias("kinds"), F.array_join(shown, "; ").alias("rules"), (F.size("rule_hits") > 0).alias("hit"))


def _lines(rows: Iterator) -> Iterator[str]:
    return (f"| {r.score:.1f} | `{r.submit_path}` | {r.document_type} | {r.kinds} | {r.rules} |" for r in rows)


def _write(file: TextIO, lines: list[str] | Iterator[str]) -> None:
    file.writelines(f"{line}\n" for line in lines)


def review_report(assessed: DataFrame, path: str | Path, threshold: float, floor: float = FLOOR, most: int = REVIEW) -> None:
    """All files to submit by path, the best ones to review, and the best suppressed ones that have any evidence."""
    banded = risk.bands(assessed, threshold, floor)
    counts = {r.band: r["count"] for r in banded.groupBy("band").count().collect()}
    at = lambda band: rows_of(banded.where(F.col("band") == band))
    best = [F.desc("score"), "submit_path"]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("w", encoding="utf-8") as file:
        _write(file, ["# Review report", "", f"Submit threshold: `{threshold}`", f"Review floor: `{floor}`", *(f"{what}: `{counts.get(band, 0)}`" for what, band in (("Selected for submit", "submit"), ("Review candidates", "review"), ("Low-score assessed files", "suppressed")))])
        _write(file, ["", "## Submit", "", *HEAD])
        _write(file, _lines(at("submit").orderBy("submit_path").toLocalIterator()))  # a partition at a time
        _write(file, ["", "## Review Candidates", "", *HEAD, *_lines(at("review").orderBy(*best).limit(most).collect())])
        low = at("suppressed").orderBy(*best).limit(min(SUPPRESSED, most)).where((F.col("kinds") != "") | F.col("hit"))
        _write(file, ["", "## Top Suppressed", "", *HEAD, *_lines(low.collect())])


def counter_table(title: str, df: DataFrame, key: Column, weight: Column | None = None, most: int = COUNTERS) -> list[str]:
    """The most frequent keys as a table."""
    counted = df.groupBy(key.cast("string").alias("item")).agg((F.sum(weight) if weight is not None else F.count("*")).alias("n"))
    rows = counted.orderBy(F.desc("n"), "item").limit(most).collect()
    return [f"### {title}", "", "| item | count |", "|---|---:|", *(f"| {r.item} | {r.n} |" for r in rows), ""]


def pipeline_report(scan: Scan, path: str | Path, mode: str, threshold: float) -> None:
    """What a scan saw, chose, read and found."""
    kind = F.concat_ws("/", F.coalesce("family", F.lit("unknown")), F.coalesce("extension", F.lit("unknown")))
    chosen, left = scan.chosen.where("include"), scan.chosen.where("not include")
    step = F.concat_ws(": ", "extraction_method", F.element_at("warnings", 1))
    to_submit = scan.assessed.where(F.col("score") >= threshold)
    facts = [("Files", scan.inventory.count()), ("Chosen", chosen.count()), ("Files with text", scan.blocks.where("trim(text) <> ''").select("file_path").distinct().count()), ("Files with findings", scan.findings.select("file_path").distinct().count()), ("To submit", to_submit.count())]
    lines = ["# Pipeline report", "", f"- Mode: `{mode}`", f"- Risk threshold: `{threshold}`", *(f"- {name}: `{n}`" for name, n in facts), "", "## Scan", "", *counter_table("Types", scan.inventory.where("status <> 'error'"), kind)]
    lines += ["## Selection", "", *counter_table("Chosen for", chosen, F.col("reason")), *counter_table("Left out for", left, F.col("reason")), *counter_table("Chosen types", chosen, kind), *counter_table("Types left out", left, kind, most=25)]
    lines += counter_table("Triage score bands", scan.chosen.withColumn("low", (F.floor(F.col("triage_score") / 25) * 25).cast("int")), F.concat_ws("-", "low", F.col("low") + 25), most=20)
    rejected = left.where("triage_score > 0 and skip_reason is null").orderBy(F.desc("triage_score"), "path").limit(REJECTED).collect()
    lines += ["### Best left out", "", "| score | bucket | path | reason | signals |", "|---:|---|---|---|---|", *(f"| {r.triage_score:.1f} | `{r.bucket}` | `{r.path}` | {r.reason} | {', '.join(r.signals[:8])} |" for r in rejected), ""]
    lines += ["## Extraction", "", *counter_table("Extractors", scan.blocks, F.col("extraction_method")), *counter_table("Without text", scan.blocks.where("size(warnings) > 0"), step)]
    lines += ["## Findings", "", *counter_table("Categories", scan.findings, F.col("category"), F.col("count")), "## Submit", "", *HEAD]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("w", encoding="utf-8") as file:
        _write(file, lines)
        _write(file, _lines(rows_of(to_submit).orderBy("submit_path").toLocalIterator()))
        _write(file, ["", "## Best risks", "", *HEAD, *_lines(rows_of(scan.assessed).orderBy(F.desc("score"), "submit_path").limit(BEST).collect())])


def risk_summary(assessed: DataFrame, threshold: float) -> DataFrame:
    """(what, item, n): levels of all files; categories and rules of those to submit."""
    chosen = assessed.where(F.col("score") >= threshold)
    one = lambda df, what, item, n: df.groupBy(item.alias("item")).agg(n.alias("n")).select(F.lit(what).alias("what"), "item", "n")
    levels = one(assessed, "level", F.col("level"), F.count("*"))
    categories = one(chosen.select(F.explode("categories").alias("c")), "category", F.col("c.category"), F.sum("c.count"))
    return levels.unionByName(categories).unionByName(one(chosen.select(F.explode("rule_hits").alias("h")), "rule", F.col("h.rule"), F.count("*")))


def export_json(scan: Scan, folder: str) -> None:
    """Every table of a scan as JSON lines, written by the tasks."""
    for name in ("inventory", "plans", "chosen", "blocks", "findings", "assessed"):
        getattr(scan, name).write.mode("overwrite").json(f"{folder}/{name}")
