"""File formats: by signature, then by content, then by extension; and summaries of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.settings import FORMATS

#: Bytes of a file that are looked at, and signatures with the extension they mean: fixed values.
SAMPLE_BYTES = 65_536
SIGNATURES = {"50415231": "parquet", "25504446": "pdf", "89504E47": "png", "FFD8FF": "jpg", "47494638": "gif", "49492A00": "tif", "4D4D002A": "tif", "7F454C46": "elf"}
#: A container format that names its kind in bytes 9 to 12: fixed values.
RIFF, WEBP = "52494646", b"WEBP"
OLE, ZIP = "D0CF11E0A1B11AE1", "504B"
HTML = r"(?i)<!doctype\s+html|<html[\s>]|<head[\s>]|<body[\s>]"
IGNORED = [".DS_Store", "Thumbs.db", "desktop.ini"]


def registry(spark: SparkSession) -> DataFrame:
    """The known formats as a table."""
    return spark.createDataFrame([(k, *v) for k, v in FORMATS.items()], "extension string, mime string, family string, is_binary boolean")


def extension_of(name: Column) -> Column:
    """The lower-case suffix of a name; empty for none and for names that begin with their only dot."""
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.\s/]+)$", 1))


def looks_binary(content: Column) -> Column:
    """A zero byte, or over a quarter of control bytes but tab, line feed and return, in the first 4096."""
    codes = F.hex(F.substring(content, 1, 4096))
    pairs = F.regexp_extract_all(codes, F.lit("(..)"), F.lit(1))
    control = F.size(F.filter(pairs, lambda b: (b < "20") & ~b.isin("09", "0A", "0D")))
    return F.exists(pairs, lambda b: b == "00") | (control > F.size(pairs) * 0.25)


def detect_format(files: DataFrame) -> DataFrame:
    """status, method, extension, mime, family, is_binary, confidence and details for files with name, size_bytes and the head of their content.

    Where the columns of ``files.heads`` are there, a text whose lines have stable columns is a table.
    """
    tables = "table_columns" in files.columns
    head = F.substring("content", 1, SAMPLE_BYTES)
    code, own = F.hex(F.substring("content", 1, 8)), extension_of(F.col("name"))
    text = F.try_validate_utf8(head.cast("string"))
    shape = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([\[{])", 1)
    known = own.isin(*FORMATS)

    def result(method: str, extension: Column, confidence: float, status: str = "success") -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(method).alias("method"), extension.alias("extension"), F.lit(confidence).alias("confidence"))

    chain = F.when(F.col("size_bytes") == 0, result("empty_file", F.when(known, own).otherwise("txt"), 0.3))
    for signature, extension in SIGNATURES.items():
        chain = chain.when(code.startswith(signature), result("signature", F.lit(extension), 1.0))
    chain = chain.when(code.startswith(OLE) & own.isin("doc", "xls", "ppt"), result("ole_extension", own, 0.95)).when(code.startswith(OLE), result("ole", own, 0.65, "warning"))
    chain = chain.when(code.startswith(ZIP) & own.isin("docx", "xlsx", "pptx"), result("zip_extension", own, 0.9)).when(code.startswith(ZIP), result("signature", F.lit("zip"), 1.0))
    chain = chain.when(code.startswith(RIFF) & (F.substring(head, 9, 4) == F.lit(WEBP)), result("signature", F.lit("webp"), 1.0))
    chain = chain.when(F.substring(head, 5, 4) == F.lit(b"ftyp"), result("signature", F.lit("mp4"), 1.0))
    chain = chain.when(looks_binary(head) & known, result("extension", own, 0.55, "warning")).when(looks_binary(head), result("binary_unknown", F.lit(None).cast("string"), 0.2, "warning"))
    chain = chain.when(F.substring(text, 1, 4000).rlike(HTML), result("html", F.lit("html"), 0.9))
    whole = F.col("size_bytes") <= SAMPLE_BYTES
    chain = chain.when((shape != "") & whole & F.try_parse_json(text).isNotNull(), result("json_parse", F.lit("json"), 0.98))
    chain = chain.when((shape != "") & whole & (own == "json"), result("extension_json_invalid", own, 0.45, "warning")).when((shape != "") & ~whole, result("json_shape", F.lit("json"), 0.75))
    chain = chain.when((own == "json"), result("extension_json_invalid", own, 0.4, "warning"))
    if tables:
        chain = chain.when(F.col("table_columns").isNotNull(), result("csv_sniffer", F.when((F.col("table_delimiter") == "\t") & (own == "tsv"), "tsv").otherwise("csv"), 0.9))
        chain = chain.when(own.isin("csv", "tsv"), result("extension_only", own, 0.45, "warning"))
    chain = chain.when(known, result("extension", own, 0.7)).otherwise(result("text_fallback", F.lit("txt"), 0.4))
    encoding = F.when(head.isNotNull() & ~looks_binary(head), F.when(text.isNotNull(), "utf-8").otherwise("windows-1251"))
    shown = [F.col(c) if tables else F.lit(None) for c in ("table_delimiter", "table_rows", "table_columns")]
    details = F.struct(encoding.alias("encoding"), shown[0].cast("string").alias("delimiter"), shown[1].cast("int").alias("rows_sampled"), shown[2].cast("int").alias("columns"))
    kept = [c for c in files.columns if c not in ("content", "table_delimiter", "table_rows", "table_columns")]
    found = files.withColumns({"_f": chain, "details": details}).select(*kept, "_f.*", "details")
    return found.join(F.broadcast(registry(files.sparkSession)), "extension", "left")  # the registry has as many rows as FORMATS


def scan_counts(inventory: DataFrame) -> DataFrame:
    """(file_type, n): ``EXT (mime)`` of the files that could be read."""
    kind = F.concat(F.upper(F.coalesce("extension", F.lit("unknown"))), F.lit(" ("), F.coalesce("mime", F.lit("unknown")), F.lit(")"))
    return inventory.where("status <> 'error'").groupBy(kind.alias("file_type")).agg(F.count("*").alias("n"))
