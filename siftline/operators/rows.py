"""Tables as text: rows to lines, header detection, hints, blocks of lines; and lines that recur on the pages of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import has_any
from siftline.settings import setting

#: Words in column names, and marks of physical persons.
PERSON = ["fio", "full_name", "customer_name", "client_name", "subscriber_name", "employee_name", "person", "person_name", "фамилия", "имя", "отчество", "фио"]
ADDRESS = ["address", "destination_address", "registration_address", "home_address", "адрес", "улица"]
CONTACT = ["phone", "email", "tel", "mobile", "почта", "телефон"]
IDENTIFIER = ["passport", "snils", "inn", "birth", "dob", "паспорт", "снилс", "инн", "рожд"]
PHYSICAL = ["физическое лицо", "physical person", "individual", "person_type", "customer_type"]


def row_line(columns: list[str]) -> Column:
    """``name: value`` of each cell that is not empty, joined by bars."""
    cells = [F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    return F.concat_ws(" | ", *cells)


def is_header(cells: Column) -> Column:
    """Whether an array of cells looks like column names: two at least, one of the known words or half of them short words."""
    full = F.filter(cells, lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))
    known = F.exists(full, lambda c: has_any(F.lower(c), PERSON + ADDRESS + CONTACT + IDENTIFIER))
    short = F.size(F.filter(full, lambda c: (F.length(c) <= 40) & c.rlike(r"(?U)\p{L}") & ~c.rlike(r"(?U)\d")))
    return (F.size(full) >= 2) & (known | (short >= F.greatest(F.lit(2), F.floor(F.size(full) / 2))))


def line_hints(line: Column) -> Column:
    """Names of the hints that a line of a table gives."""
    low = F.lower(line)
    hints = [("person_name_column", has_any(low, PERSON)), ("address_column", has_any(low, ADDRESS)), ("contact_column", has_any(low, CONTACT)), ("identifier_column", has_any(low, IDENTIFIER)), ("person_type_column", has_any(low, PHYSICAL[3:])), ("physical_person_rows", has_any(low, PHYSICAL[:3]))]
    return F.array_compact(F.array(*(F.when(found, F.lit(name)) for name, found in hints)))


def row_blocks(rows: DataFrame, group: str, order: str, line: Column, lines: int | None = None) -> DataFrame:
    """Blocks of so many non-blank lines: (group, block_index, row_start, row_end, lines, text).

    Rows are numbered with the blank ones. A block ends at its last line's row, the last block of a group at the group's
    last row; it begins behind the row in which the block before ended. A group is numbered by windows; give tables of
    any size a finer ``group`` (row ranges).
    """
    most = lines or setting("limits.block_lines")
    ordered = Window.partitionBy(group).orderBy(order)
    numbered = rows.select(group, order, line.alias("line")).withColumn("row", F.row_number().over(ordered))
    full = numbered.withColumn("filled", F.coalesce(F.trim("line") != "", F.lit(False)))
    placed = full.withColumn("k", F.sum(F.col("filled").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all_rows", F.max("row").over(Window.partitionBy(group)))
    blocks = placed.where("filled").groupBy(group, F.floor((F.col("k") - 1) / most).alias("block_index")).agg(
        F.max("row").alias("last"), F.max("all_rows").alias("all_rows"), F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text")
    )
    by = Window.partitionBy(group).orderBy("block_index")
    return blocks.select(
        group, "block_index", (F.coalesce(F.lag("last").over(by), F.lit(0)) + 1).alias("row_start"),
        F.when(F.lead("last").over(by).isNull() & (F.col("lines") < most), F.col("all_rows")).otherwise(F.col("last")).alias("row_end"), "lines", "text",
    )


def recurring_lines(blocks: DataFrame, least_pages: int = 3, share: float = 0.3) -> DataFrame:
    """(file_path, line, pages): lines on at least ``share`` of a file's pages and three of them, in files of three pages or more."""
    texts = blocks.where("text is not null and text <> ''")
    pages = texts.groupBy("file_path").agg(F.count_distinct("block_index").alias("pages"))
    lines = texts.select("file_path", "block_index", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line")).where("line <> ''")
    counted = lines.groupBy("file_path", "line").agg(F.count_distinct("block_index").alias("on_pages"))
    kept = counted.join(pages, "file_path").where((F.col("pages") >= least_pages) & (F.col("on_pages") >= F.greatest(F.lit(3), F.floor(F.col("pages") * share))))
    return kept.select("file_path", "line", F.col("on_pages").alias("pages"))


def without_recurring_lines(blocks: DataFrame) -> DataFrame:
    """(block_id, clean_text): texts without the recurring lines of their file, the other lines joined by blanks."""
    gone = recurring_lines(blocks).groupBy("file_path").agg(F.collect_set("line").alias("gone"))
    joined = blocks.where("text is not null").select("block_id", "file_path", "text").distinct().join(gone, "file_path", "left")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.coalesce(F.array_contains(F.col("gone"), x), F.lit(False)))
    return joined.select("block_id", F.array_join(kept, " ").alias("clean_text"))


def flatten_json(df: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """One row for each top-level member of a JSON object: the keys, name, value."""
    members = F.from_json(json_col, "map<string,string>")
    return df.select(*keys, F.explode(members).alias("name", "value"))
