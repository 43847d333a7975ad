"""Text expressions: normalisation, quality, greedy packing, path folding."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends of any kind.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
INVISIBLE = r"[\u00AD\u200B-\u200F\u2060\uFEFF]"
WIDE_BLANKS = r"[\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"


def strip(value: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def normalize_text(value: Column) -> Column:
    """Controls and invisible characters dropped, blanks plain and single, lines stripped, blank lines dropped."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, CONTROLS, ""), INVISIBLE, ""), WIDE_BLANKS, " ")
    lines = F.transform(F.split(plain, LINE_ENDS), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def clean_ocr_text(value: Column) -> Column:
    """normalize_text, with private-use characters dropped, words at line ends joined and lines run together."""
    plain = F.regexp_replace(normalize_text(value), r"[\uE000-\uF8FF]", "")
    return strip(F.regexp_replace(F.regexp_replace(plain, r"(?U)(\w)-\n(\w)", "$1$2"), r"\s*\n\s*", " "))


def quality(value: Column) -> Column:
    """0.7 of the share of letters, digits and blanks plus 0.3 of the share of words of three letters or more; 0 if blank."""
    size = F.length(value)
    good = F.length(F.regexp_replace(value, r"(?U)[^\p{L}\p{N}\s]", ""))
    words = F.filter(F.split(strip(value), r"(?U)\s+"), lambda x: x != "")
    long = F.size(F.filter(words, lambda x: F.length(x) >= 3))
    return F.when(F.coalesce(F.size(words), F.lit(0)) == 0, 0.0).otherwise(0.7 * good / size + 0.3 * long / F.size(words))


def is_real_text(value: Column) -> Column:
    """Whether a recognised line is text at all: 4 characters, quality .45, a letter and a word of three."""
    return F.coalesce((F.length(strip(value)) >= 4) & (quality(value) >= 0.45) & value.rlike(r"(?U)\p{L}") & value.rlike(r"(?U)\w{3}"), F.lit(False))


def pack_lines(value: Column, most: int) -> Column:
    """Lines packed greedily into chunks of at most ``most`` characters; a longer line stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def add(acc: Column, line: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(line) + 2 <= most
        joined = F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit("\n"), line).alias("now"))
        opened = F.struct(F.when(acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"), line.alias("now"))
        return F.when(acc["now"].isNotNull() & fits, joined).otherwise(opened)

    return F.aggregate(F.split(value, "\n"), start, add, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))


def has_any(value: Column, words: list[str]) -> Column:
    """Whether a lower-case string holds one of the words anywhere; one pattern, so that long lists stay small in a plan."""
    return F.coalesce(value.rlike("|".join(re.escape(w.lower()) for w in words)), F.lit(False)) if words else F.lit(False)


def count_any(value: Column, words: list[str]) -> Column:
    """How many of the words a lower-case string holds."""
    return sum((F.when(value.contains(w.lower()), 1).otherwise(0) for w in words), F.lit(0))


def weight_of(value: Column, weights: dict[str, float], default: float = 0.0) -> Column:
    """The weight of a string in a table of weights."""
    table = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v))))
    return F.coalesce(F.try_element_at(table, value), F.lit(float(default)))
