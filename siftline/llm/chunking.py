"""Problem 4: content-defined chunking with natural boundaries.

A rolling hash over the characters marks landmarks that depend on nearby text only. Between the smallest and the
largest size of a piece the first landmark is taken and snapped to the nearest natural boundary (paragraph, line,
sentence, word), so an edit alters only the pieces around it. Without a landmark the last natural boundary that fits is
taken, and without one of those the limit itself.

Piece k is text[from_char:to_char] of its block; from the second piece on it begins with the last ``overlap_chars``
characters of the piece before. No piece is longer than ``max_chars``. Texts within the limit, empty and null texts give
no pieces here (they need no cutting). An overlap of the limit or more is reduced to half the limit. Repeated rows are
cut as often as they occur; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import map_rows

WINDOW = 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Natural boundaries from the strongest; the cut is behind the match.
BOUNDARIES = [re.compile(p) for p in (r"\n[ \t]*\n+", r"\n", r"[.!?…;:]+[»\")\]]*\s+", r"\s+")]


def rolling_hash(text: str) -> np.ndarray:
    """At each position a hash of the WINDOW characters that end there."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(1)) * _BASE
        mixed ^= mixed >> np.uint64(29)
        total, factor = np.zeros(len(codes), np.uint64), np.uint64(1)
        for k in range(min(WINDOW, len(codes))):
            total[k:] += mixed[: len(codes) - k] * factor
            factor *= np.uint64(0x100000001B3)
        return (total * _BASE) >> np.uint64(40)


def cut(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text longer than ``most``."""
    overlap = min(max(overlap, 0), most // 2)
    fresh = max(1, most - overlap)
    least, reach = max(1, fresh // 3), max(1, fresh // 8)
    hashes = rolling_hash(text)
    landmarks = np.flatnonzero(hashes % np.uint64(max(2, fresh // 3)) == 0) + 1
    bounds = [np.array([m.end() for m in b.finditer(text)], np.int64) for b in BOUNDARIES]

    def between(points: np.ndarray, low: int, high: int) -> np.ndarray:
        return points[np.searchsorted(points, low) : np.searchsorted(points, high, "right")]

    pieces, begun, done = [], 0, 0
    while len(text) - begun > most:
        # The first piece repeats nothing, so it may be longer by the overlap.
        low, high = done + least, begun + most
        marks = between(landmarks, low, high)
        end = 0
        if len(marks):
            at = int(marks[0])
            for points in bounds:
                near = between(points, max(low, at - reach), min(high, at + reach))
                if len(near):
                    end = int(near[np.argmin(np.abs(near - at))])
                    break
        if not end:
            end = next((int(near[-1]) for points in bounds if len(near := between(points, low, high))), high)
        pieces.append((begun, end))
        begun, done = max(end - overlap, 0), end
    return [*pieces, (begun, len(text))]


def split_oversized(blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the blocks whose text exceeds the limit of their source_type; ``*`` holds for types without a row.

    ``limits`` has a row a source type; those are few by definition (a row of the table per type), and are joined by
    type. Sizes are compared in the JVM, so only oversized texts reach Python.
    """
    own = limits.select(F.col("source_type").alias("limit_type"), "max_chars", "overlap_chars").where("max_chars > 0")
    rest = own.where("limit_type = '*'").select(F.col("max_chars").alias("any_max"), F.col("overlap_chars").alias("any_overlap")).limit(1)
    rest = rest.unionByName(blocks.sparkSession.createDataFrame([(None, None)], "any_max int, any_overlap int")).agg(F.max("any_max").alias("any_max"), F.max("any_overlap").alias("any_overlap"))
    named = own.where("limit_type <> '*'").dropDuplicates(["limit_type"])
    chosen = (
        blocks.select("block_id", "file_path", "block_index", "page_or_sheet", "source_type", "text")
        .join(named, F.col("source_type") == F.col("limit_type"), "left")
        .join(F.broadcast(rest))  # exactly one row
        .select("block_id", "file_path", "block_index", "page_or_sheet", "text", F.coalesce("max_chars", "any_max").alias("most"), F.coalesce(F.when(F.col("limit_type").isNotNull(), F.coalesce("overlap_chars", F.lit(0))), "any_overlap", F.lit(0)).alias("overlap"))
        .where(F.length("text") > F.col("most"))
    )

    def make():  # noqa: ANN202
        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for block_id, path, index, page, text, most, overlap in rows:
                spans = cut(text, most, overlap)
                for k, (a, b) in enumerate(spans):
                    yield block_id, path, index, page, k, len(spans), a, b, text[a:b]

        return step

    text, number, large = pa.string(), pa.int32(), pa.int64()
    return map_rows(
        chosen, make, "block_id bigint, file_path string, block_index int, page_or_sheet string, piece int, pieces int, from_char bigint, to_char bigint, piece_text string",
        [("block_id", large), ("file_path", text), ("block_index", number), ("page_or_sheet", text), ("piece", number), ("pieces", number), ("from_char", large), ("to_char", large), ("piece_text", text)],
    )
