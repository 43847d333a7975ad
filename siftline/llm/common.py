"""Shared pieces of the text operators: partition functions over Arrow batches, and mergeable partition counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a partition's counter beyond which it is emitted and started anew; later sums make the result whole.
FLUSH_ENTRIES = 400_000


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch as tuples."""
    return zip(*(column.to_pylist() for column in batch.columns), strict=True)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows to an Arrow batch; no rows make an empty batch."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[Iterator[tuple]], Iterable[tuple]]], ddl: str, arrow: list[tuple[str, pa.DataType]]) -> DataFrame:
    """mapInArrow with ``make()`` called once a task; its result turns the rows of a batch into output rows."""
    schema = pa.schema(arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield to_batch(list(step(rows_of(batch))), schema)

    return df.mapInArrow(run, ddl)


def count_keys(df: DataFrame, make: Callable[[], Callable[[Iterator[tuple], Counter], None]], keys: list[str]) -> DataFrame:
    """Sum of string-keyed counts over all rows: counted in each task first, so that little is shuffled.

    ``make()`` returns a function that adds a batch's rows to a Counter of tuples (one string per name in ``keys``).
    """
    schema = pa.schema([(k, pa.string()) for k in keys] + [("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, counts = make(), Counter()
        emit = lambda: to_batch([(*(k if isinstance(k, tuple) else (k,)), n) for k, n in counts.items()], schema)
        for batch in batches:
            add(rows_of(batch), counts)
            if len(counts) > FLUSH_ENTRIES:
                yield emit()
                counts.clear()
        yield emit()

    ddl = ", ".join(f"{k} string" for k in keys) + ", n bigint"
    return df.mapInArrow(run, ddl).groupBy(*keys).agg(F.sum("n").alias("n"))


class Memo(dict):
    """A dict that computes missing values and starts anew beyond a size, so that a task's memory stays bounded."""

    def __init__(self, compute: Callable[[Any], Any], most: int = 500_000) -> None:
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key: Any) -> Any:
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value
