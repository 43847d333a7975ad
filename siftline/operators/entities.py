"""Names and other entities found by a model: an optional detector beside the patterns.

A model is a function from a text to (entity type, value, score) triples; it travels to the tasks and reads the blocks
within the quota (see ``aggregate.ner_quota``). Types are mapped to categories and accepted by rules of their category;
values that patterns find better are left to them. Without a model there are no findings and a status says so.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.operators import aggregate
from siftline.settings import setting

Model = Callable[[str], Iterable[tuple[str, str, float]]]
#: Entity types and their categories, categories that patterns cover, words near a birth date and in an address.
CATEGORIES = {
    "PERSON": "fio", "LOCATION": "address", "NRP": "nationality", "MEDICAL_LICENSE": "health_data", "IBAN_CODE": "bank_account", "US_SSN": "foreign_id", "US_PASSPORT": "passport_foreign", "UK_NHS": "health_data",
    "SG_NRIC_FIN": "foreign_id", "AU_TFN": "foreign_id", "SNILS_RF": "snils", "INN_RF": "inn_person", "OGRN_RF": "inn_legal", "DATE_TIME": "birth_date",
}
COVERED = {"email", "phone", "snils", "inn_person", "inn_legal", "bank_card", "bik", "bank_account", "cvv", "passport_rf", "mrz"}
BIRTH = re.compile(r"дата\s+рождения|родил(?:ся|ась)|birth\s+date|date\s+of\s+birth|d\.?\s*o\.?\s*b\.?", re.I)
ADDRESS = re.compile(r"\d|улиц|ул\.|просп|пр-т|переул|пер\.|дом|д\.|кв\.|корп|строен|address|street|road|avenue|apt", re.I)
NEAR, CONFIDENCE, DETECTOR = 80, 0.78, "ner:model"


def accepted(kind: str, value: str, text: str) -> str | None:
    """The category of an entity, or None if it is not taken for one."""
    category = CATEGORIES.get(kind)
    if category is None or category in COVERED:
        return None
    if category == "fio":
        return category if len(value.split()) > 1 and re.search(r"[^\W\d_]", value) else None
    if category == "address":
        return category if len(value) >= 8 and ADDRESS.search(value) else None
    if category == "birth_date":
        at = text.find(value)
        return category if re.search(r"\d", value) and BIRTH.search(text[max(0, at - NEAR) : at + len(value) + NEAR]) else None
    return category


def mask(category: str, value: str) -> str:
    if category == "fio":
        return " ".join(w[:1] + "***" for w in value.split())
    if category == "address":
        return value[:50]
    if category == "birth_date":
        return re.sub(r"\d", "*", value)
    if category in ("bank_account", "foreign_id", "passport_foreign"):
        return value[:4] + "*" * max(0, len(value) - 8) + value[-4:] if len(value) > 8 else "*" * len(value)
    return value[:30]


def status(model: Model | None) -> str:
    return "ready" if model else "not_used: no model"


def detect_entities(blocks: DataFrame, model: Model | None, files: int | None = None, per_file: int | None = None) -> DataFrame:
    """Findings of the model as of the patterns: block_id, file_path, block_index, category, count, confidence, examples, detector."""
    most = setting("limits.examples")
    chosen = aggregate.ner_quota(blocks, setting("limits.ner_files") if files is None else files, setting("limits.ner_blocks") if per_file is None else per_file)
    schema = pa.schema([("block_id", pa.int64()), ("file_path", pa.string()), ("block_index", pa.int32()), ("category", pa.string()), ("count", pa.int32()), ("confidence", pa.float64()), ("examples", pa.list_(pa.string())), ("detector", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, path, index, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found: dict[str, dict[str, None]] = {}
                for kind, value, _score in model(text) if model else ():
                    category = accepted(kind, value.strip(), text)
                    if category:
                        found.setdefault(category, {})[value.strip()] = None
                rows += [(key, path, index, c, len(v), CONFIDENCE, list(dict.fromkeys(mask(c, x) for x in v))[:most], DETECTOR) for c, v in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)

    ready = chosen.where("text is not null and trim(text) <> ''").select("block_id", "file_path", "block_index", "text")
    return ready.mapInArrow(run, "block_id bigint, file_path string, block_index int, category string, count int, confidence double, examples array<string>, detector string")
