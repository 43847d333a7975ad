"""Settings: the values that decide results, as one nested dict, with overrides from a JSON file.

The file is the first found of: $SIFTLINE_SETTINGS (which must exist), the working folder, this package.
"""

from __future__ import annotations

import copy
import json
import os
from functools import cache
from pathlib import Path
from typing import Any

FILE_NAME = "siftline_settings.json"

#: Formats by extension, with mime type, family and whether binary.
FORMATS = {
    "csv": ("text/csv", "structured", False),
    "tsv": ("text/tab-separated-values", "structured", False),
    "json": ("application/json", "structured", False),
    "parquet": ("application/vnd.apache.parquet", "structured", True),
    "html": ("text/html", "web", False),
    "htm": ("text/html", "web", False),
    "txt": ("text/plain", "text", False),
    "md": ("text/markdown", "text", False),
    "markdown": ("text/markdown", "text", False),
    "rtf": ("application/rtf", "document", False),
    "pdf": ("application/pdf", "document", True),
    "doc": ("application/msword", "document", True),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "document", True),
    "xls": ("application/vnd.ms-excel", "spreadsheet", True),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "spreadsheet", True),
    "ppt": ("application/vnd.ms-powerpoint", "presentation", True),
    "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "presentation", True),
    "jpg": ("image/jpeg", "image", True),
    "jpeg": ("image/jpeg", "image", True),
    "png": ("image/png", "image", True),
    "gif": ("image/gif", "image", True),
    "webp": ("image/webp", "image", True),
    "tif": ("image/tiff", "image", True),
    "tiff": ("image/tiff", "image", True),
    "mp4": ("video/mp4", "video", True),
    "zip": ("application/zip", "archive", True),
    "elf": ("application/x-executable", "executable", True),
}

#: Weights, limits and word lists.
DEFAULTS: dict[str, Any] = {
    "modes": {
        "fast": {"max_candidates": None, "min_score": None, "escalate": False},
        "normal": {"max_candidates": 180, "min_score": 25, "escalate": False},
        "hard": {"max_candidates": 520, "min_score": 20, "escalate": True},
    },
    "limits": {"ocr_files": 80, "ner_files": 40, "ner_blocks": 3, "block_chars": 50_000, "block_lines": 250, "examples": 3, "json_bytes": 50 * 1024 * 1024, "payload_least": 32 * 1024, "payload_most": 20 * 1024 * 1024},
    "triage": {
        "bucket_caps": {
            "normal": {"text_table": 80, "document": 55, "web": 20, "binary_media": 25, "ocr_media": 0, "other": 0},
            "hard": {"text_table": 120, "document": 160, "web": 70, "binary_media": 30, "ocr_media": 220, "other": 0},
        },
        "family": {"structured": 48, "text": 42, "spreadsheet": 38, "executable": 82, "video": 78, "document": 22, "web": 12, "image": 0, "presentation": 0},
        "family_hard": {"image": 16, "presentation": 12},
        "extension": {"csv": 18, "json": 12, "parquet": 24, "txt": 12, "md": 5, "docx": 16, "rtf": 12, "doc": 8, "pdf": 6, "xls": 10, "xlsx": 10, "tif": 26, "tiff": 26, "jpg": 8, "jpeg": 8, "png": 8, "mp4": 36, "elf": 35},
        "personal": ["паспорт", "passport", "удостовер", "identity", "driver", "license", "анкета", "заявление", "согласие", "пропуск", "дмс", "personal", "личн", "скан", "scan", "копия", "photo", "фото"],
        "export": ["выгруз", "dump", "backup", "full", "billing", "subscribers", "subscriber", "customers", "clients", "physical", "employees", "employes"],
        "low_value": ["products", "sales", "stores", "sample", "schema", "plan", "psxattrs"],
        "public": ["/прочее/", "/документы партнеров/", "privacy", "policy", "terms", "agreement", "regulation", "устав", "отчет", "отчёт", "закон", "фз"],
    },
    "planner": {
        "low_confidence": 0.5,
        "tiny_bytes": 128,
        "small_image_bytes": 2048,
        "scan_folders": ["архив сканы", "выгрузки", "scan", "scans", "dump", "backup"],
        "suspicious": ["паспорт", "passport", "скан", "scan", "копия", "copy", "удостовер", "driver", "license", "карта", "card", "анкета", "заявление", "согласие", "список", "выгруз", "dump", "backup", "скрин", "screenshot", "photo", "фото"],
        "business": ["договор", "счет", "счёт", "акт", "наклад", "приказ", "распоряж", "agreement", "contract", "invoice", "policy", "privacy", "terms", "regulation", "rules"],
    },
    "risk": {
        "high": 180.0,
        "submit": 120.0,
        "review": 60.0,
        "priority": 90.0,
        "no_evidence_cap": 25.0,
        "default_weight": 3.0,
        "repeat_factor": 0.12,
        "repeat_cap": 8.0,
        "max_multiplier": 3.5,
        "high_risk": ["bank_card", "cvv", "passport_rf", "passport_foreign", "foreign_id", "snils", "inn_person", "mrz"],
        "special": ["health_data", "biometric_data", "religion", "political_views", "nationality"],
        "weights": {
            "cvv": 90, "mrz": 80, "bank_card": 65, "passport_rf": 60, "passport_foreign": 58, "foreign_id": 50, "identity_document": 35, "snils": 55,
            "inn_person": 45, "bank_account": 40, "birth_date": 30, "health_data": 12, "biometric_data": 18, "address": 18, "phone": 12, "email": 10,
            "fio": 8, "inn_legal": 8, "bik": 5, "religion": 10, "political_views": 10, "nationality": 10,
        },
    },
}


def settings_path() -> Path | None:
    """The settings file in force; a file named in the environment must exist."""
    named = os.environ.get("SIFTLINE_SETTINGS")
    if named:
        if not Path(named).is_file():
            raise FileNotFoundError(f"no settings file: {named}")
        return Path(named)
    return next((p for p in (Path.cwd() / FILE_NAME, Path(__file__).parent / FILE_NAME) if p.is_file()), None)


def _merged(base: Any, over: Any) -> Any:
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: _merged(base.get(k), over[k]) if k in over else v for k, v in (over | base).items()}
    return over


@cache
def _loaded() -> dict[str, Any]:
    path = settings_path()
    return _merged(DEFAULTS, json.loads(path.read_text("utf-8"))) if path else DEFAULTS


def setting(key: str, default: Any = None) -> Any:
    """A copy of the value at a dotted key."""
    value: Any = _loaded()
    for part in key.split("."):
        if not isinstance(value, dict) or part not in value:
            return default
        value = value[part]
    return copy.deepcopy(value)


def write_template(path: str | Path, force: bool = False) -> Path:
    """Write the defaults as a file to be edited."""
    target = Path(path)
    if target.exists() and not force:
        raise FileExistsError(str(target))
    target.write_text(json.dumps(DEFAULTS, ensure_ascii=False, indent=2), "utf-8")
    return target
