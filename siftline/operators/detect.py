"""Detectors: regular expressions, check digits and context over a text column, in one projection and one explode.

A finding is one row a category and text: count, confidence, up to three masked examples, and the detector's name. A blank
or null text has none. Order of the detectors is the order in which equal counts are listed later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import checks, masks
from siftline.functions.checks import digits
from siftline.settings import setting

_DMY = r"(?:0?[1-9]|[12]\d|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)\d{2}"
_YMD = r"(?:19|20)\d{2}[./-](?:0?[1-9]|1[0-2])[./-](?:0?[1-9]|[12]\d|3[01])"
#: What each category looks like.
PATTERNS = {
    "email": r"(?U)(?<![\w.+-])[\w.+-]{1,64}@[\w.-]+\.[A-Za-zА-Яа-яЁё]{2,}(?![\w.-])",
    "phone": r"(?U)(?<![A-Za-z0-9-])(?:\+?7|8)[\s\-.(]{0,3}\d{3}[\s\-.)]{0,3}\d{3}[\s\-]{0,2}\d{2}[\s\-]{0,2}\d{2}(?![A-Za-z0-9-])",
    "snils": r"(?U)(?<![A-Za-z0-9-])\d{3}[- ]?\d{3}[- ]?\d{3}[- ]?\d{2}(?![A-Za-z0-9-])",
    "inn": r"(?U)(?<![A-Za-z0-9-])(?:\d{10}|\d{12})(?![A-Za-z0-9-])",
    "passport": r"(?iU)(?<![A-Za-z0-9])(?:серия\s*)?(\d{2}\s?\d{2})[\s,;:№#-]*(?:номер|№|N|No|Nº)?[\s:№#-]*(\d{6})(?![A-Za-z0-9])",
    "bank_card": r"(?U)(?<![A-Za-z0-9-])(?:\d[ -]?){13,19}(?![A-Za-z0-9-])",
    "bik": r"(?iU)(?<!\d)(?:БИК|BIC)\s*[:№#-]?\s*(\d{9})(?!\d)",
    "bank_account": r"(?iU)(?<!\d)(?:р/?с|расч[её]тн(?:ый|ого)?\s+сч[её]т|сч[её]т)\s*[:№#-]?\s*(\d{20})(?!\d)",
    "cvv": r"(?iU)(?<!\w)(?:CVV|CVC|CVV2|CVC2)\s*[:№#-]?\s*(\d{3,4})(?!\d)",
    "birth_label": rf"(?iU)(?:дата\s+рождения|родил(?:ся|ась)|д\.?\s*р\.?|date\s+of\s+birth|birth\s+date)[\s:№#-]{{0,20}}({_DMY}|{_YMD})",
    "birth_behind": rf"(?iU)({_DMY}|{_YMD})\s*(?:г\.?|года)?\s*(?:рождения|рожд\.?)",
    "address_line": r"(?iU)(?:адрес|прожива|регистрац|ул\.|улица|проспект|пр-т|дом|д\.|квартира|кв\.|г\.)[^\n]{0,180}\d[^\n]{0,80}",
    "address_next": r"(?iU)(?:адрес(?:\s+(?:регистрации|фактического\s+проживания|проживания))?|зарегистрирован[а-яё]*\s+по\s+адрес[уа]?|прожива[^\n]{0,50})[^\n:]*[:\n]\s*([^\n]{0,220}\d[^\n]{0,120})",
    "address_words": r"(?iU)\b(?:адрес[уа]?|прожива|регистрац|улица|ул\.|проспект|пр-т|переулок|пер\.|дом|д\.|квартира|кв\.|корпус|строение|город|г\.)\b",
    "mrz": r"(?U)\b[A-Z0-9<]{25,44}\b",
    "identity_document": r"(?iU)паспорт|удостоверени[ея]\s+личности|водительск(?:ое|ие)\s+удостоверени[ея]|identification\s+card|identity\s+card|national\s+id|ob[cč]ansk[yý]\s+pr[uů]kaz|czech\s+republic|ceska\s+republika",
    "fio": r"(?U)(?<![А-Яа-яЁё])([А-ЯЁ][а-яё]{1,}(?:-[А-ЯЁ][а-яё]{1,})?\s+[А-ЯЁ][а-яё]{1,}(?:-[А-ЯЁ][а-яё]{1,})?\s+[А-ЯЁ][а-яё]{2,}(?:-[А-ЯЁ][а-яё]{1,})?)(?![А-Яа-яЁё])",
    "fio_form": r"(?iU)Фамилия\s*[:№#-]?\s*([А-ЯЁ][а-яё-]{1,})\s+Имя\s*[:№#-]?\s*([А-ЯЁ][а-яё-]{1,})\s+Отчество\s*[:№#-]?\s*([А-ЯЁ][а-яё-]{2,})",
    "passport_words": r"(?iU)паспорт|выдан|код\s+подразделения|удостоверени[ея]\s+личности",
    "institution_words": r"(?iU)министерств|университет|институт|школ|гимнази|академи|управлени|департамент|федераци|администраци|комитет|обществ|организаци",
}
#: Endings of patronymics, and keywords of the special categories; the stems match any word that begins with them.
PATRONYMIC = ("вич", "вна", "ич", "инична", "овна", "евна", "ична", "оглы", "кызы")
KEYWORDS = {
    "health_data": ("диагноз", "заболев", "инвалид", "анамнез", "анализ крови", "вич", "справка о здоровье", "лечение", "пациент"),
    "biometric_data": ("биометр", "отпечат", "радуж", "сетчатк", "голосов", "днк", "распознавание лица", "скан лица"),
    "religion": ("вероисповед", "православ", "мусульман", "ислам", "иудаизм", "буддизм"),
    "political_views": ("политические убеждения", "политическая партия", "член партии", "партийность"),
    "nationality": ("национальность", "этническ", "раса", "расовая"),
}
STEMS = ("заболев", "инвалид", "политическ", "этническ")


def matches(text: Column, name: str, group: int = 0) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(text, F.lit(PATTERNS[name]), F.lit(group))


def with_context(text: Column, name: str, group: int, reach: int) -> Column:
    """Matches with the text around them: array of (value, context), context reaching so far on both sides.

    There is no built-in search for places; they follow from the lengths of the matches and of the gaps between them.
    """
    found, gaps = matches(text, name), F.split(text, PATTERNS[name], -1)
    places = F.transform(F.sequence(F.lit(1), F.size(found)), lambda k: F.aggregate(F.slice(gaps, 1, k), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, 1, k - 1), F.lit(0), lambda a, x: a + F.length(x)))
    whole = F.arrays_zip(found.alias("m"), places.alias("at"))
    made = F.transform(whole, lambda z: F.struct(F.regexp_extract(z["m"], PATTERNS[name], group).alias("value"), z["m"].alias("whole"), F.substring(text, F.greatest(z["at"] - reach, F.lit(0)) + 1, F.least(z["at"], F.lit(reach)) + F.length(z["m"]) + reach).alias("context")))
    return F.when(F.size(found) > 0, made).otherwise(F.array().cast("array<struct<value:string,whole:string,context:string>>"))


def _inn(text: Column) -> tuple[Column, Column]:
    found = matches(text, "inn")
    return F.filter(found, lambda m: (F.length(m) == 12) & checks.is_inn_person(m)), F.filter(found, lambda m: (F.length(m) == 10) & checks.is_inn_legal(m))


def _passport(text: Column) -> Column:
    near = F.filter(with_context(text, "passport", 0, 80), lambda z: z["context"].rlike(PATTERNS["passport_words"]))
    return F.transform(near, lambda z: F.concat(F.regexp_extract(z["whole"], PATTERNS["passport"], 1), F.regexp_extract(z["whole"], PATTERNS["passport"], 2)))


def _fio(text: Column) -> Column:
    forms = F.transform(matches(text, "fio_form"), lambda m: F.concat_ws(" ", *(F.regexp_extract(m, PATTERNS["fio_form"], k) for k in (1, 2, 3))))
    ends = r"(?iU)(?:" + "|".join(PATRONYMIC) + r")$"
    named = F.filter(
        with_context(text, "fio", 0, 40),
        lambda z: F.exists(F.split(z["value"], r"(?U)\s+"), lambda w: w.rlike(ends)) & ~z["context"].rlike(PATTERNS["institution_words"]),
    )
    return F.concat(forms, F.transform(named, lambda z: z["value"]))


def _address(text: Column) -> Column:
    words = PATTERNS["address_words"]
    own = F.filter(matches(text, "address_line"), lambda m: m.rlike(words))
    following = F.transform(F.filter(matches(text, "address_next"), lambda m: m.rlike(words)), lambda m: F.regexp_extract(m, PATTERNS["address_next"], 1))
    return F.concat(own, following)


def _keywords(text: Column, words: tuple[str, ...]) -> Column:
    present = [F.when(text.rlike(rf"(?iU)(?<!\w){w}" + ("" if w in STEMS else r"(?!\w)")), F.lit(w)) for w in words]
    return F.array_compact(F.array(*present))


def detectors(text: Column) -> list[tuple[str, Column, float, str, bool]]:
    """(category, matches, confidence, detector, whether repeats count once) in order."""
    person, legal = _inn(text)
    both = (F.size(person) > 0) & (F.size(legal) > 0)
    none = F.array().cast("array<string>")
    mrz = F.filter(matches(text, "mrz"), lambda m: m.contains("<") & (m.contains("RUS") | m.contains("P<") | (F.length(m) - F.length(F.replace(m, F.lit("<"), F.lit(""))) >= 3)))
    found = [
        ("email", matches(text, "email"), 0.95, "regex:email", False),
        ("phone", F.filter(matches(text, "phone"), lambda m: F.length(F.regexp_replace(m, r"(?U)\D", "")) == 11), 0.85, "regex:phone", False),
        ("snils", F.filter(matches(text, "snils"), checks.is_snils), 0.98, "regex+checksum:snils", False),
        ("inn", F.when(both, F.concat(person, legal)).otherwise(none), 0.9, "regex+checksum:inn", False),
        ("inn_person", F.when(both, none).otherwise(person), 0.96, "regex+checksum:inn_person", False),
        ("inn_legal", F.when(both, none).otherwise(legal), 0.8, "regex+checksum:inn_legal", False),
        ("passport_rf", _passport(text), 0.9, "regex+context:passport_rf", False),
        ("bank_card", F.filter(matches(text, "bank_card"), checks.is_luhn), 0.97, "regex+luhn:bank_card", False),
        ("bik", matches(text, "bik", 1), 0.8, "regex+context:bik", False),
        ("bank_account", matches(text, "bank_account", 1), 0.85, "regex+context:bank_account", False),
        ("cvv", matches(text, "cvv", 1), 0.95, "regex+context:cvv", False),
        ("birth_date", F.concat(matches(text, "birth_label", 1), matches(text, "birth_behind", 1)), 0.85, "regex+context:birth_date", False),
        ("address", _address(text), 0.7, "regex+context:address", False),
        ("mrz", mrz, 0.92, "regex:mrz", False),
        ("identity_document", matches(text, "identity_document"), 0.75, "keyword:identity_document", True),
        ("fio", _fio(text), 0.65, "regex+heuristic:fio", False),
    ]
    return found + [(c, _keywords(text, w), 0.6, f"keyword:{c}", True) for c, w in KEYWORDS.items()]


#: What a text must hold for a detector to be tried; without effect on results.
NEEDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"), "mrz": lambda t: t.contains("<"),
    **dict.fromkeys(("phone", "snils", "inn", "inn_person", "inn_legal", "passport_rf", "bank_card", "bik", "bank_account", "cvv", "birth_date", "address"), lambda t: t.rlike(r"(?U)\d{2}")),
    **dict.fromkeys(("fio", *KEYWORDS), lambda t: t.rlike("[А-Яа-яЁё]")),
}
NEEDS["address"] = lambda t: t.rlike(r"(?U)\d")


def _each(values: Column, rule: Callable[[Column], Column]) -> Column:
    return F.transform(values, lambda v: rule(v))


def detect(df: DataFrame, text_col: str = "text", only: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``df`` (without the text) with category, count, confidence, examples and detector of each finding."""
    text, most = F.col(text_col), setting("limits.examples")
    made = []
    for order, (category, found, confidence, name, once) in enumerate(detectors(text)):
        if only and category not in only:
            continue
        found = F.array_distinct(found) if once else found
        found = F.when(NEEDS[category](text), found) if category in NEEDS else found
        made.append(F.struct(F.lit(order).alias("detector_order"), F.lit(category).alias("category"), found.alias("values"), F.lit(confidence).alias("confidence"), F.lit(name).alias("detector")))
    rest = [c for c in df.columns if c != text_col]
    rows = df.where(F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))).select(*rest, F.explode(F.array(*made)).alias("f"))
    rows = rows.where(F.coalesce(F.size("f.values"), F.lit(0)) > 0)
    mask = F.col("f.values")
    masked = mask
    for category, rule in masks.MASKS.items():
        masked = F.when(F.col("f.category") == category, _each(mask, rule)).otherwise(masked)
    return rows.select(*rest, "f.category", F.size("f.values").alias("count"), "f.confidence", F.slice(F.array_distinct(masked), 1, most).alias("examples"), "f.detector", "f.detector_order")


__all__ = ["detect", "detectors", "digits", "matches", "with_context"]
