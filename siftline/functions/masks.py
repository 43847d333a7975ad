"""Masks of found values as column expressions; a value too short to be masked in part is masked whole where the kind says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.checks import digits


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)).cast("int"))


def email(v: Column) -> Column:
    local, domain = F.regexp_extract(v, "^([^@]*)@", 1), F.regexp_extract(v, "^[^@]*@(.*)$", 1)
    hidden = F.when(F.length(local) <= 2, F.concat(F.left(local, F.lit(1)), F.lit("*"))).otherwise(F.concat(F.left(local, F.lit(1)), F.lit("***"), F.right(local, F.lit(1))))
    return F.concat(hidden, F.lit("@"), domain)


def number(v: Column) -> Column:
    d = digits(v)
    return F.when(F.length(d) <= 4, _stars(F.length(d))).otherwise(F.concat(_stars(F.length(d) - 4), F.right(d, F.lit(4))))


def snils(v: Column) -> Column:
    d = digits(v)
    return F.concat(F.lit("***-***-"), F.substring(d, 7, 3), F.lit(" "), F.right(d, F.lit(2)))


def ends(head: int, tail: int, of_digits: bool = True):  # noqa: ANN201
    """A mask that leaves the first and the last characters."""

    def mask(v: Column) -> Column:
        d = digits(v) if of_digits else v
        return F.concat(F.left(d, F.lit(head)), _stars(F.length(d) - head - tail), F.right(d, F.lit(tail)))

    return mask


def passport(v: Column) -> Column:
    return F.concat(F.left(digits(v), F.lit(2)), F.lit(" ** ******"))


def every_digit(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)\d", "*")


def address(v: Column) -> Column:
    flat = F.trim(F.regexp_replace(v, r"(?U)\s+", " "))
    return F.when(F.length(flat) > 70, F.concat(F.left(flat, F.lit(70)), F.lit("..."))).otherwise(flat)


def initials(v: Column) -> Column:
    words = F.filter(F.split(v, r"(?U)\s+"), lambda x: x != "")
    return F.array_join(F.transform(words, lambda x: F.concat(F.left(x, F.lit(1)), F.lit("***"))), " ")


MASKS = {
    "email": email, "phone": number, "snils": snils, "inn_person": ends(2, 2), "inn_legal": ends(2, 2), "inn": ends(2, 2), "passport_rf": passport, "bank_card": ends(6, 4), "bik": number,
    "bank_account": ends(5, 4), "cvv": number, "birth_date": every_digit, "address": address, "mrz": ends(5, 5, False), "identity_document": lambda v: F.left(v, F.lit(40)), "fio": initials,
}
