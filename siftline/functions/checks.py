"""Check digits as column expressions; all give false, never an error, on anything that is not the right digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    """The decimal digits of a string."""
    return F.regexp_replace(value, "[^0-9]", "")


def _once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` of a value that is computed once, however often the rule names it; null counts as false."""
    return F.coalesce(F.element_at(F.transform(F.array(value), lambda v: rule(v)), 1), F.lit(False))


def _weighted(value: Column, weights: list[int]) -> Column:
    """Sum of the leading digits by weight; null where there are too few."""
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + F.substring(value, k + 1, 1).try_cast("int") * w
    return total


def is_snils(value: Column) -> Column:
    """Insurance number: 11 digits, number part above 1001998, weights 9 to 1 modulo 101, where 100 counts as 0."""
    return _once(digits(value), lambda d: (F.length(d) == 11) & (F.substring(d, 1, 9).try_cast("int") > 1001998) & (_weighted(d, list(range(9, 0, -1))) % 101 % 100 == F.substring(d, 10, 2).try_cast("int")))


def is_inn_legal(value: Column) -> Column:
    """10-digit tax number of an organisation."""
    return _once(digits(value), lambda d: (F.length(d) == 10) & (_weighted(d, [2, 4, 10, 3, 5, 9, 4, 6, 8]) % 11 % 10 == F.substring(d, 10, 1).try_cast("int")))


def is_inn_person(value: Column) -> Column:
    """12-digit tax number of a person, with two check digits."""
    weights = ([7, 2, 4, 10, 3, 5, 9, 4, 6, 8], [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8])
    return _once(digits(value), lambda d: (F.length(d) == 12) & (_weighted(d, weights[0]) % 11 % 10 == F.substring(d, 11, 1).try_cast("int")) & (_weighted(d, weights[1]) % 11 % 10 == F.substring(d, 12, 1).try_cast("int")))


def is_luhn(value: Column) -> Column:
    """Luhn check over 13 to 19 digits of which at least two differ."""
    return _once(digits(value), lambda d: F.length(d).between(13, 19) & (F.length(F.replace(d, F.left(d, F.lit(1)), F.lit(""))) > 0) & F.call_function("luhn_check", d))


CHECKS = {"is_snils": is_snils, "is_inn_legal": is_inn_legal, "is_inn_person": is_inn_person, "is_luhn": is_luhn}


def register(spark: SparkSession) -> None:
    """Make the checks callable in SQL, as SQL functions that the optimiser sees through."""
    for name in CHECKS:
        body = {
            "is_luhn": "coalesce(length(regexp_replace(v,'[^0-9]','')) between 13 and 19 and luhn_check(regexp_replace(v,'[^0-9]','')) and size(array_distinct(split(regexp_replace(v,'[^0-9]',''),''))) > 1, false)",
        }.get(name)
        if body:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS BOOLEAN RETURN {body}")
        else:
            weights = {"is_snils": [list(range(9, 0, -1))], "is_inn_legal": [[2, 4, 10, 3, 5, 9, 4, 6, 8]], "is_inn_person": [[7, 2, 4, 10, 3, 5, 9, 4, 6, 8], [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]]}[name]
            d = "regexp_replace(v,'[^0-9]','')"
            sums = ["(" + "+".join(f"try_cast(substr({d},{k + 1},1) as int)*{w}" for k, w in enumerate(ws)) + ")" for ws in weights]
            if name == "is_snils":
                rule = f"length({d})=11 and try_cast(substr({d},1,9) as int) > 1001998 and {sums[0]}%101%100 = try_cast(substr({d},10,2) as int)"
            else:
                size = len(weights[-1]) + 1
                rule = f"length({d})={size} and " + " and ".join(f"{s}%11%10 = try_cast(substr({d},{len(ws) + 1},1) as int)" for s, ws in zip(sums, weights, strict=True))
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS BOOLEAN RETURN coalesce({rule}, false)")
