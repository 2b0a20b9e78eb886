"""Checksums and number formats as column expressions. Digits are ASCII; other digits make a value invalid, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Verhoeff group table, row by row, and the permutation tables. "compat" is the table with whose results
# ours must agree; its third row differs from the textbook's.
GROUP = (
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9,
    1, 2, 3, 4, 0, 6, 7, 8, 9, 5,
    2, 3, 4, 0, 1, 7, 8, 9, 5, 6,
    3, 4, 0, 1, 2, 8, 9, 5, 6, 7,
    4, 0, 1, 2, 3, 9, 5, 6, 7, 8,
    5, 9, 8, 7, 6, 0, 4, 3, 2, 1,
    6, 5, 9, 8, 7, 1, 0, 4, 3, 2,
    7, 6, 5, 9, 8, 2, 1, 0, 4, 3,
    8, 7, 6, 5, 9, 3, 2, 1, 0, 4,
    9, 8, 7, 6, 5, 4, 3, 2, 1, 0,
)
PERMUTATION = {
    "compat": (
        0, 1, 2, 3, 4, 5, 6, 7, 8, 9,
        1, 5, 7, 6, 2, 8, 3, 0, 9, 4,
        5, 8, 0, 9, 1, 6, 7, 4, 3, 2,
        8, 9, 1, 6, 0, 4, 3, 5, 2, 7,
        9, 4, 5, 3, 1, 2, 6, 8, 7, 0,
        4, 2, 8, 6, 5, 7, 3, 9, 0, 1,
        2, 7, 9, 3, 8, 0, 6, 4, 1, 5,
        7, 0, 4, 6, 9, 1, 3, 2, 5, 8,
    ),
}
PERMUTATION["standard"] = PERMUTATION["compat"][:20] + (5, 8, 0, 3, 7, 9, 6, 1, 4, 2) + PERMUTATION["compat"][30:]


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Luhn checksum over the digits, of which there must be twelve or more."""
    digits = digits_only(value)
    return (F.length(digits) >= 12) & F.call_function("luhn_check", digits)


def verhoeff(value: Column, table: str = "compat") -> Column:
    """Verhoeff checksum over exactly twelve digits."""
    digits = F.reverse(digits_only(value))
    group, permutation = (F.lit("".join(map(str, t))) for t in (GROUP, PERMUTATION[table]))
    at = lambda text, i: F.substring(text, i + 1, F.lit(1)).cast("int")
    check = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), lambda c, i: at(group, c * 10 + at(permutation, (i % 8) * 10 + at(digits, i))))
    return F.when(F.length(digits) == 12, check == 0).otherwise(False)


def ipv4(value: Column) -> Column:
    """Four numbers up to 255 without leading zeros."""
    return value.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")
