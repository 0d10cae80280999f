"""Checksums as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(span: Column) -> Column:
    return F.regexp_replace(span, "[ -]", "")


def luhn(span: Column) -> Column:
    """13 to 19 digits, blanks and dashes aside, whose Luhn sum holds."""
    d = digits_of(span)
    return d.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", d)


def aba(span: Column) -> Column:
    """Nine digits with weights 3, 7, 1 summing to a multiple of ten."""
    d = F.regexp_replace(span, r"\D", "")
    total = sum((F.substring(d, k + 1, 1).cast("int") * (3, 7, 1)[k % 3] for k in range(9)), F.lit(0))
    return (F.length(d) == 9) & (total % 10 == 0)


def iban(span: Column) -> Column:
    """The mod-97 check: country and check digits moved to the end, letters as 10 to 35."""
    s = F.upper(F.regexp_replace(span, " ", ""))
    turned = F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[A-Z]"), (acc * 100 + F.ascii(c) - 55) % 97).when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise(acc),
    )
    return F.length(s).between(15, 34) & (rest == 1)


#: Check name to (expression, score of a hit that holds; None keeps the pattern's).
CHECKS = {"luhn": (luhn, None), "aba": (aba, 1.0), "iban": (iban, 1.0)}
