"""Mod-97 checks and check digits by digit folds, without big integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(s: Column) -> Column:
    """Letters as 10 to 35, digits as themselves (single characters, so borders compare them)."""
    return F.array_join(F.transform(F.split(F.upper(s), ""), lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def mod97(s: Column) -> Column:
    """Of a string of digits; other characters are passed over."""
    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise(acc))


def iban_ok(s: Column) -> Column:
    bare = F.regexp_replace(s, " ", "")
    return mod97(_digits(F.concat(F.substring(bare, 5, 60), F.substring(bare, 1, 4)))) == 1


def lei_ok(s: Column) -> Column:
    return mod97(_digits(s)) == 1


def check_digits(body: Column) -> Column:
    """Two digits that make body || digits congruent to 1."""
    return F.lpad((98 - mod97(_digits(F.concat(body, F.lit("00"))))).cast("string"), 2, "0")
