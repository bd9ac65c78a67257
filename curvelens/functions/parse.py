"""Text to steps and values, by the grammar of Python numbers and without rounding steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curvelens.model import MAX_STEP

# Fixed patterns: Python's float grammar (underscores between digits), and plain decimal numbers.
_DIGITS = "[0-9](?:_?[0-9])*"
FLOAT = rf"^[+-]?(?:(?:{_DIGITS}[.]?(?:{_DIGITS})?|[.]{_DIGITS})(?:[eE][+-]?{_DIGITS})?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
NUMBER = "^([+-]?)([0-9]*)(?:[.]([0-9]*))?(?:[eE]([+-]?[0-9]{1,3}))?$"
ABSENT = ["", "none", "null"]


def float_value(text: Column) -> Column:
    """The number a cell holds, or NULL; the suffixes that a cast would take (1d, 1.5f) are no numbers."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(FLOAT), F.regexp_replace(trimmed, "_", "").try_cast("double"))


def step_value(text: Column) -> Column:
    """The exact integer a cell holds (100, 100.0, 1e2), within 2**53 - 1, or NULL."""
    trimmed = F.trim(text)
    digits = F.concat(F.regexp_extract(trimmed, NUMBER, 2), F.regexp_extract(trimmed, NUMBER, 3))
    power = F.coalesce(F.regexp_extract(trimmed, NUMBER, 4).try_cast("int"), F.lit(0))
    # digits * 10**(power - decimals): an integer if what falls behind the point is zeros
    shift = power - F.length(F.regexp_extract(trimmed, NUMBER, 3))
    keep = F.length(digits) + shift
    whole = F.when(shift >= 0, F.concat(digits, F.repeat(F.lit("0"), F.least(shift, F.lit(40)).cast("int")))).when(keep > 0, F.substring(digits, F.lit(1), keep.cast("int"))).otherwise(F.lit("0"))
    rest = F.when(shift >= 0, F.lit("")).when(keep > 0, F.substring(digits, (keep + 1).cast("int"), F.length(digits))).otherwise(digits)
    bare = F.regexp_replace(whole, "^0+(?=.)", "")
    number = F.concat(F.regexp_extract(trimmed, NUMBER, 1), F.when(F.length(bare) <= 16, bare)).try_cast("long")
    return F.when(trimmed.rlike(NUMBER) & (digits != "") & rest.rlike("^0*$") & (F.abs(number) <= MAX_STEP), number)


def value_state(text: Column) -> Column:
    """absent (no row), value, or unreadable (a row with NULL)."""
    trimmed = F.lower(F.trim(text))
    return F.when(text.isNull() | trimmed.isin(ABSENT), "absent").when(float_value(text).isNotNull(), "value").otherwise("unreadable")


def decimal_point(text: Column, delimiter: str) -> Column:
    """0,75 as 0.75 where the delimiter is not a comma."""
    if delimiter == ",":
        return text
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+,[0-9]+([eE][+-]?[0-9]+)?$"), F.replace(text, F.lit(","), F.lit("."))).otherwise(text)


def shown_number(value: Column) -> Column:
    """NaN and infinities as the strings that JSON reports use."""
    return F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(value.cast("string"))
