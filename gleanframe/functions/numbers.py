"""Numbers in loosely typed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?$"
WORDS = r"(?i)^[+-]?(?:nan|inf|infinity)$"


def as_number(value: Column, kind: T.DataType | None = None) -> Column:
    """The value as a double if it plausibly is one, else null.

    Booleans are no numbers. In text, commas are dropped and single underscores may part digits;
    a trailing type letter, which a cast would take, is refused.
    """
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("double")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    text = F.trim(F.replace(value.cast("string"), F.lit(","), F.lit("")))
    return F.when(text.rlike(NUMBER) | text.rlike(WORDS), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def is_whole(number: Column) -> Column:
    return ~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))) & (number == F.floor(number))


def number_text(number: Column) -> Column:
    """A number for messages: whole ones without a point, others with six significant digits and no trailing zeros."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", number), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(is_whole(number), number.cast("bigint").cast("string")).otherwise(short)


def key_forms(value: Column, kind: T.DataType | None = None) -> list[Column]:
    """The texts under which a value may stand as a map key, in order: its own, and that of the whole number it is (else null)."""
    if isinstance(kind, T.BooleanType):
        return [F.when(value, "True").otherwise("False")]
    number = as_number(value, kind)
    return [value.cast("string"), F.when(is_whole(number), number.cast("bigint").cast("string"))]
