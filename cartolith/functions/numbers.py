"""Text of doubles: the JSON style (34.0) and the plain style (34), as native expressions and in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(x: Column) -> Column:
    """Shortest digits without an exponent, for magnitudes of coordinates and distances."""
    text = x.cast("string")
    wide = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"0+$", "")
    return F.when(text.contains("E"), F.regexp_replace(wide, r"\.$", ".0")).otherwise(text)


def json_number(x: Column) -> Column:
    return _digits(x)


def plain_number(x: Column) -> Column:
    return F.regexp_replace(_digits(x), r"\.0$", "")


def json_text(x: float) -> str:
    """As json_number, for any magnitude: an exponent only below 1e-5 or from 1e16."""
    text = repr(float(x))
    if "e" in text:
        mantissa, _, power = text.partition("e")
        return f"{mantissa.removesuffix('.0')}e{int(power)}"
    return text


def plain_text(x: float) -> str:
    text = repr(float(x))
    if "e" in text:
        text = f"{float(x):.400f}".rstrip("0") if abs(x) < 1 else f"{float(x):.1f}"
        text = text + "0" if text.endswith(".") else text
    return text.removesuffix(".0")
