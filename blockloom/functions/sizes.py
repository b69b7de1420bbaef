"""Sizes as text and text as sizes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = (("B", 0), ("KB", 10), ("MB", 20), ("GB", 30))


def human_size(n: Column) -> Column:
    """Whole units; a terabyte and more is given in bytes again."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, shift in reversed(UNITS[1:]):
        out = F.when((n >= 1 << shift) & (n < 1 << (shift + 10)), F.concat(F.shiftright(n, shift).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def parsed_size(text: Column) -> Column:
    """Bytes of a literal such as 12, 8m or 2G; null if it is none."""
    number = F.regexp_extract(text, r"^([0-9]+)[kKmMgG]?$", 1)
    unit = F.lower(F.regexp_extract(text, r"([kKmMgG])$", 1))
    times = F.when(unit == "k", F.lit(1 << 10)).when(unit == "m", F.lit(1 << 20)).when(unit == "g", F.lit(1 << 30)).otherwise(F.lit(1))
    return F.when(number != "", number.try_cast("long") * times)
