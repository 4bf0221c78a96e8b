"""Text to number, the strict way.

``try_cast('1d' as double)`` is 1.0 and ``try_cast('nan' as double)`` is NaN in Spark, while the
number parser the templates were written for gives a missing value for both. A shape test in front
of the cast keeps the two in line: signed decimal with optional exponent, surrounding blanks
allowed, or an infinity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Accepted number shapes.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def to_num(c: Column | str, dtype=None) -> Column:
    """Double value of a text (or numeric) column; unparsable text gives null."""
    c = F.col(c) if isinstance(c, str) else c
    if dtype is not None and isinstance(dtype, NumericType):
        return c.cast("double")
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def to_whole(c: Column | str, dtype=None) -> Column:
    """Long value when the number has no fraction; null otherwise (counted as a failure)."""
    x = to_num(c, dtype)
    return F.when(x == F.floor(x), x.try_cast("long"))
