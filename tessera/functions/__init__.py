"""Column functions: every one returns a Spark ``Column`` built from built-in expressions."""

from .dates import parse_timestamp
from .numbers import to_num, to_whole
from .text import (
    header_norm,
    month_token,
    snake_case,
    strip_thousands,
    trim_ws,
    year_month_label,
)

__all__ = [
    "header_norm",
    "month_token",
    "parse_timestamp",
    "snake_case",
    "strip_thousands",
    "to_num",
    "to_whole",
    "trim_ws",
    "year_month_label",
]
