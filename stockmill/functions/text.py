"""Number formatting and parsing for report cells."""

from pyspark.sql import functions as F

# Marks removed before a cell is read as a number
_MARKS = "[,¥％%]"
_INTEGER = r"^[+-]?[0-9]+$"
_DECIMAL = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def format_money(amount):
    """Thousands separators, no decimals."""
    return F.format_number(F.col(amount), 0)


def parse_number(text):
    """The cell as a number, or NULL when it is not one."""
    cleaned = F.regexp_replace(F.trim(F.col(text)), _MARKS, "")
    numeric = cleaned.rlike(_INTEGER) | cleaned.rlike(_DECIMAL)
    return F.when(numeric, cleaned.try_cast("double"))


def parse_text(text):
    """The cell as text when it is not a number; a missing cell becomes empty text."""
    return F.when(parse_number(text).isNull(), F.coalesce(F.col(text), F.lit("")))
