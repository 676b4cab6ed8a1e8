"""Scalar expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procera.schema import MISSING_TEXT, NO_MONTH, OTHER_TYPE

#: Tried in this order for every value by itself, so a row's result never depends on other rows.
DATE_PATTERNS = tuple(
    f"{day}{time}"
    for day, times in (
        ("d/M/yyyy", ("", " H:mm", " H:mm:ss")),
        ("yyyy-MM-dd", ("", " HH:mm", " HH:mm:ss", "'T'HH:mm", "'T'HH:mm:ss")),
        ("d-M-yyyy", ("", " H:mm", " H:mm:ss")),
        ("d/M/yy", ("", " H:mm", " H:mm:ss")),
    )
    for time in times
)
#: Two-digit years up to this one are of the present century, later ones of the last.
LAST_SHORT_YEAR = 2068


def _parsed(text: Column, pattern: str) -> Column:
    at = F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
    if "yyyy" in pattern:
        return at
    return F.when(F.year(at) > LAST_SHORT_YEAR, at - F.make_ym_interval(F.lit(100))).otherwise(at).cast("timestamp_ntz")


def parse_date(text: Column) -> Column:
    """Text to timestamp without zone; NULL where no pattern fits (never an error)."""
    return F.coalesce(*(_parsed(text, p) for p in DATE_PATTERNS))


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_or_marker(ts: Column) -> Column:
    """The month, or the literal group key used for undated rows."""
    return F.coalesce(month(ts), F.lit(NO_MONTH))


def short_name(name: Column) -> Column:
    """First two white-space separated tokens."""
    return F.array_join(F.slice(F.split(F.trim(name), r"\s+"), 1, 2), " ")


def first_token(name: Column) -> Column:
    return F.split(F.trim(name), r"\s+")[0]


def whole(mean: Column) -> Column:
    """Mean truncated toward zero; 0 when there was nothing to average."""
    return F.coalesce(mean, F.lit(0.0)).cast("int")


def day_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd/MM/yyyy"), F.lit(MISSING_TEXT))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def truncated_header(value: str | None, taken: set[str], width: int = 12) -> str:
    """Pivot header cut to `width`; a suffix keeps two cut headers apart."""
    base = (value or "")[:width] or OTHER_TYPE
    name, n = base, 2
    while name in taken:
        name, n = f"{base}~{n}", n + 1
    taken.add(name)
    return name
