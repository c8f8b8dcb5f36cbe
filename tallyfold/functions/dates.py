"""Text timestamps in mixed formats, and day ranges for filters.

Timestamps arrive as text in one of three shapes, now and then with a ``+08:00`` suffix. All of them
share one wall clock, so the suffix is dropped and never applied as an offset.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted timestamp shapes and the suffix that carries no meaning.
STAMP_SHAPES = {
    "dash": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    "slash": r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}",
    "iso_t": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
}
OFFSET_SUFFIX = "+08:00"

_ANY_SHAPE = "(?:" + "|".join(shape.lstrip("^") for shape in STAMP_SHAPES.values()) + ")"
_FULL_STAMP = rf"^{_ANY_SHAPE}(?:\+08:00)?$"


def parse_stamp(text: Column) -> Column:
    """Dirty text to ``timestamp_ntz``; anything but the known shapes becomes NULL.

    One cast handles all shapes once the slashes and the suffix are gone, and a zone-less type keeps
    the wall clock whatever the session time zone is.
    """
    trimmed = F.trim(text)
    plain = F.replace(F.replace(trimmed, F.lit(OFFSET_SUFFIX), F.lit("")), F.lit("/"), F.lit("-"))
    return F.when(trimmed.rlike(_FULL_STAMP), plain.try_cast("timestamp_ntz"))


def stamp_shape(text: Column) -> Column:
    """Name of the shape a text timestamp has; ``other`` where none fits, NULL for NULL."""
    shape = F.when(text.isNull(), F.lit(None).cast("string"))
    for name, pattern in STAMP_SHAPES.items():
        shape = shape.when(text.rlike(pattern), F.lit(name))
    return shape.otherwise(F.lit("other"))


def day_key(text: Column) -> Column:
    """``YYYY-MM-DD`` of a dirty text timestamp without parsing it."""
    return F.replace(F.substring(text, 1, 10), F.lit("/"), F.lit("-"))


def month_key(text: Column) -> Column:
    """``YYYY-MM`` of a dirty text timestamp without parsing it."""
    return F.replace(F.substring(text, 1, 7), F.lit("/"), F.lit("-"))


@dataclass(frozen=True)
class Days:
    """A half-open range of days: ``first`` is inside, ``until`` is not."""

    first: date
    until: date

    def holds(self, moment: Column, kind: str = "timestamp_ntz") -> Column:
        """Range test on a typed column, ``kind`` being its type.

        The bounds are literals of the column's own type, so the column is compared without a cast and
        the comparison reaches the Parquet scan, where it prunes row groups.
        """
        return (moment >= F.lit(self.first.isoformat()).cast(kind)) & (moment < F.lit(self.until.isoformat()).cast(kind))


def month(text: str) -> Days:
    """``'1996-03'`` as the range of its days."""
    year, number = (int(part) for part in text.split("-"))
    following = date(year + number // 12, number % 12 + 1, 1)
    return Days(date(year, number, 1), following)


def days(first: str, last: str) -> Days:
    """Both ends inclusive."""
    return Days(date.fromisoformat(first), date.fromisoformat(last) + timedelta(days=1))
