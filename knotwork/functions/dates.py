"""Dates and conferences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of a speech's date that are tried in turn.
DATE_FORMS = ("MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "yyyy-MM-dd", "d MMMM yyyy")


def speech_date(text: Column | str) -> Column:
    """A date in English; null if it has no known form."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in DATE_FORMS])


def conference_text(year: Column, phase: Column) -> Column:
    """`YYYY-MM`."""
    return F.format_string("%04d-%s", year, phase)


def conference_of(text: Column) -> Column:
    """struct (year, phase) of `YYYY-MM`; every month but 4 is the second conference."""
    return F.struct(F.substring(text, 1, 4).cast("int").alias("year"), F.when(F.substring(text, 6, 2).cast("int") == 4, F.lit("04")).otherwise(F.lit("10")).alias("phase"))
