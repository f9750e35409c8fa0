"""Calendar labels and the conventions of written timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quarter(day: Column) -> Column:
    """YYYYQn; string order is time order."""
    return F.concat(F.year(day), F.lit("Q"), F.quarter(day))


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def quarters_between(start: Column, stop: Column) -> Column:
    """Labels of every quarter from the first day's to the last day's."""
    return F.transform(F.sequence(F.trunc(start, "quarter"), F.trunc(stop, "quarter"), F.expr("interval 3 months")), quarter)


def convention(written: Column, utc: Column) -> Column:
    """How a written time without zone stands to a known instant: utc, eastern or neither."""
    wall = written.cast("timestamp_ntz").cast("timestamp")
    return F.when(written.isNull() | utc.isNull(), None).when(wall == utc, "utc").when(wall == F.from_utc_timestamp(utc, "America/New_York"), "eastern").otherwise("neither")
