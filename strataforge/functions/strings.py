"""Scalar functions of the reports, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shorten(c: Column, width: int) -> Column:
    """Cut out the middle: at most ``width`` characters, ``...`` in between."""
    if width <= 6:
        return F.substring(c, 1, width)
    half = (width - 3) // 2
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.substring(c, 1, half), F.lit("..."), F.right(c, F.lit(half))))


def plain(c: Column) -> Column:
    """Without ANSI colours."""
    return F.regexp_replace(c, "\x1b\\[[0-9;]*m", "")


def dotted(label: Column, width: int) -> Column:
    """Label filled up with dots."""
    return F.rpad(label, width, ".")


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def short_id(c: Column) -> Column:
    return F.substring(c, 1, 7)


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c)


def log_date(ts: Column) -> Column:
    """``Mon Jan 2 15:04:05 2006 +0000`` in the session's time zone."""
    return F.date_format(ts, "EEE MMM d HH:mm:ss yyyy Z")
