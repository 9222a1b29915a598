"""String functions: folding, redaction, versions, templates, key=value lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(c: Column) -> Column:
    """Lower case, letters only."""
    return F.regexp_replace(F.lower(c), r"[^a-z]+", "")


def snake(c: Column) -> Column:
    """A header as a name: lower case, runs of other characters as one underscore, percent spelled out."""
    named = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, "﻿", ""))), "%", " pct ")
    return F.regexp_replace(F.regexp_replace(named, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def redacted(c: Column) -> Column:
    """E-mail addresses and runs of six digits or more are masked."""
    return F.regexp_replace(F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<mail>"), r"[0-9]{6,}", "<number>")


def field_of(c: Column, name: str) -> Column:
    """The value of ``name=value`` in a line; null if there is none."""
    found = F.regexp_extract(c, rf"(?:^|\s){name}=(\S+)", 1)
    return F.when(found != "", found)


def version_key(c: Column) -> Column:
    """Dotted integers as an array that compares by number."""
    return F.transform(F.split(c, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def duration(seconds: Column) -> Column:
    """``1h 05m`` or ``5m``."""
    minutes = F.floor(seconds / 60)
    return F.when(minutes >= 60, F.concat(F.floor(minutes / 60), F.lit("h "), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit("m"))).otherwise(F.concat(minutes, F.lit("m")))
