"""Dotted versions as comparable columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """Numbers of the part before the first - or +, without zeros at the end: arrays compare element by element, the shorter first. What is no number counts as 0."""
    head = F.get(F.split(version, "[-+]"), 0)
    numbers = F.transform(F.split(head, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^\s*(\d{1,18})", 1).try_cast("long"), F.lit(0)))
    return F.slice(numbers, 1, F.array_max(F.transform(numbers, lambda x, i: F.when(x > 0, i + 1).otherwise(0))))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    x, y = version_key(a), version_key(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def is_unresolved_version(version: Column) -> Column:
    """A property, range or other expression that no static reading can evaluate."""
    return version.rlike(r"[${}\[\](),]") | ~version.rlike(r"^\d")
