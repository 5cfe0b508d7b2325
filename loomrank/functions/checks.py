"""Conditions that must hold for every row that is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(condition: Column, value: Column, message) -> Column:
    """The value where the condition holds; false or null raises."""
    return F.when(condition, value).otherwise(F.raise_error(message if isinstance(message, Column) else F.lit(message)))


def holds(condition: Column, message) -> Column:
    """True, or an error; for filters."""
    return checked(condition, F.lit(True), message)
