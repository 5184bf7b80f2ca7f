"""Tests of strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_numeric(value: Column | str) -> Column:
    """Whether a string has decimal digits only; true for the empty string."""
    return (F.col(value) if isinstance(value, str) else value).rlike(r"^[0-9]*\z")
