"""Bit arithmetic on 64-bit integers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_code(value: Column | str) -> Column:
    """A 64-bit xorshift of a non-negative integer: left 13, right 17 (unsigned), left 5."""
    x = (F.col(value) if isinstance(value, str) else value).cast("long")
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 17))
    return x.bitwiseXOR(F.shiftleft(x, 5))
