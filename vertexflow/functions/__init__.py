"""Column functions of the engine."""

from .bits import hash_code
from .text import is_numeric

__all__ = ["hash_code", "is_numeric"]
