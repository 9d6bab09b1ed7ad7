"""Naming a subexpression inside one column, and trimming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once and named, instead of repeated in the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# The characters Unicode counts as white space.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Trim every Unicode white space (``trim`` alone takes only the blank)."""
    return F.btrim(text, F.lit(WHITE_SPACE))
