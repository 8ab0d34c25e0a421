"""Decimal rendering that rounds the exact binary value half to even, as Python's formatting does.

``round`` and ``format_string`` work on the shortest decimal form instead and differ on ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimals and no grouping."""
    return F.translate(F.format_number(value, digits), ",", "")


def rounded(value: Column, digits: int) -> Column:
    return fixed(value, digits).cast("double")
