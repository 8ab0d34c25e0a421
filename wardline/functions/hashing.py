"""Deterministic content hashes: sampling (F2), random splits and coin flips that survive task retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crc(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes."""
    return F.crc32(F.encode(text, "UTF-8"))


def keep_one_in(text: Column, n: int | Column) -> Column:
    """F2. True for about one text in ``n``, always the same ones."""
    return crc(text) % n == 0


def unit_hash(text: Column, salt: str = "") -> Column:
    """Uniform number in [0, 1) from the first 32 bits of an MD5 over salt and text."""
    digest = F.md5(F.concat(F.lit(salt), text))
    return F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)
