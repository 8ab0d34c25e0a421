"""Robustness rewrites T13-T17. ``PERTURBATIONS`` maps a name to a ``Column -> Column``."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import patterns as P
from wardline.functions.text import collapse_spaces

_PRINTABLE = "".join(chr(c) for c in range(0x21, 0x7F))
_FULLWIDTH = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))

ZERO_WIDTH_SPACE = "\u200b"


def words(text: Column) -> Column:
    return F.split(collapse_spaces(text), " ")


def leetspeak(text: Column) -> Column:
    return F.translate(F.lower(text), P.PERTURB_LEET_FROM, P.PERTURB_LEET_TO)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used: inside a lambda nothing else shares it."""
    return F.transform(F.array(value), use)[0]


def typos(text: Column, rate: float = 0.3) -> Column:
    """T15. Swap two inner letters in about ``rate`` of the words longer than four characters.

    The coin and the place come from an MD5 of position and word, so a retried task repeats them.
    """

    def coin(digest: Column) -> Column:
        """Whether the first four hex digits, as parts of 65536, are below ``rate``; digits sort as the numbers they spell."""
        return F.lit(True) if rate >= 1 else digest < f"{math.ceil(max(rate, 0) * 65536):04x}"

    def maybe_swap(word: Column, i: Column) -> Column:
        n = F.char_length(word)

        def swapped(at: Column) -> Column:
            return F.concat(
                F.substr(word, F.lit(1), at), F.substr(word, at + 2, F.lit(1)),
                F.substr(word, at + 1, F.lit(1)), F.substr(word, at + 3),
            )

        def drawn(digest: Column) -> Column:
            draw = F.conv(F.substr(digest, F.lit(5), F.lit(4)), 16, 10).cast("int")
            return F.when(coin(digest), _bound((draw % (n - 3) + 1).cast("int"), swapped)).otherwise(word)

        return F.when(n > 4, _bound(F.md5(F.concat(i.cast("string"), F.lit(":"), word)), drawn)).otherwise(word)

    return F.array_join(F.transform(words(text), maybe_swap), " ")


def zero_width(text: Column) -> Column:
    return F.regexp_replace(collapse_spaces(text), "(?<=[^ ])(?=[^ ])", ZERO_WIDTH_SPACE)


PERTURBATIONS = {
    "uppercase": F.upper,
    "leetspeak": leetspeak,
    "typos": typos,
    "extra_spaces": lambda t: F.array_join(words(t), "  "),
    "benign_padding": lambda t: F.concat(F.lit(P.PADDING_BEFORE), t, F.lit(P.PADDING_AFTER)),
    "fullwidth": lambda t: F.translate(t, _PRINTABLE, _FULLWIDTH),
    "zero_width": zero_width,
}
