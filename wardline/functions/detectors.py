"""Pattern detectors D1-D3 over normalized text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import patterns as P

FLAGS = "(?iuU)"
# The matching engine's own \b and \s differ from the guard's: it counts marks, joiners and connector punctuation as word
# characters, and leaves the four information separators out of white space.
_WORD = r"[\p{L}\p{N}_]"
_BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_SEPARATORS = r"\x1C-\x1F"


def compiled(pattern: str) -> str:
    """A fixed pattern as this engine must read it: flags, explicit word boundaries, white space with separators."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        token = pattern[i:i + 2] if pattern[i] == "\\" else pattern[i]
        if token == "\\b" and not in_class:
            out.append(_BOUNDARY)
        elif token == "\\s":
            out.append(rf"\s{_SEPARATORS}" if in_class else rf"[\s{_SEPARATORS}]")
        else:
            in_class = token == "[" or (in_class and token != "]")
            out.append(token)
        i += len(token)
    return FLAGS + "".join(out)


def alternation(pieces: tuple[str, ...]) -> str:
    return "(" + "|".join(pieces) + ")"


DETECTORS = {
    "prompt_injection": alternation(P.PROMPT_INJECTION),
    "jailbreak": alternation(P.JAILBREAK),
    "toxic_content": alternation(P.TOXIC_CONTENT),
}


def may_match(norm: Column, name: str) -> Column:
    """Cheap necessary condition: substring searches instead of a pattern walk."""
    tests = [norm.contains(needle) for needle in (*P.NEEDS[name], P.DOTLESS_I)]
    tests += [norm.contains(word) & norm.rlike(f"{word}(?<!{_WORD}{word})(?!{_WORD})") for word in P.NEEDS_WORD[name]]
    return reduce(lambda a, b: a | b, tests)


def first_match(norm: Column, name: str) -> Column:
    """Text of the first hit of detector ``name`` in normalized text, or the empty string."""
    found = F.when(may_match(norm, name), F.regexp_extract(norm, compiled(f"(?=[{P.STARTS[name]}])" + DETECTORS[name]), 1))
    return F.when(norm.isNotNull(), F.coalesce(found, F.lit("")))


def check_result(passed: Column, score: Column, reason: Column, action: Column) -> Column:
    """One check outcome as a struct (latency has no meaning for a row of a batch stage)."""
    return F.struct(passed.alias("passed"), score.alias("score"), reason.alias("reason"), action.alias("action"))


def pattern_result(match: Column, name: str) -> Column:
    """D1-D3 outcome from the matched text."""
    hit = match != ""
    reason = F.when(hit, F.concat(F.lit(P.HIT_REASON[name] + ": '"), match, F.lit("'"))).otherwise(
        F.lit(P.CLEAR_REASON[name])
    )
    return check_result(
        ~hit,
        F.when(hit, F.lit(0.0)).otherwise(F.lit(1.0)),
        reason,
        F.when(hit, F.lit("block")).otherwise(F.lit("allow")),
    )
