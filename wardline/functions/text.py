"""Text column functions: normalization (T1-T5), segments and n-grams (T6-T8), windows (T12), links.

Everything here is ``Column -> Column`` and stays inside the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import patterns as P

# Unicode white space plus the four ASCII separators, i.e. what str.split() splits on.
# Spelled out, because explicit ranges match several times faster than the Unicode property behind (?U).
_OTHER_SPACES = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = f"[ {_OTHER_SPACES}]"
_ALL_SPACES = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
)
# Text made only of ASCII and U+00C0-U+00FF letters is already in NFKC form.
_MAY_CHANGE_UNDER_NFKC = r"[^\x00-\x7F\u00C0-\u00FF]"
_LEET = "[013457@$]"
# A noncharacter: never part of interchanged text.
SENTENCE_MARK = "\uFDD0"
WORD_CHARS = r"[\p{L}\p{N}_]"


@F.pandas_udf(T.StringType())
def _nfkc_arrow(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def nfkc(text: Column, engine: str = "jvm") -> Column:
    """T1. NFKC form. Rows that cannot change skip the call.

    ``jvm`` calls the ICU library Spark ships through ``java_method``, so no row leaves the JVM;
    ``arrow`` is the pandas twin for clusters whose class path lacks ICU.
    """
    if engine == "arrow":
        needed = F.when(text.rlike(_MAY_CHANGE_UNDER_NFKC), text)
        return F.coalesce(_nfkc_arrow(needed), text)
    folded = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return (
        F.when(text.isNull(), text)
        .when(F.octet_length(text) == F.char_length(text), text)
        .when(~text.rlike(_MAY_CHANGE_UNDER_NFKC), text)
        .otherwise(folded)
    )


def drop_invisible(text: Column) -> Column:
    """T2. Remove zero-width, bidi-control and soft-hyphen characters."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, text).otherwise(F.regexp_replace(text, P.INVISIBLE_CHARS, ""))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    # A map of characters and a literal cost less than the classes of a pattern, tried at every character.
    return F.trim(F.regexp_replace(F.translate(text, _ALL_SPACES, " " * len(_ALL_SPACES)), "  +", " "))


def unleet_words(spaced: Column) -> Column:
    """T3. Undo leetspeak in words holding an ASCII letter; ``spaced`` has single spaces only."""
    fixed = F.transform(
        F.split(spaced, " "),
        lambda w: F.when(w.rlike(_LEET) & w.rlike("[A-Za-z]"), F.translate(w, P.LEET_FROM, P.LEET_TO)).otherwise(w),
    )
    return F.array_join(fixed, " ")


def strip(text: Column) -> Column:
    """Python ``str.strip``: white space of every kind off both ends."""
    return F.trim(text, F.lit(_ALL_SPACES))


def norm_key(text: Column) -> Column:
    """T5. Comparison key of benchmark prompts: lower case, single spaces."""
    return collapse_spaces(F.lower(text))


def with_normalized(df, text: str = "text", out: str = "norm", engine: str = "jvm"):
    """T1-T4 as staged projections, so each step is evaluated once per row."""
    staged = df.withColumn(out, nfkc(F.col(text), engine))
    staged = staged.withColumn(out, collapse_spaces(drop_invisible(F.col(out))))
    return staged.withColumn(
        out,
        F.lower(F.when(F.col(out).rlike(_LEET), unleet_words(F.col(out))).otherwise(F.col(out))),
    )


def sentences(text: Column) -> Column:
    """T6. Non-blank pieces after ``.!?`` plus white space, or at newlines."""
    pieces = F.split(text, r"(?<=[.!?])" + SPACE_CLASS + r"+|\n+")
    return F.filter(pieces, lambda s: s.rlike(f"[^ {_OTHER_SPACES}]"))


def segments(text: Column) -> Column:
    """T6. The whole text, followed by its sentences when there is more than one."""
    return F.transform(
        F.array(sentences(text)),
        lambda parts: F.concat(F.array(text), F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))),
    )[0]


def mark_sentences(text: Column) -> Column:
    """T6 for scorers: sentence boundaries become ``SENTENCE_MARK``, so that the text can be normalized
    once and still be cut into its sentences. Blank sentences are gone."""
    mark = f" {SENTENCE_MARK} "
    marked = F.regexp_replace(text, r"(?<=[.!?])" + SPACE_CLASS + r"+|\n+", mark)
    single = F.regexp_replace(marked, f"{SENTENCE_MARK}(?:{SPACE_CLASS}*{SENTENCE_MARK})+", SENTENCE_MARK)
    return F.regexp_replace(
        single, f"^{SPACE_CLASS}*{SENTENCE_MARK}|{SENTENCE_MARK}{SPACE_CLASS}*$", ""
    )


def word_tokens(norm: Column) -> Column:
    """T7. Runs of two or more word characters."""
    return F.regexp_extract_all(norm, F.lit("(" + WORD_CHARS + "{2,})"), 1)


def word_ngrams(norm: Column) -> Column:
    """T7. Words and adjacent word pairs."""
    return F.transform(
        F.array(word_tokens(norm)),
        lambda t: F.concat(t, F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))),
                                         F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                                         lambda a, b: F.concat_ws(" ", a, b))),
    )[0]


def _cut(padded: Column, length: Column, low: int, high: int) -> Column:
    return F.flatten(
        F.transform(
            F.sequence(F.lit(low), F.least(F.lit(high), length)),
            lambda n: F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.substr(padded, i, n)),
        )
    )


def char_ngrams(word: Column, low: int = 3, high: int = 5) -> Column:
    """T8. Character n-grams of one space-padded word; a short word counts once.

    The padded length is at least ``low``, so sizes run from ``low`` to ``min(high, length)``. A
    look-ahead match per size finds the overlapping pieces; it steps by UTF-16 unit, so words with
    characters beyond the basic plane are cut by position instead.
    """
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    matched = F.concat(*[
        F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in range(low, high + 1)
    ])
    return F.when(
        word.rlike(r"[\x{10000}-\x{10FFFF}]"), _cut(padded, F.char_length(word) + 2, low, high)
    ).otherwise(matched)


def logistic(z: Column) -> Column:
    """T10."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def threshold_bias(threshold: Column) -> Column:
    """T11. Logit of a tuned threshold."""
    return F.ln(threshold / (F.lit(1.0) - threshold))


def calibrate(p: Column, threshold: Column) -> Column:
    """T11. Shift a probability so that ``threshold`` maps to 0.5."""
    return logistic(F.ln(p / (F.lit(1.0) - p)) - threshold_bias(threshold))


def token_windows(ids: Column, max_len: int, max_windows: int = 8) -> Column:
    """T12. Overlapping windows over token ids ``[first, body.., last]``, each at most ``max_len`` long."""
    width = max_len - 2
    body = F.size(ids) - 2
    starts = F.sequence(F.lit(0), F.greatest(body - width, F.lit(0)), F.lit(width // 2))

    def window(start: Column) -> Column:
        inside = F.slice(ids, start + 2, F.least(F.lit(width), F.greatest(body - start, F.lit(0))))
        return F.concat(F.slice(ids, 1, 1), inside, F.slice(ids, -1, 1))

    regular = F.transform(F.slice(starts, 1, max_windows), window)
    uncovered = (body > width) & (F.element_at(starts, -1) + width < body) & (F.size(starts) < max_windows)
    return F.when(uncovered, F.concat(regular, F.array(window(body - width)))).otherwise(regular)


def version_name(ts: Column) -> Column:
    """T19. Sortable UTC version string; a timestamp without a zone counts as UTC."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    day = F.date_format(F.date_from_unix_date(F.floor(seconds / 86400).cast("int")), "yyyyMMdd")
    rest = F.pmod(seconds, F.lit(86400))
    parts = [F.lpad(F.floor(x).cast("string"), 2, "0") for x in (rest / 3600, F.pmod(rest / 60, F.lit(60)), F.pmod(rest, F.lit(60)))]
    named = F.concat(F.lit("v"), day, F.lit("-"), *parts)
    return F.when(F.typeof(ts) == "timestamp_ntz", F.date_format(ts, "'v'yyyyMMdd-HHmmss")).otherwise(named)
