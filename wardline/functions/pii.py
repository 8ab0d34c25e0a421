"""Personal-data masks P1-P5 over raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import patterns as P
from wardline.functions.detectors import check_result, compiled

KINDS = tuple(P.PII)
_THREE_DIGITS = r"[0-9]{3}|\p{Nd}{3}"
# What a find begins with, looked at before the costly word boundary.
_STARTS = {"SSN": r"(?=\d)", "CREDIT_CARD": "(?=[345])", "PHONE": r"(?=[+(\d])"}


def redaction(kind: str) -> str:
    return f"[REDACTED_{kind}]"


def mask(text: Column) -> Column:
    """P1-P4 as one nested expression, for use inside ``transform`` over message arrays.

    The gates of ``with_masked``, all on the text as it came: a mask adds no ``@`` and no digit, and its brackets part the digits
    around it, so what fails a gate before the first mask fails it after.
    """
    emailed = F.when(text.contains("@"), _replaced(text, "EMAIL")).otherwise(text)
    numbered = emailed
    for kind in KINDS[1:]:
        numbered = _replaced(numbered, kind)
    return F.when(text.rlike(_THREE_DIGITS), numbered).otherwise(emailed)


def _replaced(text: Column, kind: str) -> Column:
    """``text`` with one kind masked. An address holds no space, so only the pieces between spaces that hold an ``@`` are matched."""
    if kind != "EMAIL":
        return F.regexp_replace(text, compiled(_STARTS[kind] + P.PII[kind]), redaction(kind))
    pieces = F.transform(F.split(text, " "), lambda w: F.when(
        w.contains("@"), F.regexp_replace(w, compiled(P.PII[kind]), redaction(kind))).otherwise(w))
    return F.array_join(pieces, " ")


def with_masked(df: DataFrame, text: str = "text", out: str = "masked", counts: str = "pii_counts") -> DataFrame:
    """P5. Masked text plus a struct of finds per kind.

    Staged so each pattern runs once, and only on rows that hold an ``@`` or three digits in a row,
    without which no pattern can match.
    """
    gates = {"EMAIL": F.col(text).contains("@")}
    staged = df.withColumn("_digits", F.col(text).rlike(_THREE_DIGITS))
    before = text
    for kind in KINDS:
        gate = gates.get(kind, F.col("_digits"))
        after = f"_after_{kind}"
        staged = staged.withColumn(
            after, F.when(gate, _replaced(F.col(before), kind)).otherwise(F.col(before))
        )
        before = after
    befores = (text, *[f"_after_{k}" for k in KINDS[:-1]])
    finds = [
        F.when(F.col(f"_after_{k}") != F.col(b), F.regexp_count(F.col(b), F.lit(compiled(P.PII[k]))))
        .otherwise(F.lit(0)).alias(k)
        for k, b in zip(KINDS, befores)
    ]
    return (
        staged.withColumn(out, F.col(before))
        .withColumn(counts, F.struct(*finds))
        .drop("_digits", *[f"_after_{k}" for k in KINDS])
    )


def pii_reason(counts: Column) -> Column:
    """Kinds and counts only; the values found never reach the output."""
    parts = [F.when(counts[k] > 0, F.format_string(f"{k} x%d", counts[k])) for k in KINDS]
    return F.concat(F.lit("PII detected and redacted: "), F.concat_ws(", ", *parts))


def pii_result(counts: Column) -> Column:
    found = sum((counts[k] for k in KINDS[1:]), counts[KINDS[0]]) > 0
    return check_result(
        ~found,
        F.when(found, F.lit(0.5)).otherwise(F.lit(1.0)),
        F.when(found, pii_reason(counts)).otherwise(F.lit("No PII detected.")),
        F.when(found, F.lit("modify")).otherwise(F.lit("allow")),
    )
