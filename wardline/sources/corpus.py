"""S2, V2. Training-corpus sources: 15 public layouts mapped to ``text, label``.

A mapper is a label expression, a text expression and a filter over one source, so Catalyst prunes
columns and pushes the filters into each scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import patterns as P
from wardline.functions.detectors import FLAGS, compiled
from wardline.functions.hashing import crc, keep_one_in
from wardline.functions.text import strip
from wardline.operators.corpus import union_sources


def jailbreak_style(text: Column) -> Column:
    """F1."""
    return F.coalesce(text, F.lit("")).rlike(compiled(P.JAILBREAK_STYLE))


def excluded_origin(origin: Column) -> Column:
    """F4."""
    return F.coalesce(origin.isin(*P.EXCLUDED_ORIGINS), F.lit(False))


@dataclass(frozen=True)
class Mapper:
    """``text`` and ``label`` of a source row; rows failing ``where`` are dropped."""

    text: Column
    label: Column
    where: Column | None = None

    def apply(self, source: DataFrame, *extra: str | Column) -> DataFrame:
        kept = source if self.where is None else source.where(self.where)
        return kept.select(*extra, self.text.alias("text"), self.label.alias("label"))


def _either(test: Column, label: str) -> Column:
    return F.when(test, F.lit(label)).otherwise(F.lit("safe"))


def _target_swap() -> Mapper:
    """M12, T18. Competition attempts: hash-sampled, successes preferred, fixed target phrase replaced."""
    text = strip(F.coalesce(F.col("user_input"), F.lit("")))
    payloads = F.array(*[F.lit(p) for p in P.PAYLOADS])
    one_in = F.when(F.coalesce(F.col("correct"), F.lit(False)), 2).otherwise(30)
    payload = F.element_at(payloads, (crc(text) % len(P.PAYLOADS) + 1).cast("int"))
    return Mapper(
        F.regexp_replace(text, F.lit(FLAGS + P.TARGET_PHRASE), payload),
        F.lit("prompt_injection"),
        (F.char_length(text) >= 10) & keep_one_in(text, one_in),
    )


def mappers() -> dict[str, Mapper]:
    """M1-M15 by mapper id. Needs an active session, as column expressions do."""
    c = F.col
    instruction = F.concat(
        c("instruction"), F.when(F.length("context") > 0, F.concat(F.lit("\n\n"), c("context"))).otherwise("")
    )
    wanted_format = c("format").isin(*P.ATTACK_FORMATS) & ~excluded_origin(c("from"))
    return {
        "M1": Mapper(c("text"), _either(c("label") == 1, "prompt_injection")),
        "M2": Mapper(c("prompt"), _either(c("type") == "jailbreak", "jailbreak")),
        "M3": Mapper(c("`User Prompt`"), _either(c("`Prompt injection`") == 1, "prompt_injection")),
        "M4": Mapper(c("prompt"), F.lit("jailbreak")),
        "M5": Mapper(c("prompt"), F.lit("safe"), ~jailbreak_style(c("prompt"))),
        "M6": Mapper(
            c("prompt"), _either(c("prompt_label") == "unsafe", "toxic"), ~c("prompt").eqNullSafe("REDACTED")
        ),
        "M7": Mapper(instruction, F.lit("safe")),
        "M8": Mapper(c("text"), F.lit("safe"), (c("role") == "prompter") & c("parent_id").isNull()),
        "M9": Mapper(c("prompt"), F.lit("safe"), keep_one_in(c("prompt"), 4)),
        "M10": Mapper(c("prompt"), F.lit("toxic")),
        "M11": Mapper(c("prompt"), F.lit("safe"), ~jailbreak_style(c("prompt"))),
        "M12": _target_swap(),
        "M13": Mapper(c("question"), F.lit("toxic"), ~excluded_origin(c("source")) & keep_one_in(c("question"), 2)),
        "M14": Mapper(c("augq"), F.lit("jailbreak")),
        "M15": Mapper(
            c("jailbreak_query"), F.lit("jailbreak"),
            wanted_format & ((c("format") != "Template") | keep_one_in(c("jailbreak_query"), 4)),
        ),
    }


# -- fixed values: the public data sets, in corpus order, with configuration and mapper ---------------
DATASETS = (
    ("deepset/prompt-injections", None, "M1"),
    ("jackhhao/jailbreak-classification", None, "M2"),
    ("reshabhs/SPML_Chatbot_Prompt_Injection", None, "M3"),
    ("TrustAIRLab/in-the-wild-jailbreak-prompts", "jailbreak_2023_12_25", "M4"),
    ("TrustAIRLab/in-the-wild-jailbreak-prompts", "regular_2023_12_25", "M5"),
    ("nvidia/Aegis-AI-Content-Safety-Dataset-2.0", None, "M6"),
    ("databricks/databricks-dolly-15k", None, "M7"),
    ("OpenAssistant/oasst2", None, "M8"),
    ("bench-llm/or-bench", "or-bench-80k", "M9"),
    ("bench-llm/or-bench", "or-bench-toxic", "M10"),
    ("fka/prompts.chat", None, "M11"),
    ("hackaprompt/hackaprompt-dataset", None, "M12"),
    ("OpenSafetyLab/Salad-Data", "base_set", "M13"),
    ("OpenSafetyLab/Salad-Data", "attack_enhanced_set", "M14"),
    ("JailbreakV-28K/JailBreakV-28k", "JailBreakV_28K", "M15"),
)


@dataclass(frozen=True)
class Source:
    """V2. A pluggable source: ``read(spark)`` gives the landed table, ``mapper`` its examples.

    ``row_order`` names a column that orders the rows; without it the scan order is used.
    """

    name: str
    read: Callable[[SparkSession], DataFrame]
    mapper: Mapper
    row_order: str | None = None

    def examples(self, spark: SparkSession, src_order: int) -> DataFrame:
        order = F.col(self.row_order) if self.row_order else F.monotonically_increasing_id()
        return self.mapper.apply(
            self.read(spark), F.lit(src_order).alias("src_order"), order.cast("long").alias("row_order")
        )


def load_sources(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """S2, U1, F3. ``src_order, row_order, text, label`` of all sources, blanks dropped, duplicates kept."""
    return union_sources([s.examples(spark, i) for i, s in enumerate(sources)])


def landed_sources(root: str, fmt: str = "parquet") -> list[Source]:
    """The 15 public sets as landed under ``root/<name with / as __>[/<config>]``, all splits together."""
    known = mappers()

    def reader(name: str, config: str | None) -> Callable[[SparkSession], DataFrame]:
        path = "/".join(x for x in (root, name.replace("/", "__"), config) if x)
        return lambda spark: spark.read.format(fmt).option("recursiveFileLookup", True).load(path)

    return [Source(n if c is None else f"{n}:{c}", reader(n, c), known[m]) for n, c, m in DATASETS]
