"""Chat requests: validation (F5), user turns (F6), outbound messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.pii import mask

REQUEST_SCHEMA = "prompt STRING, messages ARRAY<STRUCT<role: STRING, content: STRING>>, conversation_id STRING"
ROLES = ("system", "user", "assistant")
ONE_INPUT = "send exactly one of `prompt` or `messages`"
LAST_USER = "`messages` must end with a user message"
BAD_CONTENT = "`content` must be text"
BAD_ROLE = "`role` must be system, user or assistant"


def request_error() -> Column:
    """F5. Null for a valid request, else why it is rejected."""
    messages = F.col("messages")
    wrong_role = F.exists(messages, lambda m: m["role"].isNull() | ~m["role"].isin(*ROLES))
    no_content = F.exists(messages, lambda m: m["content"].isNull())
    last_role = F.try_element_at(messages, F.lit(-1))["role"]
    return (
        F.when(messages.isNotNull() & F.coalesce(wrong_role, F.lit(False)), BAD_ROLE)
        .when(messages.isNotNull() & F.coalesce(no_content, F.lit(False)), BAD_CONTENT)
        .when(F.col("prompt").isNull() == messages.isNull(), ONE_INPUT)
        .when(messages.isNotNull() & ((F.size(messages) == 0) | ~F.coalesce(last_role == "user", F.lit(False))), LAST_USER)
    )


def user_text() -> Column:
    """The text to check: the prompt, else the last message."""
    return F.coalesce(F.col("prompt"), F.try_element_at(F.col("messages"), F.lit(-1))["content"])


def validate(requests: DataFrame) -> DataFrame:
    """F5. Add ``error``; rows keep flowing so that rejects can be routed."""
    return requests.withColumn("error", request_error())


def accepted(requests: DataFrame) -> DataFrame:
    """Valid requests with their ``user_text``."""
    return validate(requests).where("error IS NULL").drop("error").withColumn("user_text", user_text())


def rejected(requests: DataFrame) -> DataFrame:
    return validate(requests).where("error IS NOT NULL")


def user_turns(turns: DataFrame, role: str = "role") -> DataFrame:
    """F6."""
    return turns.where(F.col(role) == "user")


def outbound_messages(messages: Column) -> Column:
    """S14. Every user turn masked, other roles untouched, order kept.

    A bare prompt is sent as one user message: pass ``array(struct('user', prompt))``.
    """
    return F.transform(
        messages,
        lambda m: F.struct(
            m["role"].alias("role"),
            F.when(m["role"] == "user", mask(m["content"])).otherwise(m["content"]).alias("content"),
        ),
    )
