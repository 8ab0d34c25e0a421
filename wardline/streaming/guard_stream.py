"""X4, X6. The guard over a stream of requests, stateless or with a model that follows the pointer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wardline.operators.guard import guard
from wardline.operators.linear_scorer import with_linear_scores
from wardline.operators.requests import accepted
from wardline.operators.scoring import heads_map
from wardline.plans.registry import ModelRefresher


def guard_requests(requests: DataFrame, heads: str | None = None, threshold: float = 0.5) -> DataFrame:
    """X4. Valid requests with the guard's verdict; works on batch and streaming frames alike."""
    return guard(accepted(requests), "user_text", heads, threshold)


def guard_with_current_model(
    requests: DataFrame, refresher: ModelRefresher, write: Callable[[DataFrame, int], None], threshold: float = 0.5,
) -> DataStreamWriter:
    """X6. Score each micro-batch with the model the pointer names at that moment.

    ``write(guarded, batch_id)`` must be idempotent per batch id.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        valid = accepted(batch)
        model = refresher.get()
        if model is None:
            write(guard(valid, "user_text"), batch_id)
            return
        linear = refresher.linear(model)
        scored = with_linear_scores(valid, linear, "user_text").withColumn("heads", heads_map(linear.heads))
        write(guard(scored.drop(*linear.heads), "user_text", "heads", threshold).withColumn("version", F.lit(model.version)), batch_id)

    return requests.writeStream.foreachBatch(run)
