"""Tunable parameters, with the default values of the public guard this repo matches."""

from __future__ import annotations

import math
from dataclasses import dataclass

HEADS = ("prompt_injection", "jailbreak", "toxic")
LABEL_CLASSES = ("safe", "jailbreak", "prompt_injection", "toxic")


@dataclass(frozen=True)
class GuardSettings:
    """Decision threshold and the two quality gates of a training run."""

    threshold: float = 0.5
    min_head_f1: float = 0.75
    min_eval_accuracy: float = 0.8


@dataclass(frozen=True)
class ConversationSettings:
    """Risk-ledger and window parameters of the conversation monitor."""

    alpha: float = 0.8
    beta: float = 0.5
    flag_threshold: float = 0.6
    threshold: float = 0.5
    window_turns: int = 4
    window_max_chars: int = 2000
    ttl_seconds: int = 3600
    history_shown: int = 20
    turns_kept: int = 50
    risky_turn: float = 0.2

    def __post_init__(self) -> None:
        if self.window_turns < 1:
            raise ValueError("window_turns must be at least 1")
        if not 0.0 <= self.alpha < 1.0:
            raise ValueError("alpha must lie in [0, 1)")
        if self.window_turns > self.turns_kept:
            raise ValueError("window_turns cannot exceed turns_kept")

    @property
    def memory_rows(self) -> int:
        """Turns after which the ledger forgets where it began, to the last bit: ``alpha ** n`` falls below the precision of a
        double, and two folds that are one last digit apart have met."""
        if self.alpha == 0.0:
            return 1
        return math.ceil(53 * math.log(2) / -math.log(self.alpha)) + math.ceil(30 / (1 - self.alpha))

    @property
    def lookback_rows(self) -> int:
        """Longest bounded frame any monitor expression reads."""
        return max(self.turns_kept - 1, self.history_shown - 1, self.window_turns - 1)
