"""Prompt-safety analytics as Spark jobs: guard, conversation monitor, corpus build, training, evaluation."""
