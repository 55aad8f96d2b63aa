"""Peg-deviation analytics for pegged-asset price streams, written as Spark DataFrame jobs."""

from pegwatch.rules import Rules

__all__ = ["Rules"]
