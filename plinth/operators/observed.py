"""Counts collected while a plan runs: progress of a search without a job of its own for each count.

A Progress names places of a plan; `at` puts an observation there, and the counts are known once an action has run the plan. They are
metrics of the run itself: rows are counted where they pass, each once (a task that runs again counts once), and nothing is
read a second time. An action that stops early (limit, first) counts what it has seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

RETAINED = "Search criteria retained {retained} of {unfiltered} jobs."


class Progress:
    """Named counts of one run of a plan, in the order of their places."""

    def __init__(self) -> None:
        self.places: dict[str, Observation] = {}

    def at(self, rows: DataFrame, place: str, **more: Column) -> DataFrame:
        """rows, counted as they pass; more: further aggregates (count, sum, min, max...) by name."""
        if place in self.places:
            raise ValueError(f"{place} is observed already")
        seen = self.places[place] = Observation(place)
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in more.items()))

    def of(self, place: str) -> dict[str, object]:
        """The aggregates of a place; waits for the action."""
        return self.places[place].get

    def counts(self) -> dict[str, int]:
        return {place: self.of(place)["rows"] for place in self.places}

    def message(self) -> str:
        """What a search tells of its filters."""
        return RETAINED.format(**{k: v for k, v in self.counts().items() if k in ("retained", "unfiltered")})
