"""Execution plans as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def execution_plan(route: Column, barred: tuple[int, ...], alternatives: tuple[int, ...]) -> Column:
    """The route without barred agents, then the alternatives that it lacks."""
    kept = F.filter(route, lambda x: ~x.isin(*barred))
    return F.array_union(kept, F.array(*map(F.lit, alternatives)))
