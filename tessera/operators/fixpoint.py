"""Fixpoints as driver loops over DataFrames: state is written every few rounds, changes decide the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessera.operators.materialise import materialise


def repeat(state: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, every: int = 5) -> DataFrame:
    """A fixed number of rounds, several to a job; the state is written every ``every`` rounds."""
    for i in range(1, rounds + 1):
        state = step(state)
        if i % every == 0 and i < rounds:
            state = materialise(state)
    return state


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], DataFrame], limit: int = 10_000) -> DataFrame:
    """Rounds until ``changed(old, new)`` is empty; every round's state is written once."""
    state = materialise(state)
    for _ in range(limit):
        new = materialise(step(state))
        if changed(state, new).isEmpty():
            return new
        state = new
    raise RuntimeError(f"no fixpoint after {limit} rounds")


def grow(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], limit: int = 10_000) -> DataFrame:
    """Semi-naive growth: each round extends only the rows new in the last one; rows are unique by ``key``."""
    seen = frontier = materialise(start)
    for _ in range(limit):
        frontier = materialise(step(frontier).dropDuplicates(key).join(seen.select(*key), key, "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"no fixpoint after {limit} rounds")
