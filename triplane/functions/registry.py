"""Functions of the user's own, by IRI: each takes term columns and gives a term column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

_FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register(name: str, function: Callable[..., Column]) -> None:
    """``function`` maps Columns to a Column; build it from Spark's functions, or from a pandas UDF if they cannot say it."""
    _FUNCTIONS[name] = function


def call(name: str, *args: Column) -> Column:
    if name not in _FUNCTIONS:
        raise KeyError(f"no function {name}; register() it first")
    return _FUNCTIONS[name](*args)
