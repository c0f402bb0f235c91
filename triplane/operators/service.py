"""Federation: patterns answered by another engine, registered under its endpoint's IRI."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triplane.operators.solutions import unit

_ENDPOINTS: dict[str, Callable[..., DataFrame]] = {}


def register_endpoint(name: str, answer: Callable[..., DataFrame]) -> None:
    """``answer`` maps what it is asked to solutions, as a DataFrame, so that their join is an ordinary one."""
    _ENDPOINTS[name] = answer


def service(spark: SparkSession, name: str, *asked, silent: bool = False) -> DataFrame:
    """The endpoint's solutions. Where it fails and ``silent`` is set, one solution that binds nothing."""
    try:
        if name not in _ENDPOINTS:
            raise KeyError(f"no endpoint {name}; register_endpoint() it first")
        return _ENDPOINTS[name](*asked)
    except Exception:
        if silent:
            return unit(spark)
        raise
