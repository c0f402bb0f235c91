"""Looking at plans."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text: look for PushedFilters, ReadSchema, Exchange and the joins' kinds."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()
