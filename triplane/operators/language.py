"""Language preference: of the literals of one subject, predicate and graph, those in the best language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _score(lang: Column, user: dict[str, float], site: dict[str, float]) -> Column:
    """Product of both qualities of a language; one that is not listed has the quality of ``*``, or 0."""

    def quality(of: dict[str, float]) -> Column:
        out = F.lit(float(of.get("*", 0.0)))
        for name, q in of.items():
            if name != "*":
                out = F.when((F.lower(lang) == name.lower()) | F.startswith(F.lower(lang), F.lit(name.lower() + "-")), float(q)).otherwise(out)
        return out

    return quality(user) * quality(site)


def prefer_language(quads: DataFrame, user: dict[str, float], site: dict[str, float] | None = None) -> DataFrame:
    """Terms that are no literals, and literals without a language, all stay. Works on triples and quads.

    Rows of one subject and predicate share a window partition; languages of equal score all stay.
    """
    by = [c for c in ("s", "p", "g") if c in quads.columns]
    tagged = F.col("o.lang").isNotNull()
    score = F.when(tagged, _score(F.col("o.lang"), user, site or {"*": 1.0}))
    best = F.max(F.col("`.score`")).over(Window.partitionBy(*by))
    scored = quads.withColumn(".score", score).withColumn(".best", best)
    return scored.where(F.col("`.score`").isNull() | (F.col("`.score`") == F.col("`.best`"))).drop(".score", ".best")
