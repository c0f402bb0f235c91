"""Datasets of a default graph and named ones over a DataFrame of quads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT = "urn:x-default"


class Dataset:
    """``defaults``: names of the graphs whose merge is the default graph; ``named``: those that GRAPH may see, or all but the defaults."""

    def __init__(self, quads: DataFrame, defaults: tuple[str, ...] = (DEFAULT,), named: tuple[str, ...] | None = None):
        self.quads, self.defaults, self.names = quads, defaults, named

    def default(self) -> DataFrame:
        """Triples of the default graph; those of several graphs count once."""
        rows = self.quads.where(F.col("g.lex").isin(*self.defaults))
        triples = rows.select("s", "p", "o")
        return triples if len(self.defaults) == 1 else triples.distinct()

    def _visible(self) -> DataFrame:
        lex = F.col("g.lex")
        return self.quads.where(lex.isin(*self.names) if self.names is not None else ~lex.isin(*self.defaults))

    def graph(self, name: str) -> DataFrame:
        """Triples of one named graph; none if it is outside the dataset."""
        return self._visible().where(F.col("g.lex") == name).select("s", "p", "o")

    def graphs(self) -> DataFrame:
        """Quads of all named graphs: the graph stays a column, and patterns that share it join on it."""
        return self._visible()

    def graph_names(self) -> DataFrame:
        return self._visible().select("g").distinct()


def triples_as(triples: DataFrame, graph: str) -> DataFrame:
    """Triples as quads of one graph; unite such tables to put several stores under one dataset."""
    from triplane.terms import iri

    return triples.select("s", "p", "o", iri(graph).alias("g"))
