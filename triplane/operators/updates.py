"""Graph updates: insertions are appended to the quads, other operations write a new version, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.operators.forms import instances
from triplane.operators.graphs import DEFAULT
from triplane.terms import BNODE, iri
from triplane.written import discard, written

QUAD = ["s", "p", "o", "g"]


class ReadOnly(Exception):
    """The quads come from mapped tables."""


class Store:
    """A set of quads that can be updated. ``quads`` is always the present version; older ones stay readable.

    The first update copies the quads that the store was made from, once and without repeats, unless ``distinct`` says
    that they are a set already. From then on, insertions look up what is there and write the new rows alone; after
    ``parts`` of them the tables are written into one.
    """

    def __init__(self, quads: DataFrame, read_only: bool = False, distinct: bool = False, parts: int = 16):
        self.quads, self.read_only, self.own, self.most, self.parts = quads.select(*QUAD), read_only, distinct, parts, 1

    def _check(self) -> None:
        if self.read_only:
            raise ReadOnly("mapped tables cannot be updated; copy their quads into a Store of their own")

    def _become(self, quads: DataFrame) -> Store:
        self._check()
        self.quads, self.own, self.parts = written(quads if self.own else quads.dropDuplicates(), "quads"), True, 1
        return self

    def _append(self, quads: DataFrame) -> Store:
        self._check()
        if not self.own:
            self._become(self.quads)
        fresh = written(quads.dropDuplicates().join(self.quads, QUAD, "left_anti"), "quads")
        self.quads, self.parts = self.quads.unionByName(fresh), self.parts + 1
        return self._become(self.quads) if self.parts > self.most else self

    @staticmethod
    def _with_graph(triples: DataFrame, graph: str = DEFAULT) -> DataFrame:
        return triples.select(*QUAD) if "g" in triples.columns else triples.select("s", "p", "o", iri(graph).alias("g"))

    def insert(self, triples: DataFrame, graph: str = DEFAULT) -> Store:
        """INSERT DATA: triples into ``graph``, or quads; what is there already is not there twice."""
        return self._append(self._with_graph(triples, graph))

    def delete(self, triples: DataFrame, graph: str = DEFAULT) -> Store:
        """DELETE DATA; blank nodes name nothing here."""
        gone = self._with_graph(triples, graph)
        if not gone.where((F.col("s.kind") == BNODE) | (F.col("o.kind") == BNODE)).isEmpty():
            raise ValueError("DELETE DATA takes no blank nodes")
        return self._become(self.quads.join(gone, QUAD, "left_anti"))

    def modify(self, solutions: DataFrame, delete: tuple[tuple, ...] = (), insert: tuple[tuple, ...] = (), graph: str = DEFAULT) -> Store:
        """DELETE / INSERT ... WHERE: solutions are taken once, from the present version; all deletions come before insertions."""
        found = written(solutions, "solutions")
        if delete:
            self._become(self.quads.join(self._with_graph(instances(found, *delete), graph), QUAD, "left_anti"))
        if insert:
            self._append(self._with_graph(instances(found, *insert), graph))
        discard(found)
        return self

    def load(self, path: str, graph: str = DEFAULT, silent: bool = False) -> Store:
        """LOAD of N-Triples, N-Quads or Turtle files."""
        from triplane.sources.rdf import read_any

        try:
            rows = read_any(self.quads.sparkSession, path)
            rows.take(1)
        except Exception:
            if silent:
                return self
            raise
        return self.insert(rows.drop("g") if not path.endswith((".nq", ".nq.gz")) else rows.withColumn("g", F.coalesce("g", iri(graph))), graph)

    def has_graph(self, graph: str) -> bool:
        return not self.quads.where(F.col("g.lex") == graph).isEmpty()

    def create(self, graph: str, silent: bool = False) -> Store:
        """A quad store holds no empty graph, so this only checks that there is none of the name yet."""
        if not silent and self.has_graph(graph):
            raise ValueError(f"graph {graph} exists")
        return self

    def drop(self, graph: str, silent: bool = False) -> Store:
        if not silent and graph != DEFAULT and not self.has_graph(graph):
            raise ValueError(f"no graph {graph}")
        return self._become(self.quads.where(F.col("g.lex") != graph))

    def drop_named(self) -> Store:
        return self._become(self.quads.where(F.col("g.lex") == DEFAULT))

    def drop_all(self) -> Store:
        return self._become(self.quads.limit(0))

    clear, clear_named, clear_all = drop, drop_named, drop_all

    def add(self, source: str, target: str, silent: bool = False) -> Store:
        if source == target:
            return self
        if not silent and source != DEFAULT and not self.has_graph(source):
            raise ValueError(f"no graph {source}")
        return self.insert(self.quads.where(F.col("g.lex") == source).select("s", "p", "o"), target)

    def copy(self, source: str, target: str, silent: bool = False, moved: bool = False) -> Store:
        """The target becomes as the source; with ``moved`` the source goes, in the same version."""
        if source == target:
            return self
        if not silent and source != DEFAULT and not self.has_graph(source):
            raise ValueError(f"no graph {source}")
        kept = self.quads.where(~F.col("g.lex").isin([target, source] if moved else [target]))
        copied = self.quads.where(F.col("g.lex") == source).select("s", "p", "o", iri(target).alias("g"))
        return self._become(kept.unionByName(copied))

    def move(self, source: str, target: str, silent: bool = False) -> Store:
        return self.copy(source, target, silent, moved=True)
