"""Ordinary tables seen as RDF: each row a subject, each mapped column a predicate.

:meth:`Mapped.star` answers all patterns of one subject with a single scan of the columns asked for, in native types:
subjects and links are keys, so hops between tables are joins on keys, filters and column lists reach the Parquet
reader, and no self-joins are made. :meth:`Mapped.quads` gives the same as quads of terms.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.terms import DOUBLE, TYPE, iri, lift, literal

NS = "http://ex.org/"


@dataclass
class Mapped:
    """``template``: subject IRIs, with ``{}`` for the key. ``links``: predicate -> (key column, template of what it names)."""

    df: DataFrame
    template: str
    key: str
    columns: dict[str, str]
    links: dict[str, tuple[str, str]] = field(default_factory=dict)
    langs: dict[str, str] = field(default_factory=dict)  # predicate -> column with the language of its strings
    kind: str | None = None

    def star(self, subject: str | None, **variables: str) -> DataFrame:
        """Rows that have every predicate asked for: ``star("l", l_quantity="qty", l_order="o")`` gives l, qty, o.

        The subject is the native key, left out if it is None; a predicate's name goes without its namespace. A NULL
        has no triple.
        """
        chosen = {name: self.links[p][0] if p in self.links else self.columns[p] for p, name in variables.items()}
        own = [] if subject is None else [F.col(self.key).alias(subject)]
        out = self.df.select(*own, *(F.col(c).alias(n) for n, c in chosen.items()))
        return out.dropna(subset=list(chosen)) if chosen else out

    def subject(self, key: Column) -> Column:
        """The IRI of a key."""
        before, after = self.template.split("{}")
        return iri(F.concat(F.lit(before), key.cast("string"), F.lit(after)))

    def quads(self, graph: str = "urn:x-default", only: tuple[str, ...] | None = None) -> DataFrame:
        """Quads of the mapped columns, or of the predicates in ``only``: one pass over the table."""
        made = []
        for p, column in self.columns.items():
            kind = self.df.schema[column].dataType
            o = literal(F.col(column), None, F.col(self.langs[p])) if p in self.langs else literal(F.col(column).cast("string"), DOUBLE) if kind.simpleString() == "double" else lift(F.col(column), kind)
            made.append((NS + p, o))
        for p, (column, template) in self.links.items():
            before, after = template.split("{}")
            made.append((NS + p, iri(F.concat(F.lit(before), F.col(column).cast("string"), F.lit(after)))))
        if self.kind:
            made.append((TYPE, iri(self.kind)))
        if only is not None:
            made = [(p, o) for p, o in made if p.removeprefix(NS) in only or p == TYPE and "a" in only]
        pairs = F.explode(F.array(*(F.struct(iri(p).alias("p"), o.alias("o")) for p, o in made))).alias("t")
        return self.df.select(self.subject(F.col(self.key)).alias("s"), pairs).where("t.o IS NOT NULL").select("s", "t.p", "t.o", iri(graph).alias("g"))


_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "_metadata.row_index", "events": "event_id", "documents": "doc_id"}
_LINKS = {
    "nation": {"n_region": ("n_regionkey", "region")}, "customer": {"c_nation": ("c_nationkey", "nation")}, "supplier": {"s_nation": ("s_nationkey", "nation")},
    "orders": {"o_customer": ("o_custkey", "customer")}, "events": {"e_user": ("user_id", "customer")},
    "lineitem": {"l_order": ("l_orderkey", "orders"), "l_part": ("l_partkey", "part"), "l_supp": ("l_suppkey", "supplier")},
}


class Tables(dict):
    """Mapped graphs by name, each opened when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def __missing__(self, name: str) -> Mapped:
        key = _KEYS[name]
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        links = {p: (c, f"{NS}{t}/{{}}") for p, (c, t) in _LINKS.get(name, {}).items()}
        columns = {c: c for c in df.columns if c != key}
        langs = {"text": "lang"} if name == "documents" else {}
        self[name] = Mapped(df, f"{NS}{name}/{{}}", key, columns, links, langs, NS + name.capitalize())
        return self[name]


def mapped_tables(spark: SparkSession, folder: str) -> Tables:
    """The tables of a folder of Parquet files as mapped graphs, namespace ``http://ex.org/``.

    ``lineitem`` has no key of its own: a row's place in its file is its subject.
    """
    return Tables(spark, folder)
