"""Query forms other than SELECT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.operators.patterns import Term, Var
from triplane.terms import BNODE, IRI, LITERAL, bnode, term


def ask(df: DataFrame) -> DataFrame:
    """One row, ``result``: whether there is a solution; Spark stops at the first."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))


def _place(t: Var | Term, row: Column) -> Column:
    if isinstance(t, Var):
        return F.col(f"`{t.name}`")
    if t.kind == BNODE:  # a new node for each solution
        return bnode(F.concat(F.lit(t.lex + "_"), row))
    return term(t.kind, t.lex, t.dt, t.lang)


def instances(df: DataFrame, *template: tuple) -> DataFrame:
    """``s, p, o`` (and ``g``, if the template has it) for each solution and pattern, those that cannot be stored left out.

    A blank node of the template is new in each solution: it is named after the values of the solution's variables.
    """
    names = sorted(df.columns)
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.to_json(F.struct(F.col(f"`{n}`"))), F.lit("")) for n in names)), 256) if names else F.lit("0")
    places = ("s", "p", "o", "g")[: len(template[0])]
    made = F.explode(F.array(*(F.struct(*(_place(t, row).alias(p) for t, p in zip(pattern, places))) for pattern in template)))
    out = df.select(made.alias("t")).select("t.*")
    sound = (F.col("s.kind") != LITERAL) & (F.col("p.kind") == IRI)
    return out.where(reduce(lambda a, b: a & b, (F.col(p).isNotNull() for p in places)) & sound)


def construct(df: DataFrame, *template: tuple) -> DataFrame:
    return instances(df, *template).distinct()


def describe(quads: DataFrame, resources: DataFrame) -> DataFrame:
    """Triples about the terms of ``resources`` (column ``s``), and about blank nodes that these lead to, to any depth."""
    from triplane.written import written

    triples = quads.select("s", "p", "o").distinct()
    fresh = written(resources.select("s").distinct(), "describe")
    seen = fresh
    while not fresh.isEmpty():
        found = triples.join(fresh, "s", "left_semi").where(F.col("o.kind") == BNODE).select(F.col("o").alias("s")).distinct()
        fresh = written(found.join(seen, "s", "left_anti"), "describe")
        seen = seen.unionByName(fresh)
    return triples.join(seen.distinct(), "s", "left_semi")
