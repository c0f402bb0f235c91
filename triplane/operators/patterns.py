"""Quad patterns over a DataFrame of quads ``s, p, o, g``, each a term.

Terms of a pattern become filters on the scan (``p.lex = ...`` reaches the Parquet reader; a table partitioned by
predicate prunes), variables become columns, and a variable that repeats is an equality.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.operators.joins import join
from triplane.terms import BNODE, IRI, LITERAL, TYPE


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    kind: int
    lex: str
    dt: str | None = None
    lang: str | None = None


def var(name: str) -> Var:
    return Var(name)


def node(text: str) -> Term:
    return Term(IRI, text)


def blank(label: str) -> Term:
    return Term(BNODE, label)


def value(text: str, dt: str | None = None, lang: str | None = None) -> Term:
    return Term(LITERAL, text, dt, lang)


A = Term(IRI, TYPE)


def test(column: str, t: Term) -> Column:
    c = F.col(column)
    return (c["kind"] == t.kind) & (c["lex"] == t.lex) & (c["dt"].isNull() if t.dt is None else c["dt"] == t.dt) & (c["lang"].isNull() if t.lang is None else c["lang"] == t.lang)


def match(quads: DataFrame, s: Var | Term, p: Var | Term, o: Var | Term, g: Var | Term | None = None) -> DataFrame:
    """Solutions of one pattern; without ``g``, over the triples as they are."""
    places: dict[str, str] = {}
    for column, t in (("s", s), ("p", p), ("o", o), ("g", g)):
        if isinstance(t, Term):
            quads = quads.where(test(column, t))
        elif t is not None:
            if t.name in places:
                quads = quads.where(F.col(column) == F.col(places[t.name]))
            else:
                places[t.name] = column
    return quads.select(*(F.col(column).alias(name) for name, column in places.items()))


def bgp(quads: DataFrame, *patterns: tuple) -> DataFrame:
    """Solutions of several patterns at once.

    Taken in an order that starts where most places are given and goes on to patterns that share a variable with what
    is there, so that a cross product is only made where nothing connects; the joins' strategy is Spark's to choose.
    """
    left = list(patterns)
    given = lambda q: sum(isinstance(t, Term) for t in q)
    names = lambda q: {t.name for t in q if isinstance(t, Var)}
    first = max(left, key=given)
    left.remove(first)
    out, known = match(quads, *first), names(first)
    while left:
        after = max(left, key=lambda q: (bool(names(q) & known), given(q)))
        left.remove(after)
        out, known = join(out, match(quads, *after)), known | names(after)
    return out
