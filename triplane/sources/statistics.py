"""What a graph holds: triples, and how many with each predicate and of each class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.operators.patterns import A, test


def counts(quads: DataFrame) -> DataFrame:
    """``kind, term, n``: one row for all triples, one for each predicate, one for each class."""
    every = quads.agg(F.count(F.lit(1)).alias("n")).select(F.lit("triples").alias("kind"), F.lit(None).cast("string").alias("term"), "n")
    by = lambda rows, column, kind: rows.groupBy(F.col(column)["lex"].alias("term")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "term", "n")
    return every.unionByName(by(quads, "p", "predicate")).unionByName(by(quads.where(test("p", A)), "o", "class"))


def top_share(counted: DataFrame, kind: str, quantile: int) -> DataFrame:
    """The most frequent terms of a kind: 1 / ``quantile`` of them, and one more."""
    rows = counted.where(F.col("kind") == kind)
    return rows.orderBy(F.desc("n"), "term").limit(rows.count() // quantile + 1)
