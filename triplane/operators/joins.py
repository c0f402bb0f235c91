"""Joins of solutions: two rows go together if every variable that both bind has the same value.

Where a shared variable is bound in every row of both sides, that is an equi-join. Where it may be unbound, a condition
with OR would plan as a nested loop; instead each side is split by which of these variables are bound, every pair of
parts is an equi-join on what both bind, and the results are united. Name such variables in ``maybe``.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RIGHT = "`.right."


def right(name: str) -> Column:
    """A variable of the right side, for conditions; of a shared one too."""
    return F.col(f"{RIGHT}{name}`")


def _renamed(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f".right.{c}") for c in df.columns))


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def _parts(df: DataFrame, maybe: list[str]) -> list[tuple[frozenset[str], DataFrame]]:
    """The rows by which variables of ``maybe`` they bind."""
    masks = product((True, False), repeat=len(maybe))
    if len(maybe) > 2:  # many patterns, of which few occur: these are looked up first, 2 ** n rows at most
        masks = [tuple(r) for r in df.select(*(F.col(f"`{n}`").isNotNull() for n in maybe)).distinct().collect()] or [(True,) * len(maybe)]
    out = []
    for mask in masks:
        part = df
        for name, is_bound in zip(maybe, mask):
            column = F.col(f"`{name}`")
            part = part.where(column.isNotNull() if is_bound else column.isNull())
        out.append((frozenset(n for n, m in zip(maybe, mask) if m), part))
    return out


def _on(names: list[str], condition: Column | None) -> Column:
    tests = [F.col(f"`{n}`") == right(n) for n in names] + ([condition] if condition is not None else [])
    return reduce(lambda x, y: x & y, tests, F.lit(True))


def _split(left_df: DataFrame, right_df: DataFrame, maybe: tuple[str, ...]):
    """Left parts, each with the right parts (renamed) and the variables that both of them bind."""
    shared = _shared(left_df, right_df)
    unsure = [n for n in maybe if n in shared]
    sure = [n for n in shared if n not in unsure]
    rights = _parts(_renamed(right_df), [f".right.{n}" for n in unsure])
    for bound_left, left_part in _parts(left_df, unsure):
        yield left_part, [(sure + [n for n in unsure if n in bound_left and f".right.{n}" in bound_right], part) for bound_right, part in rights]


def _merged(left_df: DataFrame, right_df: DataFrame) -> list[Column]:
    shared = _shared(left_df, right_df)
    own = [F.coalesce(F.col(f"`{c}`"), right(c)).alias(c) if c in shared else F.col(f"`{c}`") for c in left_df.columns]
    return own + [right(c).alias(c) for c in right_df.columns if c not in shared]


def join(left_df: DataFrame, right_df: DataFrame, condition: Column | None = None, maybe: tuple[str, ...] = ()) -> DataFrame:
    """Inner join; without a shared variable, every pair of rows that meets ``condition``."""
    shared = _shared(left_df, right_df)
    if condition is None and not set(maybe) & set(shared):
        return left_df.join(right_df, shared, "inner") if shared else left_df.crossJoin(right_df)
    out = _merged(left_df, right_df)
    found = [part.join(other, _on(names, condition), "inner").select(*out) for part, others in _split(left_df, right_df, maybe) for names, other in others]
    return reduce(DataFrame.unionByName, found)


def optional(left_df: DataFrame, right_df: DataFrame, condition: Column | None = None, maybe: tuple[str, ...] = ()) -> DataFrame:
    """Left join. ``condition`` belongs to the join: it sees both sides, and a row without a match stays."""
    out = _merged(left_df, right_df)
    found = []
    for part, others in _split(left_df, right_df, maybe):
        if len(others) == 1:
            names, other = others[0]
            found.append(part.join(other, _on(names, condition), "left").select(*out))
            continue
        alone = part
        for names, other in others:
            found.append(part.join(other, _on(names, condition), "inner").select(*out))
            alone = alone.join(other, _on(names, condition), "left_anti")
        missing = [F.lit(None).cast(right_df.schema[c].dataType).alias(c) for c in right_df.columns if c not in left_df.columns]
        found.append(alone.select(*(F.col(f"`{c}`") for c in left_df.columns), *missing))
    return reduce(DataFrame.unionByName, found)


def minus(left_df: DataFrame, right_df: DataFrame, maybe: tuple[str, ...] = ()) -> DataFrame:
    """Left rows without a right row that agrees with them in a variable that both bind, and disagrees in none."""
    kept = []
    for part, others in _split(left_df, right_df, maybe):
        for names, other in others:
            if names:
                part = part.join(other, _on(names, None), "left_anti")
        kept.append(part)
    return reduce(DataFrame.unionByName, kept)


def _any(part: DataFrame, other: DataFrame, names: list[str], condition: Column | None, negated: bool) -> DataFrame:
    """Rows of ``part`` with (or without) a row of ``other`` that has these variables in common."""
    if names or condition is not None:
        return part.join(other, _on(names, condition), "left_anti" if negated else "left_semi")
    there = other.select(F.lit(1)).limit(1).exists()  # any row will do: a scalar subquery, no join
    return part.where(~there if negated else there)


def exists(left_df: DataFrame, right_df: DataFrame, condition: Column | None = None, negated: bool = False, maybe: tuple[str, ...] = ()) -> DataFrame:
    """Left rows with (or, negated, without) a right row that agrees in the shared variables and meets ``condition``.

    A variable of ``maybe`` that either side leaves unbound agrees with anything, as it is not substituted.
    """
    kept = []
    for rest, others in _split(left_df, right_df, maybe):
        for i, (names, other) in enumerate(others):
            if not negated:
                kept.append(_any(rest, other, names, condition, False))
            if negated or i + 1 < len(others):
                rest = _any(rest, other, names, condition, True)
        if negated:
            kept.append(rest)
    return reduce(DataFrame.unionByName, kept)


def not_exists(left_df: DataFrame, right_df: DataFrame, condition: Column | None = None, maybe: tuple[str, ...] = ()) -> DataFrame:
    return exists(left_df, right_df, condition, negated=True, maybe=maybe)


def exists_flag(left_df: DataFrame, right_df: DataFrame, name: str, maybe: tuple[str, ...] = ()) -> DataFrame:
    """A boolean column that says whether such a right row exists, for use inside larger expressions."""
    shared = _shared(left_df, right_df)
    if set(maybe) & set(shared):
        return exists(left_df, right_df, maybe=maybe).withColumn(name, F.lit(True)).unionByName(not_exists(left_df, right_df, maybe=maybe).withColumn(name, F.lit(False)))
    if not shared:
        return left_df.withColumn(name, right_df.select(F.lit(1)).limit(1).exists())
    keys = right_df.select(*(F.col(f"`{c}`") for c in shared)).distinct().withColumn(name, F.lit(True))
    return left_df.join(keys, shared, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
