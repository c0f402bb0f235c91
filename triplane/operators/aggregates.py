"""Aggregates over solutions. Each takes a column, native or of terms, and gives an aggregate for ``groupBy().agg()``.

Unbound values and errors are NULL: counts and extremes pass over them, sums and averages become unbound. Without keys
there is one group, also of no rows; with keys, no rows give no group. All but group_concat and the distinct ones
combine before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.terms import DECIMAL, DOUBLE, FLOAT, canonical_decimal, exact, integer, literal, number, order_keys, rank
from triplane.terms import double as double_term


def group(df: DataFrame, keys: dict[str, Column] | list[str], having: Column | None = None, **aggregates: Column) -> DataFrame:
    """Groups by variables or named expressions, an unbound key being one of its own; ``having`` sees keys and aggregates."""
    by = [F.col(f"`{k}`") for k in keys] if isinstance(keys, list) else [c.alias(n) for n, c in keys.items()]
    made = [c.alias(n) for n, c in aggregates.items()]
    out = df.groupBy(*by).agg(*made) if by else df.agg(*made)
    return out if having is None else out.where(having)


def count_all() -> Column:
    return F.count(F.lit(1))


def count(x: Column, distinct: bool = False) -> Column:
    return F.count_distinct(x) if distinct else F.count(x)


def count_distinct_rows(*names: str) -> Column:
    """COUNT(DISTINCT *): rows that differ in a variable, unbound being a value like others."""
    return F.count_distinct(F.struct(*(F.col(f"`{n}`") for n in names)))


def _sound(x: Column) -> Column:
    return F.count(F.lit(1)) == F.count(x)


def total(x: Column, distinct: bool = False) -> Column:
    """SUM of a native column: unbound where a value is; 0 of nothing."""
    whole = F.sum_distinct(x) if distinct else F.sum(x)
    return F.when(_sound(x), F.coalesce(whole, F.lit(0)))


def average(x: Column, distinct: bool = False) -> Column:
    """AVG of a native column: unbound where a value is; 0 of nothing."""
    mean = F.try_divide(F.sum_distinct(x).cast("double"), F.count_distinct(x)) if distinct else F.avg(x)
    return F.when(_sound(x), F.coalesce(mean, F.lit(0.0)))


def total_terms(t: Column) -> Column:
    """SUM of a term column: the widest numeric datatype of the group; a value that is no number unbinds it."""
    kind = F.coalesce(F.max(rank(t)), F.lit(1))
    value = F.sum(number(t))
    made = (
        F.when(kind == 1, integer(F.coalesce(F.sum(exact(t)), F.lit(0))))
        .when(kind == 2, literal(canonical_decimal(F.sum(exact(t))), DECIMAL))
        .when(kind == 3, double_term(value, FLOAT))
        .otherwise(double_term(value, DOUBLE))
    )
    return F.when(_sound(number(t)), made)


def average_terms(t: Column) -> Column:
    kind = F.max(rank(t))
    made = F.when(kind <= 2, literal(canonical_decimal(F.avg(exact(t))), DECIMAL)).when(kind == 3, double_term(F.avg(number(t)), FLOAT)).otherwise(double_term(F.avg(number(t)), DOUBLE))
    return F.when(_sound(number(t)), F.when(F.count(F.lit(1)) == 0, integer(F.lit(0))).otherwise(made))


def _key(t: Column) -> Column:
    return F.when(t.isNotNull(), F.struct(*(k.alias(f"k{i}") for i, k in enumerate(order_keys(t)))))


def least(t: Column) -> Column:
    """MIN of terms in their sort order; min() is enough for native columns."""
    return F.min_by(t, _key(t))


def greatest(t: Column) -> Column:
    return F.max_by(t, _key(t))


def sample(x: Column) -> Column:
    """Some value of the group: the least, so that it is the same each time."""
    return F.min(x)


def group_concat(x: Column, separator: str = " ", distinct: bool = False) -> Column:
    """The values as one string, in order."""
    return F.array_join(F.array_sort(F.collect_set(x) if distinct else F.collect_list(x)), separator)


def all_of(*conditions: Column) -> Column:
    """Several HAVING conditions as one."""
    return reduce(lambda a, b: a & b, conditions)
