"""Projection, filters, extension, order, slices, distinct rows, unions and inline data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplane.terms import TERM, ebv, lift, order_keys
from triplane.written import written


def project(df: DataFrame, *names: str) -> DataFrame:
    """The named variables; one that the solutions do not have is unbound."""
    return df.select(*(F.col(f"`{n}`") if n in df.columns else F.lit(None).cast(TERM).alias(n) for n in names))


def project_all(df: DataFrame) -> DataFrame:
    """Every variable by name, but for hidden ones, which begin with a dot."""
    return df.select(*(F.col(f"`{n}`") for n in sorted(df.columns) if not n.startswith(".")))


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Rows whose condition, a boolean or a term column, is true; an error drops the row."""
    kind = df.select(condition.alias("c")).schema["c"].dataType
    return df.where(ebv(condition) if isinstance(kind, T.StructType) else condition)


def extend(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A further variable; an error leaves it unbound. Of a variable that is there, rows where it is bound to something else go."""
    if name not in df.columns:
        return df.withColumn(name, value)
    old = F.col(f"`{name}`")
    return df.withColumn(".new", value).where(old.isNull() | F.col("`.new`").isNull() | (old == F.col("`.new`"))).withColumn(name, F.coalesce(old, F.col("`.new`"))).drop(".new")


def distinct(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


reduced = distinct


def union(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; a variable that one part does not have is unbound there.

    Where the parts hold a variable in different kinds of columns, it becomes a column of terms in all of them.
    """
    kinds: dict[str, set] = {}
    for p in parts:
        for f in p.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = [n for n, k in kinds.items() if len(k) > 1]
    out = None
    for p in parts:
        for n in mixed:
            if n in p.columns:
                p = p.withColumn(n, lift(F.col(f"`{n}`"), p.schema[n].dataType))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def order(df: DataFrame, *keys: tuple[Column, bool]) -> DataFrame:
    """(column, ascending) keys. Terms: unbound, blank nodes, IRIs, literals by value; native columns by their own order."""
    by = []
    for column, up in keys:
        kind = df.select(column.alias("c")).schema["c"].dataType
        parts = order_keys(column) if isinstance(kind, T.StructType) else [column]
        by += [p.asc_nulls_first() if up else p.desc_nulls_last() for p in parts]
    return df.orderBy(*by)


def placed(df: DataFrame, *keys: tuple[Column, bool], name: str = "pos") -> DataFrame:
    """Every row with its place in the order of ``keys`` (see :func:`order`), from 1; keys that tie are in any order.

    Rows are range-partitioned and sorted once, and written so with their number in the partition; what reaches the
    driver is a count for each partition. No task holds the table.
    """
    id_ = F.col("`.id`")
    rows = written(order(df, *keys).withColumn(".id", F.monotonically_increasing_id()), "ordered")
    before, starts = 0, []
    # the upper bits of the number are the partition, the lower 33 the row in it
    for part, n in sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright(id_, 33).alias("part")).count().collect()):
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "`.part` long, `.before` long")
    place = F.col("`.before`") + id_.bitwiseAND((1 << 33) - 1) + 1
    rows = rows.join(F.broadcast(offsets), F.shiftright(id_, 33) == F.col("`.part`"))
    return rows.select(place.alias(name), *(F.col(f"`{c}`") for c in df.columns))


def cut(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """LIMIT and OFFSET; after order() this is a top-k, which Spark plans as such."""
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """Inline data; None is UNDEF, an unbound variable."""
    return spark.createDataFrame(rows, schema)


def unit(spark: SparkSession) -> DataFrame:
    """One solution that binds nothing."""
    return spark.range(1).select()


def nothing(df: DataFrame) -> DataFrame:
    return df.limit(0)
