"""Helpers shared by the training-data operators: column names, batches by bytes, components of a graph, samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplane.written import discard, shared_dir
from triplane.written import written as materialise

__all__ = ["connected_components", "discard", "handed", "held_out", "kept_columns", "least_hashed", "materialise", "parts", "shared_dir"]


def kept_columns(keep: Iterable[str], results: Iterable[str]) -> list[Column]:
    """Columns that an operator hands through. One that is called as a result gets ``_kept`` behind its name, until it is free."""
    taken, out = {r.lower() for r in results}, []
    for c in keep:
        name = c
        while name.lower() in taken:
            name += "_kept"
        taken.add(name.lower())
        out.append(F.col(f"`{c}`").alias(name))
    return out


def handed(docs: DataFrame, id_col: str, text_col: str, keep: Iterable[str], results: tuple[str, ...]) -> tuple[DataFrame, int, list[T.StructField]]:
    """What an operator's Python side takes: the id, called as the first of ``results``, the kept columns and the text;
    the place of the text, which moves but once, and the fields of the kept columns, which come right after the id."""
    kept = [c for c in keep if c != id_col]
    columns = [F.col(f"`{id_col}`").alias(results[0]), *kept_columns(kept, results)]
    at = len(columns)
    if text_col in kept and isinstance(docs.schema[text_col].dataType, T.StringType):
        at = 1 + kept.index(text_col)
    else:
        columns.append(F.col(f"`{text_col}`").cast("string").alias(results[-1]))
    taken = docs.select(columns)
    return taken, at, taken.schema.fields[1 : 1 + len(kept)]


def parts(batch: pa.RecordBatch, column: int, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and about ``size`` bytes in ``column``, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)``, longs -> ``(node, component)``: each node of an edge with the smallest node it can reach.

    Large-star and small-star steps in turn until nothing changes. Every step is a partial minimum by node and an
    equi-join, so a hub's rows are pre-aggregated before they move and AQE may split its join partition. No component
    is held by one task or the driver. The result is a written table; the caller may ``discard`` it.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components")
        # large star: every larger neighbour of u points at the least node that u knows
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point at the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(small, "components")
        same = after.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(after, ["u", "v"], "left_anti").isEmpty()
        discard(least, now)
        now = after
        if same:
            break
    whole = materialise(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(now)
    return whole


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def least_hashed(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows of least hash of the id: a bounded sample that does not depend on how rows are laid out.

    Sorting all of it would bring up to ``n`` rows of every partition together. So rows are first counted by the
    leading zeros of their hash, and only the smallest such range that holds ``n`` rows is sorted: twice ``n``, or so.
    """
    h = F.xxhash64(id_col)
    bits = F.length(F.bin(h.bitwiseXOR(F.lit(-(1 << 63)))))  # in the order of the signed hash
    held, cut = 0, 64
    for row in sorted(df.groupBy(bits.alias("bits")).count().collect()):
        held += row["count"]
        if held >= n:
            cut = row["bits"]
            break
    return df.where(bits <= cut).orderBy(h, id_col).limit(n)
