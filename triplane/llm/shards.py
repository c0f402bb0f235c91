"""Sharding by longest-processing-time scheduling, for corpora that no single machine can list.

Groups of equal texts stay together. All groups, sorted by their bytes, go in turn to the least-loaded shard. Groups
of one size can stand for each other, so the schedule is made over distinct sizes: the driver sees one row for each,
with the number of its groups, and the heap gives each shard a number of them. Distinct sizes that add up to B bytes
are fewer than the root of 2 B, whatever the number of groups. A group's place among those of its size, by a sort of
all groups over ranges, then says which shard is its own. The rows themselves stay on the executors.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.llm.common import discard, materialise

#: Of the groups with the most rows, at most this many are joined by broadcast; the rows of any other are few.
LARGE_GROUPS = 10_000
SALTS = 16


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each shard gets, each in turn going to the least load; ``loads`` grows.

    Ties go to the smaller shard. The k-th group that a shard takes finds it at load + (k - 1) * size, and those
    ``count`` takings come first, by load and shard, of all that there could be: beyond some 64 groups a shard, the
    bar is found by bisection instead of group by group.
    """
    n, got = len(loads), [0] * len(loads)
    if count > 64 * n:
        below = lambda bar: sum(max(0, -(-(bar - load) // size)) for load in loads)  # noqa: E731  takings under the bar
        low, high = min(loads), max(loads) + size * count
        while low < high:  # the largest bar that leaves no more than ``count`` takings under it
            middle = (low + high + 1) // 2
            low, high = (middle, high) if below(middle) <= count else (low, middle - 1)
        got = [max(0, -(-(low - load) // size)) for load in loads]
        for s, g in enumerate(got):
            loads[s] += g * size
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        got[s] += 1
        loads[s] += size
    return got


def lpt(counts: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, list[int]]]:
    """(size, number of groups) -> (size, groups of larger sizes, groups dealt up to each shard), largest first."""
    loads, before, out = [0] * n_shards, 0, []
    for size, count in sorted(counts, reverse=True):
        upto = 0
        out.append((size, before, [upto := upto + g for g in deal(loads, size, count)]))
        before += count
    return out


def _numbered(rows: DataFrame, by: str, number: str) -> DataFrame:
    """A written table with a column ``row_id`` of monotonically increasing ids: rows of each ``by``, counted through from 0.

    Rows are counted within their partition, which bounds the window's groups, and before it by a table of one row for
    each partition and ``by``.
    """
    part = rows.withColumn("part", F.shiftright("row_id", 33))
    counts = part.groupBy("part", by).agg(F.count("*").alias("n"))
    before = F.expr(f"sum(n) OVER (PARTITION BY `{by}` ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    starts = counts.select("part", by, F.coalesce(before, F.lit(0)).alias("start"))
    nth = F.expr(f"row_number() OVER (PARTITION BY part, `{by}` ORDER BY row_id)")
    found = part.withColumn("nth", nth).join(starts, ["part", by])
    return found.withColumn(number, (F.col("start") + F.col("nth") - 1).cast("long")).drop("part", "start", "nth")


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", large_groups: int = LARGE_GROUPS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row, under the law ``bytes``.

    ``size``: UTF-8 bytes of the text plus 1. A null text counts as one without bytes, and so stays with the empty
    texts. Null or repeated doc_id, repeated rows: each row has its own slot. Ties: groups of one size are dealt by a
    hash of their text. Empty table: no rows. Very long texts count whole. Other columns are not read, whatever they
    are called. ``slot`` counts the rows of a shard from 0, without gaps, in the order of the input; neither a shard
    nor a group of copies has to fit in one task.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    rows = materialise(rows, "sized")  # the texts are read once
    same = ["h", "text_crc32", "size"]
    groups = rows.groupBy(*same).agg(F.count("*").alias("n")).withColumn("total", F.col("n") * F.col("size"))
    # ranges of all keys, so that groups of one size spread over tasks
    groups = materialise(groups.orderBy(F.desc("total"), *same).withColumn("row_id", F.monotonically_increasing_id()), "groups")
    counts = [(r["total"], r["count"]) for r in groups.groupBy("total").count().collect()]
    plan = spark.createDataFrame(lpt(counts, n_shards), "total long, before long, upto array<long>")
    starts, at = [], 0
    for r in sorted(groups.groupBy(F.shiftright("row_id", 33).alias("part")).count().collect()):
        starts.append((r["part"], at))
        at += r["count"]
    starts = spark.createDataFrame(starts, "part long, start long")  # a row for each partition
    placed = groups.withColumn("part", F.shiftright("row_id", 33)).join(F.broadcast(starts), "part")
    salted = plan.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))  # many groups may have one size
    placed = placed.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["total", "salt"])
    nth = F.col("start") + F.col("row_id").bitwiseAND((1 << 33) - 1) - F.col("before")
    placed = materialise(placed.select(*same, "n", F.size(F.filter("upto", lambda u: u <= nth)).alias("shard")), "placed")
    # at most ``large_groups`` groups have so many rows each; of any other, a key brings that many rows at most together
    many = F.col("n") * large_groups >= F.lit(max(1, rows.count()))
    few, rest = placed.where(many).select(*same, F.col("shard").alias("few")), placed.where(~many).select(*same, F.col("shard").alias("rest"))
    put = rows.join(F.broadcast(few), same, "left")
    told = put.where("few IS NOT NULL").select("doc_id", "size", "text_crc32", F.col("few").alias("shard"))
    others = put.where("few IS NULL").drop("few").join(rest, same).select("doc_id", "size", "text_crc32", F.col("rest").alias("shard"))
    whole = materialise(told.unionByName(others).withColumn("row_id", F.monotonically_increasing_id()), "sharded")
    discard(rows, groups, placed)
    slots = _numbered(whole, "shard", "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
