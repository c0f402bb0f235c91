"""Exact top-k by inner product without random access.

Candidates are dealt into blocks. In a block, each dimension is a list of candidates sorted by their component; read
from the top for a positive weight of the query and from the bottom for a negative one, it is a list sorted by what
that dimension adds to the score. The lists are read in step, a little further each time. What a candidate has been
seen to add, and what the lists say of all they have not shown yet, give a lower and an upper bound of its score: what
is unread in a list adds at most what was read last, and at least what stands at its end. The bar is the k-th best
lower bound seen so far, in this block or those before it. A block is done when few candidates can still reach the
bar; these are then resolved, that is, scored in full. Blocks with long vectors come first, as they raise the bar.

Integers below 2 ** 53 are exact in the bounds; where scores could be larger, they are computed as Python integers.
Candidates equal to the bar are kept, so ties are decided by the id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
GROUP_ROWS, QUERY_ROWS = 65_536, 32_768
#: Shares of the lists after which the bounds are compared.
DEPTHS = (1 / 64, 1 / 16, 1 / 4, 1 / 2, 5 / 8, 3 / 4)
EXACT = 1 << 53


class Lists:
    """The sorted lists of one block: the place of each candidate in each dimension's list, from the low end."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float64)
        n = len(vectors)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, order, axis=0)
        self.from_low = np.empty_like(order)
        np.put_along_axis(self.from_low, order, np.arange(n)[:, None], axis=0)
        self.read: dict[int, tuple[np.ndarray, ...]] = {}

    def to_depth(self, depth: int) -> tuple[np.ndarray, ...]:
        """After ``depth`` entries of every list, read from the top and from the bottom: what has been seen of each
        candidate, what more an unread entry may add and must at least add, and both of these for a whole list."""
        if depth not in self.read:
            n = len(self.vectors)
            seen = np.concatenate([self.from_low >= n - depth, self.from_low < depth], 1)
            far = np.concatenate([self.sorted[0], self.sorted[-1]])  # the ends of the lists
            front = np.concatenate([self.sorted[n - depth], self.sorted[depth - 1]])  # what was read last
            twice = np.concatenate([self.vectors, self.vectors], 1)
            self.read[depth] = seen * (twice - far), seen * (twice - front), far, front
        return self.read[depth]

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries x candidates: lower and upper bounds of the scores after ``depth`` entries of every list."""
        q = queries.astype(np.float64)
        weights = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], 1)
        over_far, over_front, far, front = self.to_depth(depth)
        return weights @ over_far.T + (weights @ far)[:, None], weights @ over_front.T + (weights @ front)[:, None]


def no_random_access(lists: Lists, queries: np.ndarray, k: int, floor: np.ndarray, depths: tuple[float, ...] = DEPTHS) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query the places in the block of every candidate that may be among its k best and reach its ``floor``,
    and the depth at which it stopped reading.

    All queries read the lists in step, to the same depths one after another. A query stops when those who can still
    qualify are few; one that does not stop reads its lists to the end, where all scores are known. ``floor``: the
    k-th best lower bound of earlier blocks, or -inf.
    """
    n, d = lists.vectors.shape
    out: list[np.ndarray] = [np.arange(n)] * len(queries)
    stopped = np.full(len(queries), n)
    bar = floor.astype(np.float64)
    open_ = np.arange(len(queries))
    for share in depths:
        depth = max(1, int(n * share))
        if not len(open_) or not d or depth >= n:
            break
        lower, upper = lists.bounds(queries[open_], depth)
        raises = np.flatnonzero(lower.max(1) > bar[open_]) if n >= k else ()
        if len(raises):
            bar[open_[raises]] = np.maximum(bar[open_[raises]], np.partition(lower[raises], n - k, axis=1)[:, n - k])
        alive = upper >= bar[open_, None]
        done = alive.sum(1) <= max(4 * k, n // 16)
        for i in np.flatnonzero(done):
            out[open_[i]] = np.flatnonzero(alive[i])
        stopped[open_[done]] = depth
        open_ = open_[~done]
    return out, stopped


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def _large(cand: np.ndarray, cand_ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best where 53 bits do not hold the scores: all of them, as Python integers, held within 64 bits."""
    other = cand_ids != query_id
    score = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in cand[other].astype(object) @ query.astype(object)]
    best = sorted(zip(score, cand_ids[other].tolist()), key=lambda x: (-x[0], x[1]))[:k]
    return np.array([s for s, _ in best], np.int64), np.array([i for _, i in best], np.int64)


def block_search(cand: np.ndarray, cand_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, batch: int = 256) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Scores and ids of the k best of some candidates for each query, itself left out; blocks in turn, with the bar
    that earlier ones set."""
    if not len(cand) or not len(queries):
        return [np.empty(0, np.int64)] * len(queries), [np.empty(0, np.int64)] * len(queries)
    peak = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (cand, queries)]
    if peak[0] * peak[1] * max(1, cand.shape[1]) >= EXACT:
        both = [_large(cand, cand_ids, q, i, k) for q, i in zip(queries, query_ids)]
        return [s for s, _ in both], [w for _, w in both]
    order = np.argsort(-(cand.astype(np.float64) ** 2).sum(1), kind="stable")
    cand, cand_ids = cand[order], cand_ids[order]
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in query_ids]
    for at in range(0, len(cand), BLOCK):
        lists, ids = Lists(cand[at : at + BLOCK]), cand_ids[at : at + BLOCK]
        for start in range(0, len(queries), batch):
            asked = range(start, min(start + batch, len(queries)))
            floor = np.array([out[i][0][k - 1] if len(out[i][0]) >= k else -np.inf for i in asked], np.float64)
            # one more than k, as the query itself may be among them
            few, _ = no_random_access(lists, queries[start : start + batch], k + 1, floor)
            whole = [j for j, f in enumerate(few) if len(f) == len(ids)]  # read to the end
            ends = dict(zip(whole, (lists.vectors @ queries[start + np.array(whole, int)].T.astype(np.float64)).T)) if whole else {}
            for j, i in enumerate(asked):
                best, who = out[i]
                if j in ends:
                    score = ends[j]
                    bar = max(floor[j], np.partition(score, len(score) - k - 1)[len(score) - k - 1]) if len(score) > k else -np.inf
                    places = np.flatnonzero(score >= bar)
                    score = score[places]
                else:
                    places = few[j]
                    score = lists.vectors[places] @ queries[i]
                other = ids[places] != query_ids[i]
                out[i] = _best(np.concatenate([best, score[other].astype(np.int64)]), np.concatenate([who, ids[places][other]]), k)
    return [s for s, _ in out], [w for _, w in out]


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def stacked(vectors: pd.Series) -> np.ndarray:
    """A column of vectors of one length as a matrix; rows of no component give one of width 0."""
    return np.stack(vectors.tolist()) if len(vectors) else np.empty((0, 0))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k candidates of highest integer inner product.

    Components x count as floor(``scale`` * x), within 64 bits. Candidates: every row but the query's own; ties to the
    smaller vec_id. Scores are exact; one beyond 64 bits counts as the nearest that they hold. Vectors that are null
    or hold null or non-finite components, and rows with a null id, take no part. Vectors of different lengths have no
    inner product and do not meet. Repeated candidate rows each take a place, but rows of the query's own id do not.
    Query rows of one id and vector are one query; of one id and different vectors, each has a ranking of its own.
    Fewer candidates than k: all. Empty table: no rows. Other columns are not read, whatever they are called.

    Queries and candidates are dealt into groups by hash, repeated rows too, and a task takes one group of each, so neither side is
    broadcast and every task's input is bounded. Vectors move as they are stored. Each row moves once for each group
    of the other side: the pairs to decide grow with queries times rows, and the groups are as large as a task's
    memory lets them be. The best k of each pair of groups are merged by query.
    """
    good = vectors.where(F.col(f"`{id_col}`").isNotNull() & usable(F.col(f"`{vector_col}`")))
    rows = good.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"), is_query.alias("q"), F.monotonically_increasing_id().alias("row")).withColumn("dim", F.size("v"))
    n, n_q = rows.agg(F.count("*"), F.count_if("q")).first()
    groups, q_groups = max(1, -(-n // group_rows), min(48, -(-n // 512))), max(1, -(-n_q // query_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cand = rows.select("dim", F.pmod(F.xxhash64("vec_id", "row"), F.lit(groups)).cast("int").alias("g"), every(q_groups).alias("qg"), "vec_id", "v")
    asked = rows.where("q").select("dim", "vec_id", "v").dropDuplicates().withColumn("own", F.xxhash64("v"))
    asked = asked.select("dim", every(groups).alias("g"), F.pmod(F.xxhash64("vec_id", "own"), F.lit(q_groups)).cast("int").alias("qg"), "vec_id", "own", "v")

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = (_whole(stacked(x["v"]), scale) for x in (left, right))
        scores, who = block_search(a, left["vec_id"].to_numpy(), b, right["vec_id"].to_numpy(), k)
        sizes = [len(w) for w in who]
        return pd.DataFrame({
            "query_id": np.repeat(right["vec_id"].to_numpy(), sizes), "own": np.repeat(right["own"].to_numpy(), sizes),
            "vec_id": np.concatenate(who or [[]]).astype(np.int64), "score": np.concatenate(scores or [[]]).astype(np.int64),
        })

    keys = ["dim", "g", "qg"]
    found = cand.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(pair, "query_id long, own long, vec_id long, score long")
    rank = F.expr("row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; what they do not hold becomes the nearest that they do."""
    y = np.floor(scale * x.astype(np.float64))
    out = np.clip(y, -(2.0**63), 2.0**62).astype(np.int64)
    out[y >= 2.0**63] = (1 << 63) - 1
    out[(y > 2.0**62) & (y < 2.0**63)] = y[(y > 2.0**62) & (y < 2.0**63)].astype(np.int64)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
