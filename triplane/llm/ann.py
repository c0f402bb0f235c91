"""Approximate nearest neighbours by additive quantisation.

A vector is its length times a direction, and the direction is about the sum of one full-dimensional codeword from
each codebook. The codebooks are learnt on a bounded sample: k-means on the residuals of those before, then all
codewords together by least squares. Beam search finds a vector's codes. The codewords' sum, brought to the vector's own
length, stands for it in the inner products with the queries, so vectors of any finite length are coded alike.

The best of them for each query are scored exactly, on the original vectors. What a codewords' sum is off its
vector bounds how far its score is off, so whichever others could still be among the k best are told, and scored too:
nothing is missed on any table, and how well the codes fit it decides only how many vectors are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplane.llm.common import least_hashed, materialise
from triplane.llm.topk import GROUP_ROWS, QUERY_ROWS, stacked, usable

BOOKS, CODEWORDS, BEAM, SHORTLIST = 32, 128, 2, 64


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 and the lengths; no vector is zero. Nothing overflows on the way."""
    peak = np.abs(x).max(1).astype(np.float64)
    y = x.astype(np.float64) / peak[:, None]
    size = np.sqrt((y**2).sum(1))
    return (y / size[:, None]).astype(np.float32), peak * size


@dataclass
class Codebooks:
    """``books``: codebooks x codewords x dimensions."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of each vector by beam search over the codebooks."""
        m, k, d = self.books.shape
        codes_out = np.empty((len(x), m), np.uint8)
        for start in range(0, len(x), 512):
            part, _ = directions(x[start : start + 512])
            n = len(part)
            rest, codes, cost = part[:, None, :], np.empty((n, 1, 0), np.uint8), np.zeros((n, 1), np.float32)
            for book in self.books:
                more = (book**2).sum(1) - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, -1, k)
                total = (cost[:, :, None] + more).reshape(n, -1)
                width = min(beam, total.shape[1])
                best = np.argpartition(total, width - 1, axis=1)[:, :width]
                of, code = best // k, best % k
                rest = np.take_along_axis(rest, of[:, :, None], axis=1) - book[code]
                codes = np.concatenate([np.take_along_axis(codes, of[:, :, None], axis=1), code[:, :, None].astype(np.uint8)], axis=2)
                cost = np.take_along_axis(total, best, axis=1)
            i = cost.argmin(1)
            codes_out[start : start + n] = codes[np.arange(n), i]
        return codes_out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The codewords' sums, brought to length 1 where they have any."""
        out = np.zeros((len(codes), self.books.shape[2]), np.float32)
        for j, book in enumerate(self.books):
            out += book[codes[:, j]]
        made = np.sqrt((out.astype(np.float64) ** 2).sum(1))
        return (out / np.where(made > 0.5, made, 1)[:, None]).astype(np.float32)


def _sums(near: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Sum of the vectors of each code."""
    order = np.argsort(near, kind="stable")
    found, first = np.unique(near[order], return_index=True)
    out = np.zeros((k, x.shape[1]), x.dtype)
    out[found] = np.add.reduceat(x[order], first)
    return out


def train(sample: np.ndarray, m: int = BOOKS, k: int = CODEWORDS, rounds: int = 8, seed: int = 0) -> Codebooks:
    """Codebooks from a sample of directions; k at most 256, and no more codewords than vectors."""
    rng, x = np.random.default_rng(seed), sample.astype(np.float32)
    k = min(k, len(x))
    rest, books, codes = x.copy(), [], []
    for _ in range(m):
        book = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            near = ((book**2).sum(1) - 2 * rest @ book.T).argmin(1)
            size = np.bincount(near, minlength=k)
            total = _sums(near, rest, k)
            book[size > 0] = total[size > 0] / size[size > 0, None]
        near = ((book**2).sum(1) - 2 * rest @ book.T).argmin(1)
        rest = rest - book[near]
        books.append(book)
        codes.append(near)
    # all codewords anew, by least squares given the codes: counts of codes that meet, and sums of what is left over
    gram = np.empty((m * k, m * k))
    for i, a in enumerate(codes):
        for j, b in enumerate(codes):
            gram[i * k : (i + 1) * k, j * k : (j + 1) * k] = np.bincount(a * k + b, minlength=k * k).reshape(k, k)
    gram.flat[:: m * k + 1] += 0.5
    left = np.concatenate([_sums(near, rest, k) for near in codes])
    joint = np.concatenate(books) + np.linalg.solve(gram, left).astype(np.float32)
    return Codebooks(joint.reshape(m, k, -1))


def index(vectors: DataFrame, sample_rows: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict[int, Codebooks]]:
    """Every usable vector as ``row, vec_id, v, codes``, as a written table, and the codebooks by vector length.

    Codebooks are learnt from the ``sample_rows`` vectors of least hash of the id. A length that the sample does not
    hold has no codes, and its vectors are scored exactly. Null, zero and non-finite vectors and null ids are left
    out. Repeated rows each have a place. Empty table: no rows. Other columns are not read, whatever they are called.
    """
    good = vectors.where(F.col(f"`{id_col}`").isNotNull() & usable(F.col(f"`{vector_col}`")) & F.exists(f"`{vector_col}`", lambda x: x != 0))
    rows = good.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    sample = least_hashed(rows.select("vec_id", "v"), "vec_id", sample_rows).toPandas()
    books = {}
    for dim in sorted(set(sample["v"].map(len))):
        books[int(dim)] = train(directions(stacked(sample["v"][sample["v"].map(len) == dim]))[0])
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = [None] * len(pdf)
            dims = pdf["v"].map(len)
            for dim in set(dims) & set(shared.value):
                at = np.flatnonzero(dims == dim)
                for i, row in zip(at, shared.value[dim].encode(stacked(pdf["v"].iloc[at]))):
                    codes[i] = row.tobytes()
            yield pdf.assign(codes=codes)

    coded = T.StructType([*rows.schema.fields, T.StructField("codes", T.BinaryType())])
    return materialise(rows.mapInPandas(run, coded), "codes"), books


def _top(score: np.ndarray, take: int) -> np.ndarray:
    """Places of the ``take`` highest scores in each row, or of all."""
    if score.shape[1] <= take:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    return np.argpartition(score, score.shape[1] - take, axis=1)[:, score.shape[1] - take :]


def _few_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among a query's k best: of equal vectors, those of the k + 1 smallest ids."""
    same = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    pdf = pd.DataFrame({"same": same, "id": ids})
    return np.flatnonzero((pdf.groupby("same")["id"].rank("dense") <= k + 1) & (pdf.groupby(["same", "id"]).cumcount() < k))


def _products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, part: int = 1 << 20) -> np.ndarray:
    """Inner products of pairs of rows, each summed in the order of the dimensions, so that equal vectors score alike."""
    out = np.zeros(len(i))
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(i), part):
            of = slice(at, at + part)
            for a, b in zip(q.T, x.T):
                out[of] += a[i[of]] * b[j[of]]
    return out


def _merged(of: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query ``of``, ties to the smaller id; what is no number comes first, as in Spark."""
    order = np.lexsort((ids, np.where(np.isnan(score), -np.inf, -score), of))
    of = of[order]
    keep = np.arange(len(of)) - np.searchsorted(of, of) < k
    return of[keep], score[order][keep], ids[order][keep]


def _best(cand: pd.DataFrame, asked: pd.DataFrame, books: Codebooks | None, k: int, take: int, batch: int = 256, chunk: int = 8192) -> tuple[pd.DataFrame, int]:
    """Each query's k best candidates of a group, its own rows left out, and how many pairs were scored exactly.

    The ``take`` best by their codes set the bar, the k-th best score so far. Others are scored where their score by
    codes, and what it may be off, reach the bar. Where codes leave many, products that err by rounding thin them out.
    """
    x, q = stacked(cand["v"]).astype(np.float64), np.asfortranarray(stacked(asked["v"]).astype(np.float64))
    ids, q_ids, dim = cand["vec_id"].to_numpy(), asked["vec_id"].to_numpy(), x.shape[1]
    kept = _few_copies(x, ids, k)
    kept = kept[np.argsort(-np.abs(x[kept]).max(1), kind="stable")]  # long vectors first, as they raise the bar
    x, ids = np.asfortranarray(x[kept]), ids[kept]
    (unit, size), (q_unit, q_size) = directions(x), directions(q)
    near = books.decode(np.frombuffer(b"".join(cand["codes"]), np.uint8).reshape(len(cand), -1)[kept]) if books else unit
    # off by the codes, and by the roundings of single precision
    off = np.sqrt(((unit - near).astype(np.float64) ** 2).sum(1)) + (dim + 8) * 2.0**-22
    ordinary = min(size.min(), q_size.min()) > 1e-140 and max(size.max(), q_size.max()) < 1e140  # no product is lost
    found, scored = [], 0
    for start in range(0, len(q), batch):
        ask = slice(start, start + batch)
        own, length = q_ids[ask, None], q_size[ask, None]
        best = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        for at in range(0, len(ids), chunk):
            of = slice(at, at + chunk)
            alive = ids[of] != own
            if ordinary:
                rough = (q_unit[ask] @ near[of].T) * size[of]
                first = np.zeros_like(alive)
                np.put_along_axis(first, _top(np.where(alive, rough, -np.inf), take), True, axis=1)
                rounds = [first & alive, alive & ~first]
            else:
                rounds = [alive]
            for turn, some in enumerate(rounds):
                if turn:
                    bar = np.full((len(some), 1), -np.inf)
                    full = np.flatnonzero(np.bincount(best[0], minlength=len(some)) == k)
                    bar[full, 0] = best[1][np.searchsorted(best[0], full, "right") - 1]
                    some &= (rough + off[of] * size[of]) * length >= bar
                    if some.mean() > 1 / 64:
                        some &= q[ask] @ x[of].T + (dim + 8) * 2.0**-51 * size[of] * length >= bar
                i, j = np.nonzero(some)
                scored += len(i)
                more = i, _products(q[ask], x[of], i, j), ids[of][j]
                best = _merged(*(np.concatenate(both) for both in zip(best, more)), k)
        found.append(pd.DataFrame({"query_id": q_ids[ask][best[0]], "own": asked["own"].to_numpy()[ask][best[0]], "vec_id": best[2], "score": best[1]}))
    return pd.concat(found, ignore_index=True), scored


def nearest(indexed: DataFrame, books: dict[int, Codebooks], is_query: Column, k: int = 20, shortlist: int = SHORTLIST, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` over a table from :func:`index`, by largest inner product.

    Queries and candidates are dealt into groups by hash and a task takes one group of each, so neither side is
    broadcast; the codebooks, of fixed size, are. A task finds the k best of its group: the ``shortlist`` best by their
    codes, and all that the bounds do not rule out. Groups of long vectors hold fewer. Ties to the smaller vec_id.
    Fewer candidates than k: all. Repeated candidate rows each take a place, but those of the query's id do not. Query
    rows of one id and vector are one query; of one id and different vectors, each has a ranking of its own. Vectors
    of different lengths do not meet. Empty table: no rows. Scores are in double precision, infinite beyond it.
    """
    n, n_q, widest = indexed.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    group_rows, query_rows = (max(1, min(rows, (1 << 22) // widest)) for rows in (group_rows, query_rows))
    # some 24 tasks for small tables; few groups of queries, as each takes a copy of the candidates
    groups = max(1, -(-n // group_rows), min(12, -(-n // 4096)))
    q_groups = max(1, -(-n_q // query_rows), min(-(-24 // groups), -(-n_q // 256)))
    shared = indexed.sparkSession.sparkContext.broadcast(books)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dim = F.size("v").alias("dim")
    cand = indexed.select(dim, F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g"), every(q_groups).alias("qg"), "vec_id", "codes", "v")
    asked = indexed.where(is_query).select(dim, "vec_id", "v").dropDuplicates().withColumn("own", F.xxhash64("v"))
    dealt = asked.select("dim", every(groups).alias("g"), F.pmod(F.xxhash64("vec_id", "own"), F.lit(q_groups)).cast("int").alias("qg"), "vec_id", "own", "v")
    schema = "query_id long, own long, vec_id long, score double"

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "own": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        return _best(left, right, shared.value.get(len(right["v"].iloc[0])), k, max(k, shortlist))[0]

    keys = ["dim", "g", "qg"]
    scored = cand.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(pair, schema)
    rank = F.expr("row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id)")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    indexed, books = index(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return nearest(indexed, books, F.col("vec_id") % 20 == 0)
