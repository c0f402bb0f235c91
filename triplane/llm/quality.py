"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn, round after round; each visit fits a shallow tree to the gradient over
the bins of one feature and adds a little of it to the feature's lookup table. Pairs whose residual gain is largest
get tables of their own in the same way. A score is a sum of table entries at the bins of a text's features, and its
logistic function. The model is learnt by the driver from a bounded sample of labelled rows; features and scores are
made by the executors over whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplane.llm.common import handed, held_out, least_hashed, parts

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digit", "stop", "shout", "symbol", "pipe",
    "wide", "space", "distinct_words", "short_words", "line_length", "repeated_lines", "words_a_stop", "edge_symbols",
)
_CLASS = np.full(256, 8, np.uint8)  # 8: other ASCII symbols
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-?", b"!", b"|", b" \t\r\v\f", b"\n")):
    _CLASS[list(_bytes)] = _k
_CLASS[128:192], _CLASS[192:] = 10, 9  # continuing and leading bytes of wider characters


def features(text: str | None) -> list[float]:
    """Features of one whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11).tolist()
    lower, upper, digit, stop, shout, pipe, space, line, symbol, wide, _ = counts
    chars = max(1, n - counts[10])
    words = raw.split()
    k = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = set(words)
    letters = max(1, lower + upper + wide)
    sizes = list(map(len, words))
    edges = sum(w[-1] in b"#$%&*|@~^=+<>{}[]\\/_!" for w in words)
    return [
        math.log1p(n), math.log1p(len(words)), sum(sizes) / k, math.log1p(max(sizes, default=0)), upper / letters, digit / chars, stop / chars, shout / chars, symbol / chars, pipe / chars,
        wide / chars, (space + line) / chars, len(distinct) / k, sum(s <= 3 for s in sizes) / k, math.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), math.log1p(k / (1 + raw.count(b"."))), edges / k,
    ]


@dataclass
class Gam:
    """Bin edges and a table for each feature, tables for pairs over coarser edges, and a constant."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, f], "right")]
        bins = {f: np.searchsorted(self.coarse[f], x[:, f], "right") for pair in self.pairs for f in pair}
        for (f, g), t in self.pairs.items():
            out += t[bins[f], bins[g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[int, float]:
    """Best place to cut bins in two by gradient and curvature sums, and its gain."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(np.argmax(gain)) if len(gain) else 0
    return at + 1, float(gain[at]) if len(gain) else 0.0


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A tree over the bins of one feature, as the step in each bin."""
    if depth and len(g) > 1:
        at, gain = _cut(g, h, ridge)
        if gain > 1e-9:
            return np.concatenate([_tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)])
    return np.full(len(g), -g.sum() / (h.sum() + ridge))


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A tree over the cells of a pair: one cut on an axis, then one on the other for each side; its gain."""
    best, best_gain = np.zeros_like(g), 0.0
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for at in range(1, len(a)):
            step, gain = np.zeros_like(a), 0.0
            for part in (slice(0, at), slice(at, None)):
                gs, hs = a[part].sum(0), b[part].sum(0)
                cut, more = _cut(gs, hs, ridge)
                gain += more + gs.sum() ** 2 / (hs.sum() + ridge)
                step[part, :cut], step[part, cut:] = -gs[:cut].sum() / (hs[:cut].sum() + ridge), -gs[cut:].sum() / (hs[cut:].sum() + ridge)
            if gain > best_gain:
                best, best_gain = (step if axis == 0 else step.T), gain
    return best, best_gain


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 8, rounds: int = 150, rate: float = 0.1, depth: int = 2, n_pairs: int = 8, pair_rounds: int = 40, ridge: float = 2.0) -> Gam:
    """Rows of features and labels 0 or 1 -> model. Without rows of both labels, a constant."""
    k = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return Gam([np.empty(0)] * k, [np.zeros(1)] * k, [np.empty(0)] * k, {}, base)
    at = lambda n: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1])) for f in range(k)]
    edges, coarse = at(bins), at(coarse_bins)
    where = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), base)
    for _ in range(rounds):
        for f in range(k):
            p = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(where[f], p - y, len(tables[f])), np.bincount(where[f], p * (1 - p), len(tables[f])), depth, ridge)
            tables[f] += step
            z += step[where[f]]
    rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def sums(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        cell = rough[f] * shape[1] + rough[g]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (p - y, p * (1 - p)))

    gains = sorted(((_tree2(*sums(f, g), ridge)[1], f, g) for f in range(k) for g in range(f + 1, k)), reverse=True)
    pairs = {(f, g): np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1)) for gain, f, g in gains[:n_pairs] if gain > 0}
    for _ in range(pair_rounds):
        for f, g in pairs:
            step = rate * _tree2(*sums(f, g), ridge)[0]
            pairs[f, g] += step
            z += step[rough[f], rough[g]]
    return Gam(edges, tables, coarse, pairs, base)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id") -> Gam:
    """Learn from at most ``max_rows`` labelled ids, those of least hash; the model's size is fixed.

    Null ids or labels are left out. Of several labels of one id the least counts, and of several texts that of the
    least features, so an id gives one row, however often it is repeated.
    """
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = least_hashed(known, "doc_id", max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 0, 1024):
                rows = [features(t.as_py()) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), part.column(1), part.column(2)], names=["x", "y", "doc_id"])

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # max_rows ids at most
    rows = found.select("text", F.col("y").cast("double").alias("y"), F.col("doc_id").cast("string").alias("doc_id")).mapInArrow(run, "x array<double>, y double, doc_id string")
    rows = rows.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).toPandas()  # max_rows rows at most
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit_gam(x, rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Gam, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score, predicted`` for every row, and the columns of ``keep`` as they are.

    Null and empty texts are scored as empty ones, very long ones whole. Null or repeated doc_id, repeated rows: every
    row stays; equal texts have equal scores. Empty table: no rows. Other columns are not read. A kept column that is
    called as a result comes out with ``_kept`` behind its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken, at, kept = handed(docs, id_col, text_col, keep, ("doc_id", "score", "predicted"))
    schema = T.StructType([taken.schema[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *kept])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, at, 1024):
                s = shared.value.score(np.array([features(t.as_py()) for t in part.column(at)]))
                told = [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), *told, *part.columns[1 : 1 + len(kept)]], names=names)
            pa.default_memory_pool().release_unused()

    return taken.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
