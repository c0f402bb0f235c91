"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary n-gram classifier is learnt, which says whether a text
belongs to the languages that have the bit set: the log-odds of hashed byte n-grams under the two sides. Decoding adds
up, for each codeword, the logistic loss of its bits given the classifiers' margins; the least loss wins, and a small
lead over the runner-up flags the text as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplane.llm.common import handed, held_out, least_hashed, parts

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
UNKNOWN = "und"
#: N-grams of a text overlap and repeat each other's evidence; a margin is their summed log-odds times this, and an n-gram beyond so many counts less.
DAMPING, ENOUGH = 0.25, 400
_LETTER = regex.compile(r"\p{L}")


def ngrams(text: str) -> np.ndarray:
    """Buckets of the byte n-grams of the lower-cased text, white space as one space."""
    raw = np.frombuffer(b" " + " ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    out, code = [], np.zeros(len(raw), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(raw):
            break
        code = code[: len(raw) - n + 1] * np.uint32(257) + raw[n - 1 :] + np.uint32(1)
        if n in ORDERS:
            mixed = (code + np.uint32(n)) * np.uint32(2654435761)
            out.append(mixed >> np.uint32(17))
    return np.concatenate(out)


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """A row of +1 and -1 for each of n classes: all distinct splits for up to six, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        return np.array([[1 if b else -1 for b in (1, *bits)] for bits in itertools.product((0, 1), repeat=n - 1) if not all(bits)]).T.astype(float)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    far = lambda m: (m.shape[1] - (m @ m.T - 2 * m.shape[1] * np.eye(n)).max()) / 2
    return max((rng.choice([-1.0, 1.0], (n, bits)) for _ in range(200)), key=far)


@dataclass
class Codes:
    """Languages in order, their codewords, and for each bucket the log-odds of every bit."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        grams = ngrams(text)
        total = np.zeros(self.weights.shape[1])
        for at in range(0, len(grams), 1 << 18):
            total += self.weights[grams[at : at + (1 << 18)]].sum(0, dtype=np.float64)
        n = len(grams)
        return DAMPING * total / max(1.0, (n / ENOUGH) ** 0.5)

    def decode(self, margins: np.ndarray) -> tuple[str, float, float]:
        """(language, score, lead): score is the softmax of the codewords' negative losses, lead its gap to the next."""
        if not self.langs:
            return UNKNOWN, 0.0, 0.0
        loss = np.logaddexp(0, -self.code * margins).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.langs[order[0]], float(p[order[0]]), float(p[order[0]] - (p[order[1]] if len(p) > 1 else 0))


def fit(docs: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Codes:
    """Learn from at most ``max_rows`` rows with a language and a text, those of least hash of the id.

    N-grams are counted by the executors; languages x buckets counts, whose number is fixed, reach the driver.
    """
    known = docs.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc_id"))
    chosen = least_hashed(known, "doc_id", max_rows).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (t := text.as_py()) and _LETTER.search(t):
                    counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    counts[lang] += np.bincount(ngrams(t), minlength=BUCKETS)
        for lang, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(c[some])], names=["lang", "bucket", "n"])

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang IS NOT NULL")
    found = texts.join(F.broadcast(chosen), "doc_id")  # max_rows ids at most
    counted = found.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counted["lang"]))
    counts = np.zeros((len(langs), BUCKETS))
    counts[counted["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), counted["bucket"].to_numpy(int)] = counted["n"]
    shares = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)  # every language weighs alike on its side
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]) if len(langs) > 1 else ():
        weights[:, b] = np.log(shares[code[:, b] > 0].mean(0)) - np.log(shares[code[:, b] < 0].mean(0))
    return Codes(langs, code, weights)


def predict(docs: DataFrame, model: Codes, lead: float = 0.2, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row, and the columns of ``keep`` as they are.

    Null texts and those without a letter: ``und``, score 0, ambiguous. So are all when nothing was learnt. Beyond
    ``ENOUGH`` n-grams a text's evidence counts by the root of its length, so that very long texts are not certain by
    length alone; all of it is read. Ties of languages: the first by name. Null or repeated doc_id, repeated rows:
    every row stays. Empty table: no rows. Other columns are not read. A kept column that is called as a result comes
    out with ``_kept`` behind its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken, at, kept = handed(docs, id_col, text_col, keep, ("doc_id", "lang_pred", "score", "ambiguous"))
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    schema = T.StructType([taken.schema[0], *made, *kept])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for batch in batches:
            for part in parts(batch, at, 1024):
                found = []
                for text in part.column(at):
                    t = text.as_py()
                    found.append(codes.decode(codes.margins(t)) if t and _LETTER.search(t) else (UNKNOWN, 0.0, 0.0))
                pred, score, gap = zip(*found)
                told = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([g < lead for g in gap], pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *told, *part.columns[1 : 1 + len(kept)]], names=names)
            pa.default_memory_pool().release_unused()

    return taken.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
