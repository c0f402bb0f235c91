"""Byte-level BPE encoding and decoding by ranks, with a hierarchical-bitmap rank queue.

Bytes of a pre-token form a linked list. Each adjacent pair that the ranks know waits in the bucket of its rank, by
position. A bitmap in two levels says which buckets hold something: find-first-set on the summary gives the word, and
on the word the rank, so the next merge is found in constant time however long the pre-token is. Entries whose pair
has changed since stay in their bucket and are skipped when met.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.llm.common import parts

#: Pre-tokens kept with their ids in each Python worker; the table starts anew when it is full.
REMEMBERED = 700_000
#: The worker's coder, for the tasks of one call that it runs one after another.
_CODER: dict[str, Encoder] = {}
#: Below U+0250, these characters alone belong to other classes in `re` than in Unicode's own properties.
_UNLIKE = re.compile("[\x1c-\x1f²³¹¼½¾]|[^\x00-ɏ]")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(pieces: list[bytes], ranks: dict[bytes, int], two: np.ndarray | None = None) -> list[tuple[int, ...]]:
    """Ids of each pre-token: always the pair of least rank merges, the leftmost of equals.

    The pre-tokens stand one after another in one linked list and share the queue; no pair spans two of them, so their
    order among each other does not matter. A merge cannot fill the bucket it came from, as what it makes is longer.
    ``two``: the rank of each pair of bytes or -1, if the caller has it.
    """
    text = b"".join(pieces)
    n = len(text)
    if not n:
        return [()] * len(pieces)
    ends = np.cumsum([len(p) for p in pieces])
    raw = np.frombuffer(text, np.uint8).astype(np.int64)
    two = np.array([ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]) if two is None else two
    first = np.full(n, -1, np.int64)
    first[:-1] = two[raw[:-1] << 8 | raw[1:]]
    first[ends[ends > 0] - 1] = -1
    starts = bytearray(n + 1)  # where a pre-token begins; the end of the text counts as one
    for e in (0, *ends.tolist()):
        starts[e] = 1
    pair = first.tolist()
    part = [ranks[bytes((b,))] for b in range(256)]
    part = [part[b] for b in text]  # id of the part that begins here
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    summary = 0
    order = np.argsort(first, kind="stable")
    order = order[first[order] >= 0]
    found, begin = np.unique(first[order], return_index=True)
    for r, at in zip(found.tolist(), np.split(order, begin[1:])):
        buckets[r] = at.tolist()
        words[r >> 8] = words.get(r >> 8, 0) | 1 << (r & 255)
        summary |= 1 << (r >> 8)
    sorted_rest: dict[int, list[int]] = {}
    get = ranks.get
    while summary:
        w = (summary & -summary).bit_length() - 1
        word = words[w]
        r = w << 8 | (word & -word).bit_length() - 1
        bucket = sorted_rest.pop(r, None)
        if bucket is None:
            bucket = buckets.pop(r)
            bucket.sort(reverse=True)
        elif r in buckets:
            bucket += buckets.pop(r)
            bucket.sort(reverse=True)
        lower = False
        while bucket:
            i = bucket.pop()
            if pair[i] != r:
                continue  # stale
            j = after[i]
            end = after[j]
            after[i] = end
            part[i] = r
            pair[j] = -1
            before[end] = i
            if starts[end]:
                pair[i] = -1
            else:
                pair[i] = new = get(text[i : after[end]], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        v = new >> 8
                        words[v] = words.get(v, 0) | 1 << (new & 255)
                        summary |= 1 << v
                    lower = new < r
            if not starts[i]:
                h = before[i]
                pair[h] = new = get(text[h:end], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(h)
                    else:
                        buckets[new] = [h]
                        v = new >> 8
                        words[v] = words.get(v, 0) | 1 << (new & 255)
                        summary |= 1 << v
                    if new < r:
                        lower = True
            if lower:
                break
        if bucket:
            sorted_rest[r] = bucket
        elif r not in buckets:
            words[w] = word = words[w] & ~(1 << (r & 255))
            if not word:
                summary &= ~(1 << w)
    out, i = [], 0
    for e in ends.tolist():
        ids = []
        while i < e:
            ids.append(part[i])
            i = after[i]
        out.append(tuple(ids))
    return out


class Encoder:
    """Texts to ids and back. ``quick``: the same pattern for the standard ``re``, used where both agree."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, quick: str | None = None):
        self.ranks, self.full = ranks, regex.compile(pattern)
        self.quick = re.compile(quick) if quick else None
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.two = np.full(1 << 16, -1, np.int64)
        for t, r in ranks.items():
            if len(t) == 2:
                self.two[t[0] << 8 | t[1]] = r
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [(self.full if self.quick is None or _UNLIKE.search(t) else self.quick).findall(t) for t in texts]
        known = self.known
        missing = set().union(*split).difference(known)
        if missing:
            if len(known) + len(missing) > REMEMBERED:
                known.clear()
                missing = set().union(*split)
            raw = {p: p.encode("utf-8", "surrogatepass") for p in missing}
            whole = {p: (self.ranks[b],) for p, b in raw.items() if b in self.ranks}
            known.update(whole)
            rest = [p for p in raw if p not in whole]
            known.update(zip(rest, merge([raw[p] for p in rest], self.ranks, self.two)))
        return [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, pattern: str, quick: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` for every row, and with ``decoded`` the bytes that the ids decode to.

    Null and empty texts: no ids. Null or repeated doc_id: every row stays. Whole texts, however long. Empty table: no
    rows. Other columns are not read, whatever they are called; ties do not arise. Each match of ``pattern`` is encoded separately; what it does not match is left
    out, as findall does. The rank file is read by the driver and broadcast: its size does not depend on the data.
    """
    spark = docs.sparkSession
    shared, call = spark.sparkContext.broadcast(read_ranks(ranks_path)), uuid.uuid4().hex
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>" + ", decoded binary" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if call not in _CODER:
            _CODER.clear()
            _CODER[call] = Encoder(shared.value, pattern, quick)
        coder = _CODER[call]
        for batch in batches:
            for part in parts(batch, 1, 512, 1 << 20):  # the linked list takes some hundred bytes for one of text
                ids = coder.encode([t or "" for t in part.column(1).to_pylist()])
                back = [coder.decode(x) for x in ids] if decoded else []
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])))
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)] + [pa.array(back, pa.binary())] * decoded
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, decoded``: the bytes of each row's ``ids``; null ids give null."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value, "")
        for batch in batches:
            back = [None if ids.as_py() is None else coder.decode(ids.as_py()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], names=["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, schema)


#: public_tokenizers.PATTERN for `re`, where \w takes the place of letters and digits.
QUICK = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+"""


def query(spark, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, QUICK, decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
