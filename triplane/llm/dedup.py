"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a circle of places make every coordinate of a signature: the first sends a shingle to its place,
the second, shifted by k, gives the k-th coordinate, which is the least value over a document's places. So the values
of one shingle for all coordinates stand side by side in the second permutation.

1. Documents with equal sets of shingles are one node, held by their smallest doc_id.
2. Nodes that agree in all coordinates of a band share a bucket. Buckets over ``chunk`` nodes are cut into chunks, and
   each pair of chunks is a group of its own, so a group has at most 2 x ``chunk`` nodes.
3. A group compares signatures and emits a spanning forest of its likely pairs only, most alike first. These pairs are
   confirmed on the full sets, and their components taken.
4. Likely pairs of different components are all that is left to decide. Buckets that hold such pairs get the full sets,
   and their groups confirm pairs, most alike first, until no two components are left that a likely pair could join.
   A pair inside a component needs no test, as it cannot change the components.

A pair is likely if its signatures agree in enough of their coordinates. Bands and that bar follow from the least
similarity: over independent coordinates, a pair at just that similarity falls short of either once in ten million,
and sooner the less similar it is. ``exact`` closes that gap: a last sweep finds all that MinHash missed by the rarest
shingles of each set, of which two sets alike enough share one, and confirms it on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.llm.common import connected_components, discard, materialise, parts

WORDS = 5
PLACES = 1 << 20
#: The chance allowed for a pair at the least similarity to share no band, and to fall short of the likely ones.
MISS = 1e-7
#: Most rows of a band, and most coordinates of a signature.
ROWS, COORDINATES = 6, 216
CHUNK = 256
SALTS = 16


@lru_cache
def banding(percent: int) -> tuple[int, int, float]:
    """(bands, rows, likely) for pairs of ``percent`` or more, 50 to 100.

    As many rows a band as leave the coordinates in bounds, with the bands that ``MISS`` asks for; likely is half a
    coordinate under the most agreements that a pair misses with that chance.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"similarities from 50 to 100 percent, not {percent}")
    if percent == 100:
        return 1, ROWS, 1.0
    share = percent / 100
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-(share**rows)))
        if bands * rows <= COORDINATES:
            break
    n, least, under = bands * rows, 0, 0.0
    while (under := under + math.comb(n, least) * share**least * (1 - share) ** (n - least)) <= MISS:
        least += 1
    return bands, rows, (least - 0.5) / n


class _Hashes(dict):
    """64-bit hashes of words; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words, A-Z lower-cased; fewer words make one run."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(_mix(total))


@lru_cache(maxsize=1)
def _circle(places: int, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    first, second = (rng.permutation(np.arange(places, dtype=np.uint32)) for _ in range(2))
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: coordinates - 1]]), coordinates)
    return first, windows


def signature(found: np.ndarray, coordinates: int, places: int = PLACES) -> np.ndarray:
    """All coordinates of the circulant MinHash of a set of shingles."""
    first, windows = _circle(places, coordinates)
    at = first[(found >> np.uint64(20)).astype(np.int64) % places]
    out = np.full(coordinates, places, np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(out, windows[at[i : i + 2048]].min(0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(bands, rows)[:, i])
    return key.view(np.int64)


def _signed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, 2048):
                n, h1, h2, sigs, keys = [], [], [], [], []
                for text in part.column(1):
                    found = shingles(text.as_py())
                    n.append(len(found))
                    raw = found.tobytes()
                    h1.append(xxhash.xxh64_intdigest(raw, 1) - (1 << 63))
                    h2.append(xxhash.xxh64_intdigest(raw, 2) - (1 << 63))
                    sig = signature(found, bands * rows) if len(found) else None
                    sigs.append(None if sig is None else sig.astype(np.uint8).tobytes())
                    keys.append(None if sig is None else band_keys(sig, bands, rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "h1", "h2", "sig", "bands"],
                )
            pa.default_memory_pool().release_unused()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, 1, 512):
            found = [shingles(t.as_py()).view(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])
        pa.default_memory_pool().release_unused()


def _forest(alike: np.ndarray, likely: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that are likely, most alike first (Prim)."""
    m = len(alike)
    todo, best, by = np.ones(m, bool), np.zeros(m, np.float32), np.full(m, -1)
    out = []
    for _ in range(m):
        i = int(np.argmax(np.where(todo, best, -1)))
        if best[i] >= likely:
            out.append((int(by[i]), i))
        todo[i] = False
        nearer = alike[i] > best
        best[nearer], by[nearer] = alike[i][nearer], i
    return out


def _alike(n: np.ndarray, sig: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Share of equal coordinates for each pair of a group; 0 where the sizes alone rule it out or the sides are one."""
    m = len(n)
    alike = np.empty((m, m), np.float32)
    for i in range(m):
        alike[i] = (sig == sig[i]).mean(1, dtype=np.float32)
    alike[100 * np.minimum(n[:, None], n) < percent * np.maximum(n[:, None], n)] = 0
    if side.any():
        alike[side[:, None] == side] = 0
    np.fill_diagonal(alike, 0)
    return alike


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Batches of rows sorted by their first two columns -> tables of whole groups.

    A group has at most 2 x CHUNK rows, so what is kept between batches is bounded.
    """
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = []
        for c in batch.columns[2:]:
            if pa.types.is_binary(c.type):
                c = np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            elif pa.types.is_list(c.type):
                flat, ends = np.asarray(c.flatten()), np.asarray(c.offsets)
                ends = ends - ends[0]
                c = np.empty(batch.num_rows, object)
                c[:] = [flat[x:y] for x, y in zip(ends[:-1], ends[1:])]
            cols.append(np.asarray(c))
        cols = [np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], 1), *cols]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        group = cols[0]
        last = len(group) - int(np.argmax(np.any(group[::-1] != group[-1], axis=1))) if np.any(group != group[-1]) else 0
        rest = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols]
    if rest is not None:
        yield rest


def _bounds(group: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1, [len(group)]])


def _forests(percent: int, likely: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups -> the pairs of a spanning forest of what is likely in each."""
        seen: set[tuple[int, int]] = set()
        for group, node, n, side, sig in _whole_groups(batches):
            bounds = _bounds(group)
            start, size = bounds[:-1], np.diff(bounds)
            two = start[size == 2]
            ok = ((sig[two] == sig[two + 1]).mean(1) >= likely) & (100 * np.minimum(n[two], n[two + 1]) >= percent * np.maximum(n[two], n[two + 1]))
            ok &= (side[two] == 0) | (side[two] != side[two + 1])
            out = [np.sort(np.stack([node[two[ok]], node[two[ok] + 1]], 1), axis=1)]
            for s, k in zip(start[size > 2], size[size > 2]):
                at = slice(s, s + k)
                found = np.array(_forest(_alike(n[at], sig[at], side[at], percent), likely), np.int64).reshape(-1, 2)
                out.append(np.sort(node[at][found], axis=1))
            fresh = [p for p in dict.fromkeys(map(tuple, np.concatenate(out).tolist())) if p not in seen]
            if len(seen) < 50_000:  # repeats of other bands go early; distinct() takes the others
                seen.update(fresh)
            fresh = np.array(fresh, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(fresh[:, 0]), pa.array(fresh[:, 1])], names=["a", "b"])

    return run


def _joined(pairs: Iterable[tuple[int, int]], comp: np.ndarray, sets: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of components, confirmed on the sets; a pair is tested only while its components are apart."""
    root, out = {x: x for x in comp.tolist()}, []
    for i, j in pairs:
        a, b = int(comp[i]), int(comp[j])
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a == b:
            continue
        x, y = sets[i].view(np.uint64), sets[j].view(np.uint64)
        at = np.searchsorted(x, y)
        both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
        if 100 * both >= percent * (len(x) + len(y) - both):
            root[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def _joins(percent: int, likely: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups with their components and full sets -> links that join components, confirmed; most alike first.

        A pair is tested in the first band that it shares.
        """
        for group, node, n, side, sig, comp, bands, sets in _whole_groups(batches):
            bounds, found = _bounds(group), []
            for s, e in zip(bounds[:-1], bounds[1:]):
                c = comp[s:e]
                if (c == c[0]).all():
                    continue
                alike = _alike(n[s:e], sig[s:e], side[s:e], percent)
                alike[c[:, None] == c] = 0
                keys = np.stack(bands[s:e])
                here = np.argmax(keys[0] == group[s, 0])
                tests = []
                for i in range(e - s):
                    js = np.flatnonzero(alike[i, i + 1 :] >= likely) + i + 1
                    if len(js):
                        js = js[np.argmax(keys[js] == keys[i], axis=1) == here]
                        tests += [(-alike[i, j], i, j) for j in js]
                found += _joined(((i, j) for _, i, j in sorted(tests)), c, sets[s:e], percent)
            out = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return run


def _exact_joins(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups with their components and full sets -> links that join components, of all pairs whose sizes allow one."""
        for group, _, n, side, _, comp, sets in _whole_groups(batches):
            bounds, found = _bounds(group), []
            for s, e in zip(bounds[:-1], bounds[1:]):
                c, k, of = comp[s:e], n[s:e], side[s:e]
                if (c != c[0]).any():
                    able = (100 * np.minimum(k[:, None], k) >= percent * np.maximum(k[:, None], k)) & (c[:, None] != c) & ((of == 0) | (of[:, None] != of))
                    found += _joined(zip(*np.nonzero(np.triu(able))), c, sets[s:e], percent)
            out = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return run


def _grouped(buckets: DataFrame, chunk: int, *more: str) -> DataFrame:
    """``key, node, size, n, sig`` and ``more`` -> a row for each group that a node is in, group by group."""
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(7)), chunks).cast("int")
    other = F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")
    dealt = buckets.select("key", "node", "n", "sig", *more, chunks.alias("chunks"), mine.alias("mine"), other)
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    # side 0: pairs within the chunk count; else only those of a 1 and a 2 do
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    groups = dealt.select("key", (low * F.col("chunks") + high).cast("long").alias("pair"), "node", "n", side.cast("long").alias("side"), "sig", *more)
    return groups.repartition("key", "pair").sortWithinPartitions("key", "pair", "node")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    counted = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("either"))
    return counted.where(F.lit(100) * F.col("both") >= F.lit(percent) * F.col("either")).select("a", "b")


def _missed(sets: DataFrame, comps: DataFrame, percent: int, chunk: int) -> DataFrame:
    """``node, n, shingles`` of all nodes and their components -> the links between components that there still are.

    Shingles are ordered by how many sets hold them, the rarest first. Two sets of the similarity asked for share one
    of the first n - ceil(n * percent / 100) + 1 of either, so sets that share such a shingle are all that need a test,
    and only where it is shared across components.
    """
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    tokens = sets.select("node", "n", salt, F.explode("shingles").alias("key"))
    often = tokens.groupBy("key").agg(F.count("*").alias("often")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ordered = tokens.join(often, ["key", "salt"]).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("order"))
    prefix = ordered.select("node", "n", F.explode(F.slice("order", F.lit(1), first.cast("int"))).alias("t")).select("node", "n", "t.key").distinct()
    prefix = materialise(prefix.join(comps, "node"), "prefixes")
    shared = prefix.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key", "size")
    rest = prefix.join(shared, "key").join(sets, ["node", "n"]).withColumn("sig", F.lit(b"\0"))
    found = materialise(_grouped(rest, chunk, "comp", "shingles").mapInArrow(_exact_joins(percent), "a long, b long").distinct(), "links")
    discard(prefix)
    return found


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, exact: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    ``component_id``: the smallest doc_id reachable over links of similarity ``percent`` / 100 or more (50 to 100), its
    own included; ``kept``: it is its own. Null and empty texts and those without a word have no shingles and no
    links. Very long texts count whole. Rows that repeat a doc_id are one document with several texts. A null doc_id
    links with nothing: component_id null, kept. Ties do not matter, as components have but one smallest id. Empty
    table: no rows. Other columns are not read, whatever they are called. Ids are integers. ``exact``: also find the
    links that signatures miss (see above), which moves every shingle two times. The result is a written table.
    """
    n_bands, n_rows, bar = banding(percent)
    texts_of = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = materialise(texts_of.mapInArrow(_signed(n_bands, n_rows), "doc_id long, n long, h1 long, h2 long, sig binary, bands array<long>"), "signatures")
    real = rows.where("n > 0 AND doc_id IS NOT NULL")
    same = ["h1", "h2", "n"]
    held = materialise(real.groupBy(*same).agg(F.min("doc_id").alias("node")), "nodes")
    member = materialise(real.select("doc_id", *same).join(held, same).select("doc_id", *same, "node"), "members")
    # a doc_id with several texts joins their nodes
    texts = member.select("doc_id", "node").distinct()
    several = texts.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("k")).where("k > 1")
    own = texts.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    # the same node may stand for several sets of one doc_id, so bands keep their own n and signature
    nodes = materialise(real.join(held.withColumnRenamed("node", "doc_id"), [*same, "doc_id"], "left_semi").dropDuplicates([*same, "doc_id"]).select(F.col("doc_id").alias("node"), "n", "sig", "bands"), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    full = materialise(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    # joins of what grows with the input are merges at every size, so that small runs plan as large ones do
    buckets = materialise(keys.join(full.hint("merge"), "key"), "buckets")
    signed = nodes.select("node", "n", "sig").hint("merge")
    first = materialise(_grouped(buckets.join(signed, "node"), chunk).mapInArrow(_forests(percent, bar), "a long, b long").distinct(), "pairs")
    likely = materialise(first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct(), "nodes")
    wanted = texts_of.join(likely.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    sets = materialise(wanted.mapInArrow(_sets, "node long, shingles array<long>"), "sets")
    confirmed = links = materialise(_confirmed(first, sets, percent).unionByName(own), "links")
    part = connected_components(links)
    placed = materialise(likely.join(part, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), "components")
    # buckets of two had their only pair tested; those of one component have nothing to join
    open_ = materialise(buckets.where("size > 2").join(placed.hint("merge"), "node"), "buckets")
    apart = materialise(open_.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key"), "buckets")
    rest = open_.join(apart.hint("merge"), "key").join(nodes.hint("merge"), "node")
    rest = rest.join(sets.withColumn("n", F.size("shingles").cast("long")).hint("merge"), ["node", "n"])
    second = _grouped(rest, chunk, "comp", "bands", "shingles").mapInArrow(_joins(percent, bar), "a long, b long").distinct()
    joined = materialise(second, "links")
    links = joined.unionByName(links)
    whole = connected_components(links)
    if exact:
        wanted = texts_of.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
        every = materialise(wanted.mapInArrow(_sets, "node long, shingles array<long>").withColumn("n", F.size("shingles").cast("long")).where("n > 0").distinct(), "sets")
        comps = materialise(every.select("node").distinct().join(whole, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), "components")
        more = _missed(every, comps, percent, chunk)
        discard(whole)
        whole = connected_components(links.unionByName(more))
        discard(every, comps, more)
    linked = member.join(whole, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    alone = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    found = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    found = materialise(found, "near-duplicates")
    discard(rows, held, member, nodes, full, buckets, first, likely, sets, confirmed, part, placed, open_, apart, joined, whole)
    return found


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Shingles as texts, every pair of sets that share one, and all that is reachable: what MinHash finds, by plain SQL.
ORACLE = r"""
WITH RECURSIVE told AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), words AS (
  SELECT doc_id, len(w) AS many, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM told
), runs AS (
  SELECT doc_id, many, i, concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) AS g
  FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), found AS (
  SELECT DISTINCT doc_id, g FROM runs WHERE i = 1 OR i <= many - 4
), sizes AS (
  SELECT doc_id, count(g) AS n FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM found x JOIN found y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)
), reach AS (
  SELECT doc_id, doc_id AS node FROM sizes
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.node
)
SELECT doc_id, any_value(n) AS n_shingles, min(node) AS component_id, doc_id = min(node) AS kept
FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""
