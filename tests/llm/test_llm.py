"""The training-data operators against brute force, round trips, held-out accuracy and odd rows."""

import hashlib
import heapq
import itertools
import math
import random
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "zeta", "iota"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def out_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


#: Null id, null and empty text, white space, ties, a repeated row, a very long text.
ODD = [(None, "no id here at all"), (1, None), (2, ""), (3, " \t\n"), (4, "same text"), (5, "same text"), (5, "same text"), (6, "x"), (7, "word " * 30_000), (8, "é😀\x1c²")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with further columns, named as those that operators make."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for name in ("shard", "slot", "n", "node", "component_id", "kept", "score", "predicted", "lang_pred", "h", "size", "length", "ids", "sig"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# --- chat ---


def test_chat_round_trip(spark):
    from triplane.llm import chat

    hard = ["", "plain", "</turn>", "### ", "### a: b</turn>\n### c: d</turn>", "\\", "\\\\", "\\</turn>", "<\\/turn>", "a\n### x", "ends with <", "</tur", ": ", "x\\", "😀</turn>"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for r in ("user", "assistant", "odd: role", ":", "") for t in hard)]
    rows += [(2, None, None, None), (None, 1, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    done = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    assert all(r["exact"] for r in done.values()) and set(done) == {1, 2, 3, None}
    assert [(t["role"], t["text"]) for t in done[1]["turns"]] == [(r, t) for _, _, r, t in rows if _ is not None][: len(hard) * 5]
    assert [t["text"] for t in done[3]["turns"]] == ["a", "a", "b"]
    one = done[1]
    said = [one["formatted"][s["start"] : s["start"] + s["length"]] for s in one["loss_spans"]]
    assert len(said) == len(hard) and said[1] == "plain"
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_has_no_python(spark):
    from triplane.llm import chat
    from triplane.plans import explain

    assert "Python" not in explain(chat.query(spark, FOLDER)) and "Arrow" not in explain(chat.query(spark, FOLDER))


# --- near-duplicates ---


def brute_components(docs):
    sets, root = {}, {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10_000))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("chunk, exact", [(256, False), (16, False), (16, True)])
def test_dedup_against_brute_force(spark, chunk, exact, monkeypatch):
    from triplane.llm import dedup

    if exact:  # signatures that miss most links: the last sweep has to find them
        monkeypatch.setattr(dedup, "banding", lambda percent: (1, 6, 1.0))
    rng = random.Random(3)
    texts = [text(rng, rng.randrange(1, 60)) for _ in range(40)] + ["", None, "Short One", "short  one"]
    for edits, n in ((5, 60), (9, 40)):
        texts += near_copies(rng, text(rng, 150), n, edits)
    texts += ["exact copy of a text with words"] * 20
    order = list(range(1000, 1000 + len(texts)))
    rng.shuffle(order)
    docs = list(zip(order, texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in dedup.near_duplicates(df, chunk=chunk, exact=exact).collect()}
    want = brute_components(docs)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_dedup_query_against_sql(spark):
    import duckdb

    from triplane.llm import dedup

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{FOLDER}/documents.parquet'")
    want = con.execute(dedup.ORACLE).fetchall()
    got = out_of(dedup.query(spark, FOLDER), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got) == sorted(want) and any(not kept for *_, kept in got)


def test_dedup_of_odd_rows(odd, none):
    from triplane.llm import dedup

    got = Counter(out_of(dedup.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept"))
    assert got[(5, 1, 4, False)] == 2 and got[(4, 1, 4, True)] == 1 and got[(None, 1, None, True)] == 1
    assert got[(7, 1, 7, True)] == 1 and got[(1, 0, 1, True)] == 1 and sum(got.values()) == len(ODD)
    assert dedup.near_duplicates(none).count() == 0


def test_bands_follow_from_the_similarity():
    from triplane.llm import dedup

    for percent in (50, 63, 80, 85, 99):
        bands, rows, likely = dedup.banding(percent)
        share = percent / 100
        assert (1 - share**rows) ** bands <= dedup.MISS and bands * rows <= dedup.COORDINATES
        n = bands * rows
        short = sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(n + 1) if k / n < likely)
        assert short <= dedup.MISS
    for percent in (49, 101):
        with pytest.raises(ValueError):
            dedup.banding(percent)


def test_components(spark):
    from triplane.llm.common import connected_components

    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(k, k + 1) for k in range(200, 230)] + [(300, 300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(out_of(connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# --- packing ---


def test_packing(spark, odd, none):
    from triplane.llm import packing

    rng = random.Random(2)
    docs = [(k, rng.choice((0, 3, 700, 1024, 5000, 16_384, 40_000))) for k in range(400)] + [(None, 10), (None, 10), (3, 3), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, n long").withColumn("bin_id", F.lit("clash"))
    got = packing.pack(df, F.col("n"), group_rows=150).collect()
    assert sum(r["length"] for r in got) == sum(n or 0 for _, n in docs)
    pieces, bins = Counter(r["doc_id"] for r in got), defaultdict(list)
    assert pieces[None] == 2 and set(pieces) == {d for d, _ in docs}
    for r in got:
        bins[r["bin_id"]].append(r)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: (r["bin_offset"], r["length"])):
            assert r["bin_offset"] == at
            at += r["length"]
        capacity = rows[0]["bin_capacity"]
        assert capacity == min(c for c in packing.CAPACITIES if c >= at) and len({r["bin_capacity"] for r in rows}) == 1
    assert packing.pack(odd, F.length("text")).count() == len(ODD) + 9
    assert packing.pack(none, F.length("text")).count() == 0


def test_packing_spreads_a_repeated_id(spark):
    from triplane.llm import packing

    got = packing.pack(spark.range(3000).selectExpr("5L AS doc_id", "700L AS n"), F.col("n"), group_rows=100).collect()
    groups = Counter(r["bin_id"] >> 32 for r in got)
    assert len(got) == 3000 and len(groups) > 20 and max(groups.values()) < 200


def cheapest(lengths, capacities, cost):
    """The least cost of all ways to put pieces into bins."""
    best = [math.inf]

    def place(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], sum(min(cost(c) for c in capacities if c >= b) for b in bins))
            return
        for k in [k for k, b in enumerate(bins) if b + lengths[i] <= max(capacities) and b not in bins[:k]]:
            place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_packing_is_near_the_cheapest():
    from triplane.llm.packing import pack_lengths

    rng, cost, over = random.Random(4), lambda c: 1 + c + c * c / 48, []
    for _ in range(60):
        lengths = [rng.randrange(1, 33) if rng.random() < 0.4 else rng.randrange(1, 9) for _ in range(rng.randrange(1, 8))]
        final = pack_lengths(lengths, (8, 16, 32), 1, 48)[2]
        over.append(sum(map(cost, final)) / cheapest(lengths, (8, 16, 32), cost))
    assert max(over) < 1.2 and np.mean(over) < 1.01


def test_packing_uses_lengths_jointly():
    from triplane.llm.packing import ATTENTION, CAPACITIES, OVERHEAD, pack_lengths

    rng, cost = random.Random(5), lambda c: OVERHEAD + c + c * c / ATTENTION
    lengths = [min(16_384, int(2 ** rng.uniform(4, 14.5))) for _ in range(1500)]
    bins, offsets, final = pack_lengths(lengths)
    inside = defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths):
        inside[b].append((o, n))
    for b, pieces in inside.items():
        assert all(o == sum(n for q, n in pieces if q < o) for o, _ in pieces) and final[b] == min(c for c in CAPACITIES if c >= sum(n for _, n in pieces))
    used = Counter(final)
    assert sum(used[c] * c > 0.02 * sum(final) for c in CAPACITIES) >= 4
    total = sum(map(cost, final))
    for one in CAPACITIES:  # only this length is opened, or the least that holds the piece
        alone = []
        for n in sorted(lengths, reverse=True):
            fit = [k for k, (c, u) in enumerate(alone) if c - u >= n]
            if fit:
                k = min(fit, key=lambda k: alone[k][0] - alone[k][1])
                alone[k][1] += n
            else:
                alone.append([min(c for c in CAPACITIES if c >= max(n, one)), n])
        assert total <= sum(cost(min(c for c in CAPACITIES if c >= u)) for _, u in alone) + 1e-6


# --- sharding ---


def test_shards(spark, odd, none):
    from triplane.llm import shards

    rng = random.Random(6)
    docs = [(k, text(rng, rng.randrange(60))) for k in range(600)] + [(1000 + k, "a copy") for k in range(200)] + ODD
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = shards.shard(df).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))
    together = defaultdict(set)
    for r in got:
        together[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in together.values())
    assert shards.shard(none).count() == 0
    small = shards.shard(df.where("length(text) < 400"))
    sums = [r[0] for r in small.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sums) == 8 and max(sums) - min(sums) < 0.01 * sum(sums)
    assert len({r["shard"] for r in shards.shard(odd).collect()}) > 1


def test_shards_as_a_plain_heap_deals(spark):
    from triplane.llm import shards

    rng = random.Random(12)
    texts = [text(rng, rng.randrange(12)) for _ in range(500)] + ["ab"] * 70 + ["abc"] * 40 + ["x" * k for k in range(40)] * 3 + [None] * 30
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = shards.shard(df, n_shards=3, large_groups=5).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    groups = Counter(t or "" for t in texts)
    loads, dealt = [(0, s) for s in range(3)], Counter()
    for total in sorted((n * (len(t.encode()) + 1) for t, n in groups.items()), reverse=True):
        load, s = heapq.heappop(loads)
        dealt[total, s] += 1
        heapq.heappush(loads, (load + total, s))
    where = defaultdict(set)
    for r in got:
        where[texts[r["doc_id"]] or ""].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    assert Counter((groups[t] * (len(t.encode()) + 1), *s) for t, s in where.items()) == dealt
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_shards_of_one_repeated_row(spark):
    from triplane.llm import shards

    got = shards.shard(spark.range(3000).selectExpr("5L AS doc_id", "'same' AS text").repartition(6))
    assert [r["shard"] for r in got.select("shard").distinct().collect()] == [0]
    assert sorted(r["slot"] for r in got.collect()) == list(range(3000))


def test_lpt():
    from triplane.llm.shards import lpt

    rng = random.Random(3)
    for _ in range(60):
        n, groups = rng.randrange(1, 9), [rng.randrange(1, 6) * rng.choice((1, 1, 50)) for _ in range(rng.randrange(3000))]
        loads, want, got = [(0, s) for s in range(n)], Counter(), Counter()
        for size in sorted(groups, reverse=True):
            load, s = heapq.heappop(loads)
            want[size, s] += 1
            heapq.heappush(loads, (load + size, s))
        before = 0
        for size, at, upto in lpt(list(Counter(groups).items()), n):
            assert at == before
            got.update({(size, s): b - a for s, (a, b) in enumerate(zip([0, *upto], upto)) if b > a})
            before += upto[-1]
        assert got == want


# --- top-k and nearest neighbours ---


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (904, [0.0] * 16), (None, [1.0] * 16), (905, []), (906, [1.0, 2.0]), (950, [3.0, 4.0]), (3, [float(c) for c in x[3]])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")), rows


def usable(rows, zero=True):
    return [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and (zero or np.any(np.array(v)))]


def best(rows, queries, k):
    out = {}
    for i, q in queries:
        found = sorted(((-float((q * v).sum()), j) for j, v in rows if j != i and len(v) == len(q)))
        out.setdefault(i, []).extend((r + 1, j, -s) for r, (s, j) in enumerate(found[:k]))
    return out


def test_top_k(vectors):
    from triplane.llm import topk

    df, rows = vectors
    whole = [(i, np.floor(256 * v)) for i, v in usable(rows)]
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, group_rows=100)
    found = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], float(r["score"])))
    assert dict(found) == {i: b for i, b in best(whole, [w for w in whole if w[0] % 50 == 0], 5).items() if b}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_reading_lists_stops_early():
    from triplane.llm.topk import Lists, no_random_access

    rng = np.random.default_rng(1)
    x = (rng.exponential(size=(2000, 12)) ** 3 * 20).astype(int) * (rng.random((2000, 12)) < 0.4)
    q = x[x.any(1)][:40]
    few, stopped = no_random_access(Lists(x), q, 5, np.full(40, -np.inf))  # no bar but that of the lower bounds
    for f, w in zip(few, q):
        score = x @ w
        assert set(np.flatnonzero(score >= np.sort(score)[-5])) <= set(f)
    assert (stopped < 2000).all() and stopped.mean() < 700 and max(map(len, few)) <= 125


def test_bounds_hold_at_every_depth():
    from triplane.llm.topk import Lists

    rng = np.random.default_rng(2)
    x, q = rng.integers(-99, 99, (300, 6)), rng.integers(-99, 99, (9, 6))
    lists, score, last = Lists(x), q @ x.T, None
    for depth in (1, 10, 100, 299, 300):
        lower, upper = lists.bounds(q, depth)
        assert (lower <= score).all() and (score <= upper).all()
        assert last is None or ((lower >= last[0]).all() and (upper <= last[1]).all())
        last = lower, upper
    assert (lower == upper).all()


def test_top_k_of_large_and_repeated(spark):
    from triplane.llm import topk

    rows = [(0, [1e13, 3.0]), (1, [1e13, 2.0]), (2, [-1e13, 1.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (50, [1.0, 0.0]), (3, [1e30, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 3).collect()
    most = (1 << 63) - 1
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0) == [(1, 1, most), (2, 3, most), (3, 50, 65536 * 10**13)]
    assert Counter((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 50) == Counter(
        [(1, 0, 768 * 256), (2, 1, 512 * 256), (3, 2, 65536), (1, 3, most), (2, 0, 65536 * 10**13), (3, 1, 65536 * 10**13)]
    )


def test_nearest(vectors):
    from triplane.llm import ann

    df, rows = vectors
    good = usable(rows, zero=False)
    indexed, books = ann.index(df)
    got = defaultdict(list)
    for r in ann.nearest(indexed, books, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = best(good, [w for w in good if w[0] % 20 == 0], 20)
    hits = sum(len({x[1] for x in got[i]} & {x[1] for x in b}) for i, b in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all([x[0] for x in g] == list(range(1, len(g) + 1)) and len(g) == len(want[i]) for i, g in got.items())
    by_id = dict(good)
    assert all(abs(s - float((by_id[i] * by_id[j]).sum())) < 1e-9 for i, g in got.items() for _, j, s in g)
    twins = Counter((r["rank"], r["vec_id"]) for r in ann.nearest(ann.index(df.where("vec_id IN (60, 61, 62)").unionByName(df.where("vec_id = 60")))[0], books, F.col("vec_id") == 60).collect())
    assert len(twins) == 2 and set(twins.values()) == {1}
    empty, books = ann.index(df.limit(0))
    assert ann.nearest(empty, books, F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_of_large_vectors(spark):
    from triplane.llm import ann

    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24)) * 10.0 ** rng.choice((-30, 0, 0, 0, 6, 30), 3000)[:, None]
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in ann.nearest(*ann.index(df), F.col("vec_id") % 20 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    want = best(list(enumerate(x)), [(k, x[k]) for k in range(0, 3000, 20)], 20)
    assert sum(len(found[i] & {j for _, j, _ in b}) for i, b in want.items()) > 0.98 * 20 * len(want)


def test_nearest_of_copies_and_of_what_the_codes_do_not_fit(spark):
    from triplane.llm import ann

    rng = np.random.default_rng(10)
    spots = rng.normal(size=(12, 16))
    tables = {
        "copies": spots[rng.integers(0, 12, 2400)],
        "near copies": spots[rng.integers(0, 12, 2400)] + 1e-8 * rng.normal(size=(2400, 16)),
        "long": rng.normal(size=(1200, 384)),
        "beyond single precision": rng.normal(size=(600, 8)) * 10.0 ** rng.choice((-150, 0, 150), 600)[:, None],
    }
    for name, x in tables.items():
        df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        found = defaultdict(list)
        for r in ann.nearest(*ann.index(df), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
            found[r["query_id"]].append((r["vec_id"], r["score"]))
        for i in range(0, len(x), 20):
            score = np.zeros(len(x))
            for a, b in zip(x[i], x.T):
                score += a * b
            want = [k for k in np.lexsort((np.arange(len(x)), -score)) if k != i][:20]
            assert found[i] == [(k, score[k]) for k in want], name


# --- byte-level BPE ---


def test_bpe_as_tiktoken(spark, odd, none):
    import public_tokenizers
    import tiktoken

    from triplane.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    by = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "aé²½ \n", "abc ñ漢字٣\x1c\u3000 ", "the'll 12 ", "tion") for n in (1, 7, 60, 900)] + ["ab" * 20_000]
    coder = bpe.Encoder(ranks, public_tokenizers.PATTERN, bpe.QUICK)
    assert coder.encode(texts) == [by.encode_ordinary(t) for t in texts]
    assert [coder.decode(i).decode() for i in coder.encode(texts)] == texts
    got = bpe.encode(odd, path, public_tokenizers.PATTERN, bpe.QUICK, decoded=True).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == Counter((i, tuple(by.encode_ordinary(t or "")), (t or "").encode()) for i, t in ODD)
    back = bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path)
    assert Counter(bytes(r["decoded"]) for r in back.collect()) == Counter((t or "").encode() for _, t in ODD)
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_query(spark):
    from triplane.llm import bpe

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in bpe.query(spark, FOLDER).collect():
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()


# --- classifiers ---


def test_language(spark, odd, none):
    from triplane.llm import langid

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    told = {r["doc_id"]: r for r in langid.query(spark, FOLDER).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i, r in told.items() if r["held_out"]]
    assert set(told) == set(truth) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in told.items())
    assert np.mean([told[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    model = langid.fit(docs)
    got = langid.predict(odd, model, keep=("text", "shard")).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == "und" for r in got if not (r["text"] or "").strip())
    assert langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(docs.limit(0))).collect()} == {"und"}


def clashing(df):
    """Further columns called as the results of an operator."""
    for name in ("DOC_ID_kept", "lang_pred", "Score", "ambiguous", "predicted", "page_id", "text_kept"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def test_kept_columns_that_clash(spark, odd):
    from triplane.llm import html, langid, quality

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    df = clashing(odd.select("doc_id", "text"))
    keep = tuple(df.columns)
    told = langid.predict(df, langid.fit(docs), keep=keep)
    assert told.columns == ["doc_id", "lang_pred", "score", "ambiguous", "text", "DOC_ID_kept", "lang_pred_kept", "Score_kept", "ambiguous_kept", "predicted", "page_id", "text_kept"]
    assert Counter((r["doc_id"], r["text"], r["Score_kept"]) for r in told.collect()) == Counter((i, t, "own Score") for i, t in ODD)
    scored = quality.score(df, quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")), keep=keep)
    assert Counter((r["doc_id"], r["text"], r["predicted_kept"]) for r in scored.collect()) == Counter((i, t, "own predicted") for i, t in ODD)
    pages = html.extract(df, id_col="doc_id", html_col="text", keep=keep)
    assert pages.columns[:3] == ["page_id", "text", "text_kept"] and Counter((r["page_id"], r["text_kept"]) for r in pages.collect()) == Counter(ODD)


def test_language_against_plain_python(spark):
    from triplane.llm import langid

    def grams(t):
        raw, out = b" " + " ".join(t.lower().split()).encode() + b" ", Counter()
        for n in (1, 2, 3, 4):
            for i in range(len(raw) - n + 1):
                code = 0
                for b in raw[i : i + n]:
                    code = (code * 257 + b + 1) % 2**32
                out[(code + n) * 2654435761 % 2**32 >> 17] += 1
        return out

    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()]
    letter = lambda t: any(c.isalpha() for c in t or "")
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs}
    counts = defaultdict(Counter)
    for i, t, lang in docs:
        if lang is not None and not held[i] and letter(t):
            counts[lang] += grams(t)
    langs = sorted(counts)
    shares = {x: defaultdict(lambda x=x: 0.5 / (sum(counts[x].values()) + 16_384)) for x in langs}
    for x in langs:
        for g, n in counts[x].items():
            shares[x][g] = (n + 0.5) / (sum(counts[x].values()) + 16_384)
    words = langid.codewords(len(langs))
    got = {r["doc_id"]: r for r in langid.query(spark, FOLDER).collect()}
    assert set(got) == {i for i, _, _ in docs}
    for i, t, _ in docs[:60]:
        if not letter(t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        g = grams(t)
        n = sum(g.values())
        losses = [0.0] * len(langs)
        for b in range(words.shape[1]):
            yes, no = ([x for x, w in zip(langs, words) if (w[b] > 0) == side] for side in (True, False))
            mean = lambda k, xs: sum(shares[x][k] for x in xs) / len(xs)
            margin = 0.25 * sum(c * math.log(mean(k, yes) / mean(k, no)) for k, c in g.items()) / max(1, (n / 400) ** 0.5)
            for j in range(len(langs)):
                losses[j] += math.log1p(math.exp(-abs(margin))) + max(0, -words[j][b] * margin)
        p = [math.exp(min(losses) - x) for x in losses]
        assert got[i]["lang_pred"] == langs[p.index(max(p))] and abs(got[i]["score"] - max(p) / sum(p)) < 1e-4


def test_codewords():
    from triplane.llm.langid import Codes, codewords

    for n in (1, 2, 4, 6, 12):
        m = codewords(n)
        assert len({tuple(r) for r in m}) == n
    m = codewords(12)
    codes = Codes([str(k) for k in range(12)], m, np.zeros((1, m.shape[1])))
    wrong = 5 * m[7]
    wrong[:3] *= -1  # three classifiers err
    assert codes.decode(wrong)[0] == "7" and codes.decode(np.zeros(m.shape[1]))[2] == 0


def test_quality(spark, odd, none):
    from triplane.llm import quality

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    told = {r["doc_id"]: r for r in quality.query(spark, folder).collect()}
    held = [(told[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if told[r["doc_id"]]["held_out"]]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert np.mean(pairs) > 0.95 and len(told) == docs.count()
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in told.values())
    model = quality.fit(docs, labels)
    assert quality.score(odd, model, keep=("text", "size")).count() == len(ODD)
    assert quality.score(none, model).count() == 0
    assert len({r["score"] for r in quality.score(odd, quality.fit(docs, labels.limit(0))).collect()}) == 1


def plain_features(t):
    chars = t or ""
    raw = chars.encode()
    n = max(1, len(chars))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    k, m = max(1, len(words)), max(1, len(lines))
    count = lambda some: sum(c in some for c in chars)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    stops, blanks = ".,;:'\"()-?", " \t\r\v\f\n"
    wide = sum(ord(c) > 127 for c in chars)
    other = n - count(low + up + dig + stops + "!|" + blanks) - wide if chars else 0
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / k, math.log1p(max(map(len, words), default=0)), count(up) / max(1, count(low + up) + wide), count(dig) / n, count(stops) / n, count("!") / n, other / n, count("|") / n,
        wide / n, count(blanks) / n, len(set(words)) / k, sum(len(w) < 4 for w in words) / k, math.log1p(len(raw) / m), 1 - len(set(lines)) / m, math.log1p(k / (1 + raw.count(b"."))), sum(chr(w[-1]) in "#$%&*|@~^=+<>{}[]\\/_!" for w in words) / k,
    ]


def test_quality_against_plain_python(spark):
    from triplane.llm import quality
    from triplane.llm.common import held_out

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    gam = quality.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet").where(~held_out()))
    got = {r["doc_id"]: r for r in quality.query(spark, FOLDER).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        x = plain_features(t)
        assert np.allclose(x, quality.features(t))
        z = gam.base
        for f, (edges, table) in enumerate(zip(gam.edges, gam.tables)):
            z += table[sum(e <= x[f] for e in edges)]
        for (f, g), table in gam.pairs.items():
            z += table[sum(e <= x[f] for e in gam.coarse[f]), sum(e <= x[g] for e in gam.coarse[g])]
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-z))) < 1e-6 and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_quality_takes_one_row_of_a_repeated_id(spark):
    from triplane.llm import quality

    docs = spark.range(4000).selectExpr("id % 3 AS doc_id", "CASE WHEN id < 2000 THEN 'Some words. And more of them.' ELSE '### !!! $$$' END AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    seen = []
    real = quality.fit_gam
    try:
        quality.fit_gam = lambda x, y, **k: seen.append((len(x), sorted(y))) or real(x, y, **k)
        quality.fit(docs, labels)
    finally:
        quality.fit_gam = real
    assert seen == [(2, [0.0, 1.0])]


def test_gam_learns_an_interaction():
    from triplane.llm.quality import fit_gam

    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit_gam(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


# --- pages ---

PAGES = {
    "<html><body><nav><a href=/>Home</a> <a href=/x>News</a></nav><div class=ad>Buy now!</div><article><h1>The title</h1><p><b>First  part of &amp; some text<br><p>Second\n part, and more of it.</p><script>var x = '<p>no</p>'</script></article><footer>&copy; all of us</footer>": "The title\n\nFirst part of & some text\n\nSecond part, and more of it.",
    "<HTML><BODY><DIV CLASS='header'><A HREF='/'>Site</A></DIV><MAIN><P>One paragraph of the story, quite long enough to be read by many.<P>Two.<UL><LI>a point<LI>another point</UL></MAIN><ASIDE>Related stories <a href=1>a</a> <a href=2>b</a></ASIDE><section id=comments><div class=comment><p>I do not agree with this at all, said a reader.</p></div></section>": "One paragraph of the story, quite long enough to be read by many.\n\nTwo.\n\na point\n\nanother point",
}


@pytest.mark.parametrize("source", list(PAGES))
def test_main_text(source):
    from triplane.llm import html

    assert html.main_texts([source], html.trained()) == [PAGES[source]]


def test_pages(spark):
    from triplane.llm import html

    rows = [(1, None), (2, ""), (2, ""), (None, "<p>"), (3, "<div" * 5000), (4, next(iter(PAGES))), (5, "<!-- never closed"), (6, "<p>" * 3000), (7, "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = html.extract(df).collect()
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert html.extract(df.limit(0)).count() == 0


def test_offsets_are_those_of_the_page_itself():
    from triplane.llm import html

    page = "<article><h1>İstanbul</h1>" + "İ" * 30 + "<script>x</script><p>First paragraph of the story, told at length.</p>" + "İ" * 9 + "<style>y</STYLE><p>Second paragraph, with <math><mi>x</mi> = 2</math>.</p><xmp>a <b> c</xmp></article>"
    want = "İstanbul\n\n" + "İ" * 30 + "\n\nFirst paragraph of the story, told at length.\n\n" + "İ" * 9 + "\n\nSecond paragraph, with x = 2.\n\na <b> c"
    assert html.main_texts([page], html.trained()) == [want]


@pytest.mark.parametrize("piece", ["<![CDATA[", "<div>", "<noscript>", "<head><script>", "<!", "<a \"", "<ul><li>", "<xmp>", "<p><td><b>", "</div>"])
def test_long_pages_take_linear_time(piece):
    from triplane.llm import html

    model, began = html.trained(), time.perf_counter()
    html.main_texts([piece * (1_000_000 // len(piece))], model)
    assert time.perf_counter() - began < 20


def test_deep_pages_as_others():
    from triplane.llm import html

    pages, _ = html.labelled_pages(30, 5)
    model = html.trained()
    x, parent, depth = html._features(pages)
    one = [model.marginals_of_one(*html._features([p])[:2]) for p in pages]
    assert np.allclose(model.marginals(x, parent, depth)[0], np.concatenate(one))
    nested = "<div>" * 500 + "<p>A paragraph of the story, told at length, far inside.</p>"
    assert html.main_texts([f"<article>{nested}</article>"], model) == ["A paragraph of the story, told at length, far inside."]


class ByHand(HTMLParser):
    """Text of the blocks outside what the fixture marks as page furniture, with the parser of the standard library."""

    AWAY = {"nav", "header", "footer", "aside", "form", "script", "style", "title", "dialog"}
    BLOCK = {"p", "h1", "h2", "h3", "li", "ul", "div", "article", "main", "section", "body", "td", "tr", "table", *AWAY}

    def __init__(self):
        super().__init__()
        self.open, self.piece, self.out = [], [], []

    def cut(self):
        run = " ".join("".join(self.piece).split())
        if run and not any(a for _, a in self.open):
            self.out.append(run)
        self.piece.clear()

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.cut()
            self.open.append((tag, tag in self.AWAY or any(v == "off" for k, v in attrs if k == "data-kind")))

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.cut()
            self.open.pop()

    def handle_data(self, data):
        self.piece.append(data)


def test_extraction_against_a_marked_corpus(spark):
    from triplane.llm import html

    rng = random.Random(21)
    links = lambda: "<ul>" + "".join(f"<li><a href=/{k}>{text(rng, 2)}</a></li>" for k in range(4)) + "</ul>"
    off = lambda name, inner: f'<div class="{name}" data-kind="off">{inner}</div>'
    around = [
        lambda: f"<nav>{links()}</nav>", lambda: f"<header>{links()}</header>", lambda: f"<footer>&copy; {text(rng, 5)}</footer>", lambda: f"<aside><h3>{text(rng, 2)}</h3>{links()}</aside>",
        lambda: off("advert", f"<p>{text(rng, 9)}</p>"), lambda: off("cookie-notice", f"<p>{text(rng, 12)}.</p>"), lambda: off("comments", f"<div class=comment><p>{text(rng, 20)}.</p></div>"),
        lambda: f"<form><p>{text(rng, 4)}</p></form>", lambda: "<script>let a = '<p>no</p>'</script>",
    ]
    pages = []
    for k in range(150):
        body = f"<h1>{text(rng, 5)}</h1>" + "".join(rng.choice((f"<p>{text(rng, 30)}, {text(rng, 9)} &amp; {text(rng, 5)}.</p>", f"<ul><li>{text(rng, 6)}</li><li>{text(rng, 6)}</li></ul>", f"<h2>{text(rng, 3)}</h2>")) for _ in range(rng.randrange(2, 9)))
        some = lambda: "".join(f() for f in rng.sample(around, rng.randrange(4)))
        pages.append((k, f"<html><head><title>t</title></head><body>{some()}<article>{body}</article>{some()}</body></html>"))
    want = {}
    for k, page in pages:
        by_hand = ByHand()
        by_hand.feed(page)
        by_hand.cut()
        want[k] = "\n\n".join(by_hand.out)
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    wrong = [k for k in want if got[k] != want[k]]
    assert len(got) == 150 and len(wrong) <= 1, [(got[k], want[k]) for k in wrong[:2]]


def test_messages_give_exact_marginals():
    from triplane.llm.html import N_FEATURES, Model, _between, labelled_pages, _features

    pages, _ = labelled_pages(30, 3)
    page = min(pages, key=lambda p: abs(len(p.parent) - 10))
    x, parent, depth = _features([page])
    rng = np.random.default_rng(0)
    model = Model(rng.normal(size=N_FEATURES) * 0.3, rng.normal(size=(3, 2, 2)))
    got = model.marginals(x, parent, depth)[0]
    n, local = len(x), x @ model.weights
    kids = np.flatnonzero(parent >= 0)
    kind = dict(zip(kids, _between(x[parent[kids]], x[kids])))
    total, on = 0.0, np.zeros(n)
    for state in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(local[i] for i in range(n) if state[i]) + sum(model.edges[kind[i]][state[parent[i]], state[i]] for i in kids))
        total += w
        on += w * np.array(state)
    assert np.allclose(got, on / total)


def test_held_out_pages():
    from triplane.llm import html

    model = html.trained()
    pages, labels = html.labelled_pages(80, seed=77)
    x, parent, depth = html._features(pages)
    p = model.marginals(x, parent, depth)[0]
    assert ((p >= 0.5) == np.concatenate(labels)).mean() > 0.95


# --- pipeline ---


def test_pipeline(spark):
    from triplane.llm import pipeline as c

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for _, stage in c.STAGES[:-1]:
        after = c.materialise(stage(spark, kept, FOLDER), "stage")
        assert after.columns == docs.columns and after.join(kept, docs.columns, "left_anti").isEmpty()
        kept = after
    assert 0.5 * docs.count() < kept.count() < docs.count()
    packed = c.run(spark, FOLDER).collect()
    want = {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in kept.collect()}
    sizes = Counter()
    for r in packed:
        sizes[r["doc_id"]] += r["length"]
    assert dict(sizes) == want


def test_pipeline_drops_copies_of_80_percent(spark):
    from triplane.llm import pipeline as c
    from triplane.llm import dedup

    docs = []
    for k in range(1000):  # shingles shared and of either: 80 of 100 to 84 of 100 in one half, 79 of 101 in the other
        both, own = (80 + k % 10 // 2, 10 - k % 10 // 4) if k < 500 else (79, 11)
        same = [f"s{k}x{j}" for j in range(both + 4)]
        docs += [(2 * k + i, " ".join(same + [f"o{k}x{i}x{j}" for j in range(own)])) for i in range(2)]
    sets = [set(dedup.shingles(t).tolist()) for _, t in docs]
    want = {i for i, _ in docs if i % 2 == 0 or 100 * len(sets[i] & sets[i - 1]) < 80 * len(sets[i] | sets[i - 1])}
    assert len(want) == 1500
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(out_of(c.keep_one_of_copies(spark, df, FOLDER), "doc_id")) == Counter((i,) for i in want)


def test_pipeline_against_brute_force(spark):
    from triplane.llm import pipeline as c
    from triplane.llm import langid, quality
    from triplane.llm.common import held_out

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plain = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]

    gam = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet").where(~held_out()))
    good = c.materialise(c.keep_quality(spark, docs, FOLDER), "good")
    assert Counter(plain(good)) == Counter(r for r in plain(docs) if gam.score(np.array([quality.features(r[1])]))[0] >= 0.5)

    codes = langid.fit(good.where(~held_out()))
    told = c.materialise(c.keep_language(spark, good, FOLDER), "told")
    clear = lambda t: any(x.isalpha() for x in t or "") and codes.decode(codes.margins(t))[2] >= 0.2
    assert Counter(plain(told)) == Counter(r for r in plain(good) if clear(r[1]))

    rng = random.Random(11)
    one, two, three = (text(rng, 60) for _ in range(3))
    more = [(900_001, one), (900_001, two), (900_001, two), (900_002, None), (None, three), (None, three), (None, three + " more"), (None, two), (None, None)]
    more = spark.createDataFrame([(i, t, "en", "test", 0) for i, t in more], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    every = c.materialise(told.select(more.columns).unionByName(more), "every")
    rows = list(dict.fromkeys(plain(every)))
    words = [(r[1] or "").encode().lower().split() for r in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [root[a] if x == root[b] else x for x in root]
    groups = defaultdict(list)
    for r, x in zip(rows, root):
        groups[x].append(r)
    got = plain(c.keep_one_of_copies(spark, every, FOLDER))
    assert len(got) == len(groups) and Counter(r[0] for r in got)[900_001] == 2
    for group in groups.values():
        stayed = [r for r in got if r in group]
        assert len(stayed) == 1 and stayed[0][0] == min((r[0] for r in group), key=lambda i: (i is None, i or 0))
    assert sorted(map(repr, plain(c.keep_one_of_copies(spark, every.orderBy(F.rand(5)).repartition(3), FOLDER)))) == sorted(map(repr, got))


def test_pipeline_of_odd_rows(spark, odd):
    from triplane.llm import pipeline as c

    one = c.keep_one_of_copies(spark, odd, FOLDER)
    assert Counter(out_of(one, "doc_id")) == Counter([(None,), (1,), (2,), (3,), (4,), (6,), (7,), (8,)])
    assert c.keep_one_of_copies(spark, odd.limit(0), FOLDER).count() == 0


def test_stages_keep_columns_that_clash(spark):
    from triplane.llm import pipeline as c

    docs = clashing(spark.read.parquet(f"{FOLDER}/documents.parquet")).withColumn("c0", F.lit("own c0")).withColumn("row", F.lit("own row"))
    odd_rows = [(i, t, "en", "odd", 0, *["own"] * (len(docs.columns) - 5)) for i, t in ODD]
    docs = docs.unionByName(spark.createDataFrame(odd_rows, docs.schema))
    for name, stage in c.STAGES:
        after = stage(spark, docs, FOLDER)
        if name != c.STAGES[-1][0]:
            assert after.columns == docs.columns and after.select("Score", "lang_pred", "c0", "row").distinct().count() <= 2
            assert 0 < after.count() < docs.count()
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert Counter(r["doc_id"] for r in after.where("piece = 0").collect()) == Counter(r["doc_id"] for r in docs.collect())


def test_entry_file():
    import corpus_pipeline
    from triplane.llm import pipeline

    assert corpus_pipeline.STAGES is pipeline.STAGES and corpus_pipeline.run is pipeline.run and corpus_pipeline.ORACLE_SQL is None


def test_least_hashed(spark, none):
    from triplane.llm.common import least_hashed

    rows = spark.range(5000).unionByName(spark.range(40).selectExpr("IF(id < 30, 7L, NULL) AS id"))
    for n in (1, 60, 4000, 9000):
        want = rows.orderBy(F.xxhash64("id"), "id").limit(n)
        assert [r[0] for r in least_hashed(rows, "id", n).collect()] == [r[0] for r in want.collect()]
    assert least_hashed(none, "doc_id", 5).count() == 0
