"""Best-fit packing of documents into sequences of several permitted lengths.

Rows are dealt by hash into groups of about ``group_rows`` and each group is packed by itself, so the work is parallel
and no group grows with the input; what splitting costs is at most a few part-filled bins a group.

A sequence of length c costs c tokens of linear work, c * c / ``ATTENTION`` of attention, which grows with the length,
and a fixed ``overhead``: short sequences are cheap a token but hold few pieces without waste, long ones pack well but
attend far. Inside a group, pieces are taken from the longest. A piece goes to the open bin that it leaves least room
in. If none takes it, each permitted length is tried: the pieces still to come fill it as best fit would, and the
length that costs least for each token then placed is opened. The same is done with a least length to open, for each
length, and of these packings the group takes the cheapest, so it never costs more than any one length would. At the
end every bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (1024, 2048, 4096, 8192, 16_384)
OVERHEAD = 64
#: The length at which attention costs a token as much as all else: six times the width, here 4096, of a transformer.
ATTENTION = 24_576
GROUP_ROWS = 2000


def sequence_cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    """What a sequence of this length costs, in tokens of linear work."""
    return overhead + capacity + capacity * capacity / attention


class _Rest:
    """The pieces still to come, longest first, from any place on."""

    def __init__(self, lengths: list[int]):
        self.negated, self.total = [-n for n in lengths], [0, *accumulate(lengths)]

    def fill(self, room: int, at: int) -> int:
        """Tokens that the pieces from ``at`` on put into an empty room, always the longest that fits."""
        placed, negated, total = 0, self.negated, self.total
        while room:
            at = bisect_left(negated, -room, at)
            if at >= len(negated):
                break
            to = bisect_right(total, total[at] + room, at) - 1  # as many in a row as fit
            placed += total[to] - total[at]
            room -= total[to] - total[at]
            at = to
        return placed


def _best_fit(lengths: list[int], capacities: list[int], opens) -> tuple[list[int], list[int], list[int]]:
    """Lengths, longest first -> bin and offset of each, tokens in each bin; ``opens(place, length)`` is a new bin's capacity."""
    bins, offsets, used, room = [], [], [], []  # room: sorted (free, bin)
    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = opens(i, n), len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return bins, offsets, used


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """Piece lengths, none over the largest capacity -> (bin of each, offset of each, final capacity of each bin).

    Equal lengths keep their order; equal costs go to the joint choice, then to the smaller least length.
    """
    sizes = sorted(capacities)
    price = {c: sequence_cost(c, overhead, attention) for c in sizes}
    least = lambda n: sizes[bisect_left(sizes, n)]
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    taken = [lengths[i] for i in order]
    rest = _Rest(taken)

    def joint(i: int, n: int) -> int:
        def a_token(c: int) -> tuple[float, int]:
            placed = n + rest.fill(c - n, i + 1)
            return price[least(placed)] / max(1, placed), c

        return min((c for c in sizes if c >= n), key=a_token)

    rules = [joint, *(lambda i, n, c=c: max(c, least(n)) for c in sizes)]
    tried = [_best_fit(taken, sizes, opens) for opens in rules]
    bins, offsets, used = min(tried, key=lambda t: sum(price[least(u)] for u in t[2]))
    of_bin, of_offset = [0] * len(order), [0] * len(order)
    for i, b, at in zip(order, bins, offsets):
        of_bin[i], of_offset[i] = b, at
    return of_bin, of_offset, [least(u) for u in used]


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, bin_offset, bin_capacity`` for every piece of every row.

    A row longer than the largest capacity is cut into full sequences and a rest; ``start`` is the piece's place in
    its row. A row of length null or 0 has one piece of length 0 and takes a place in some bin. Null and repeated
    doc_id, repeated rows: each row is packed, and such rows are spread over groups by their place in the input. Ties:
    rows of one length keep the order of their ids. Empty table: no rows. Other columns are not read, whatever they
    are called.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n"))
    groups = max(1, -(-rows.count() // group_rows))
    # rows of one id (null, or repeated) differ in nothing but their place in the input, so that is part of the hash
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "n", F.monotonically_increasing_id()), F.lit(groups)))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "doc_id"], ascending=[False, True], kind="stable")
        ids, piece, start, size = [], [], [], []
        for d, n in zip(pdf["doc_id"].tolist(), pdf["n"].tolist()):
            for k in range(max(1, -(-n // top))):
                ids.append(d)
                piece.append(k)
                start.append(k * top)
                size.append(min(top, n - k * top))
        bins, offsets, final = pack_lengths(size, capacities, overhead, attention)
        return pd.DataFrame({
            "doc_id": pd.Series(ids, dtype=object), "piece": piece, "start": start, "length": size,
            "bin_id": [(int(key[0]) << 32) + b for b in bins], "bin_offset": offsets, "bin_capacity": [final[b] for b in bins],
        })

    done = rows.groupBy("g").applyInPandas(one, "doc_id string, piece int, start long, length long, bin_id long, bin_offset long, bin_capacity int")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents as byte-level sequences: a token for each UTF-8 byte and one that ends the document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
