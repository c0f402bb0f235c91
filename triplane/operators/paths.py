"""Property paths over edge tables ``a, b``; joins keep duplicates as sequences and alternatives must, closures do not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.operators.patterns import Term, match, test, var
from triplane.written import discard, written


def link(quads: DataFrame, predicate: Term) -> DataFrame:
    return match(quads, var("a"), predicate, var("b"))


def inverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def sequence(*steps: DataFrame) -> DataFrame:
    out = steps[0]
    for after in steps[1:]:
        out = out.withColumnRenamed("b", ".mid").join(after.withColumnRenamed("a", ".mid"), ".mid").select("a", "b")
    return out


def alternative(*paths: DataFrame) -> DataFrame:
    out = paths[0]
    for other in paths[1:]:
        out = out.unionByName(other)
    return out


def nodes(quads: DataFrame) -> DataFrame:
    """Every subject and object, as column ``a``."""
    return quads.select(F.col("s").alias("a")).unionByName(quads.select(F.col("o").alias("a"))).distinct()


def _itself(some: DataFrame) -> DataFrame:
    return some.select("a", F.col("a").alias("b"))


def zero_or_one(edges: DataFrame, some: DataFrame) -> DataFrame:
    """``some``: the nodes (column ``a``) that a path of no step may stand at."""
    return edges.unionByName(_itself(some)).distinct()


#: A stride may hold this many times the edges.
STRIDE = 8


def _further(fresh: DataFrame, step: list[DataFrame], reach: int) -> DataFrame:
    """A path of ``fresh``, all of the length ``reach``, then one of ``step``. ``d``: the whole length. Joins are merges
    at every size, so that what is shuffled grows with the pairs."""
    left = fresh.select("a", F.col("b").alias(".mid"))
    met = left.join(alternative(*step).select(F.col("a").alias(".mid"), "b", "d").hint("merge"), ".mid")
    return met.select("a", "b", (F.col("d") + reach).cast("int").alias("d"))


def _unknown(far: DataFrame, known: list[DataFrame]) -> DataFrame:
    """Each pair once, with its least length, if it is not known."""
    least = far.groupBy("a", "b").agg(F.min("d").alias("d"))
    return least.join(alternative(*known).select("a", "b").hint("merge"), ["a", "b"], "left_anti")


def _single(edges: DataFrame) -> bool:
    """No node has two edges out of it, or none has two into it: lists, hierarchies, trees."""
    return any(edges.groupBy(end).count().where("count > 1").isEmpty() for end in ("a", "b"))


def one_or_more(edges: DataFrame, start: DataFrame | None = None, end: DataFrame | None = None) -> DataFrame:
    """Pairs joined by one step or more, each once. ``start`` or ``end`` (column ``a``) holds the nodes to go from or to.

    Semi-naive, by strides: a round extends the pairs whose shortest path is the longest so far, by all pairs of up to
    a stride. The stride doubles while its pairs are few for the edges, so pairs that are known move for the logarithm
    of the longest path's rounds; in dense graphs it stays short, and a round makes few more pairs than edges would.
    The rounds end with no new pair, in cycles too. Every round is written to the shared folder, so plans stay short
    and lost executors cost one round.

    Where no node has two edges out (or none two in), there is one path of a length from a node, so a pair can only be
    met again once a path has gone round a cycle, and by then the cycle's nodes are paired with themselves. Until such
    a pair turns up, known pairs are not looked up at all, and what moves in the end is a few times the result.
    """
    if end is not None and start is None:
        return inverse(one_or_more(inverse(edges), start=end))
    edges = written(edges.select("a", "b").distinct().withColumn("d", F.lit(1)), "edges")
    step, span, tip, held = [edges], 1, edges, edges.count()
    limit = STRIDE * held
    fresh = edges if start is None else written(edges.join(start.select("a").distinct(), "a", "left_semi").select("a", "b", "d"), "paths")
    found, reach, total, spare = [fresh], 1, held if start is None else fresh.count(), []
    single = start is None and _single(edges) and loops(edges).isEmpty()
    while not fresh.isEmpty():
        if start is None and total <= limit:
            step, span = list(found), reach
        elif start is not None and held <= min(total, limit) and not tip.isEmpty():
            # from some nodes only: a longer stride pays once more pairs are known than it holds
            more = written(_unknown(_further(tip, step, span), step), "paths")
            step, span, tip, held = [*step, more], 2 * span, more.where(F.col("d") == 2 * span), held + more.count()
        far = _further(fresh, step, reach)
        new = written(far if single else _unknown(far, found), "paths")
        if single and not loops(new).isEmpty():
            single, far = False, new
            new = written(_unknown(far, found), "paths")
            discard(far)
        reach += span
        fresh = new.where(F.col("d") == reach)
        found.append(new)
        total += new.count()
        if len(found) > 16:
            merged = written(alternative(*found), "paths")
            spare += found
            discard(*(t for t in spare if t is not new and t not in step))  # the last one is still to be extended
            spare = [t for t in spare if t is new or t in step]
            found = [merged]
    discard(*(t for t in [*step, *spare] if t not in found))
    out = alternative(*found).select("a", "b")
    if end is not None:
        out = out.join(end.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
    return out


def zero_or_more(edges: DataFrame, some: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """The pairs of :func:`one_or_more` are each there once, so only nodes are looked up among them, those on no cycle to be added."""
    plus = one_or_more(edges, start)
    itself = _itself((some if start is None else start).select("a").distinct())
    return plus.unionByName(itself.join(loops(plus), ["a", "b"], "left_anti"))


def loops(pairs: DataFrame) -> DataFrame:
    """Both ends the same variable."""
    return pairs.where(F.col("a") == F.col("b"))


def negated(quads: DataFrame, forward: tuple[Term, ...] = (), backward: tuple[Term, ...] = ()) -> DataFrame:
    """Steps over any predicate but those of ``forward``, and against any but those of ``backward``."""

    def other(terms: tuple[Term, ...]) -> DataFrame:
        rows = quads
        for t in terms:
            rows = rows.where(~test("p", t))
        return rows.select(F.col("s").alias("a"), F.col("o").alias("b"))

    if not backward:
        return other(forward)
    return other(forward).unionByName(inverse(other(backward))) if forward else inverse(other(backward))
