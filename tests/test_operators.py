"""Operators on small graphs and solutions, against brute force or by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from triplane.operators import aggregates as agg
from triplane.operators import forms, joins, paths, service, solutions
from triplane.operators.graphs import Dataset
from triplane.operators.patterns import bgp, blank, match, node, value, var
from triplane.operators.updates import ReadOnly, Store
from triplane.sources import results
from triplane.sources.rdf import load, parse_lines, read_rdf, statements
from triplane.terms import INTEGER, integer, iri, literal


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def solutions_of(spark, names, table):
    return spark.createDataFrame(table, ", ".join(f"{n} int" for n in names))


def fits(a, b):
    return all(a[n] == b[n] for n in a if n in b and a[n] is not None and b[n] is not None)


def merged(a, b):
    return {n: a.get(n) if a.get(n) is not None else b.get(n) for n in {**a, **b}}


@pytest.fixture(scope="module")
def maybe(spark):
    rng = random.Random(5)
    v = lambda: rng.choice((None, 1, 2))
    left = [(k, v(), v()) for k in range(14)]
    right = [(v(), v(), 100 + k) for k in range(9)]
    as_dicts = [dict(zip("kxy", r)) for r in left], [dict(zip("xyz", r)) for r in right]
    return solutions_of(spark, "kxy", left), solutions_of(spark, "xyz", right), *as_dicts


def as_rows(found):
    return sorted((tuple(r.get(n) for n in "kxyz") for r in found), key=repr)


def test_join_of_maybe_bound(maybe):
    left, right, a, b = maybe
    want = as_rows(merged(p, q) for p, q in itertools.product(a, b) if fits(p, q))
    assert rows(joins.join(left, right, maybe=("x", "y")).select("k", "x", "y", "z")) == want


def test_optional_of_maybe_bound(maybe):
    left, right, a, b = maybe
    want = []
    for p in a:
        found = [merged(p, q) for q in b if fits(p, q) and q["z"] > 103]
        want += found or [p]
    assert rows(joins.optional(left, right, joins.right("z") > 103, maybe=("x", "y")).select("k", "x", "y", "z")) == as_rows(want)


def test_minus_of_maybe_bound(maybe):
    left, right, a, b = maybe
    shares = lambda p, q: any(p[n] is not None and q[n] is not None for n in "xy")
    want = sorted((tuple(p.values()) for p in a if not any(fits(p, q) and shares(p, q) for q in b)), key=repr)
    assert rows(joins.minus(left, right.select("x", "y"), maybe=("x", "y"))) == want


def test_equi_join_plans_without_nested_loops(spark, maybe):
    from triplane.plans import explain

    left, right, _, _ = maybe
    assert "NestedLoop" not in explain(joins.join(left, right, maybe=("x", "y")))


def closure(edges):
    found = set(edges)
    while True:
        more = {(a, d) for a, b in found for c, d in edges if b == c} - found
        if not more:
            return sorted(found)
        found |= more


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4)], [(1, 2), (2, 3), (3, 1), (3, 4)], [(1, 1)], [(k, k + 1) for k in range(9)]])
def test_closure(spark, edges):
    df = spark.createDataFrame(edges, "a int, b int")
    assert sorted(rows(paths.one_or_more(df))) == closure(edges)
    one = spark.createDataFrame([(1,)], "a int")
    assert sorted(rows(paths.one_or_more(df, start=one))) == [p for p in closure(edges) if p[0] == 1]
    assert sorted(rows(paths.one_or_more(df, end=one))) == [p for p in closure(edges) if p[1] == 1]
    some = spark.createDataFrame([(1,), (9,)], "a int")
    assert sorted(rows(paths.zero_or_more(df, some))) == sorted(set(closure(edges)) | {(1, 1), (9, 9)})
    assert sorted(rows(paths.loops(paths.one_or_more(df)))) == [p for p in closure(edges) if p[0] == p[1]]


def test_closure_of_nothing(spark):
    assert rows(paths.one_or_more(spark.createDataFrame([], "a int, b int"))) == []


def test_closures_of_long_chains_take_few_rounds(spark, monkeypatch):
    edges = [(100 * c + i, 100 * c + i + 1) for c in range(3) for i in range(14)] + [(7, 7), (205, 202)]
    df, calls = spark.createDataFrame(edges, "a int, b int"), []
    write = paths.written
    monkeypatch.setattr(paths, "written", lambda *a: calls.append(a) or write(*a))
    got = rows(paths.one_or_more(df))
    assert sorted(got) == closure(edges)
    assert len(calls) <= 6  # the edges, and paths of 2, 4, 8 and 16 edges
    some = spark.createDataFrame([(x,) for x in sorted({x for e in edges for x in e} | {999})], "a int")
    star = rows(paths.zero_or_more(df, some))
    assert sorted(star) == sorted(set(closure(edges)) | {(r["a"], r["a"]) for r in some.collect()})
    assert sorted(rows(paths.zero_or_more(df, some, start=some.where("a IN (3, 203)").unionByName(some.where("a = 3"))))) == [p for p in sorted(star) if p[0] in (3, 203)]


LIST = [(k, k + 1) for k in range(20)]
TREE = [((k - 1) // 2, k) for k in range(1, 20)]
RING = [(k, (k + 1) % 6) for k in range(6)] + [(k + 10, k + 11) for k in range(9)] + [(19, 2)]


@pytest.mark.parametrize(
    "edges, looked_up",
    [
        (LIST, False), (TREE, False), ([e[::-1] for e in TREE], False),  # one path between two nodes: what is known need not move
        (RING, True), ([e[::-1] for e in RING], True), (LIST + [(20, 0)], True), (LIST + [(20, 20)], True), (LIST + [(0, 5), (3, 9)], True),
    ],
)
def test_closures_look_up_what_is_known_only_where_paths_can_meet(spark, monkeypatch, edges, looked_up):
    df, plans, write = spark.createDataFrame(edges, "a int, b int"), [], paths.written
    monkeypatch.setattr(paths, "written", lambda *a: plans.append(a[0]._jdf.queryExecution().optimizedPlan().toString()) or write(*a))
    assert sorted(rows(paths.one_or_more(df))) == closure(edges)
    assert any("LeftAnti" in plan for plan in plans) is looked_up


LINES = r"""
<urn:a> <urn:p> "xé\n\"q\" \U0001F600"@en .
_:b1 <urn:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <urn:g> . # a comment
# another
<urn:a> <urn:q> _:b1 .
<urn:a> <urn:q> "" .
<urn:a> <urn:q> "" .
"""


@pytest.fixture(scope="module")
def quads(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rdf") / "x.nq"
    path.write_text(LINES)
    return read_rdf(spark, str(path))


def test_reading(quads):
    assert quads.count() == 4
    assert quads.where("o.lang = 'en'").first()["o"]["lex"] == 'xé\n"q" 😀'
    assert quads.where("o.dt IS NOT NULL").first()["g"]["lex"] == "urn:g"


def test_round_trip_of_statements(spark, quads):
    for ascii_only in (True, False):
        assert rows(parse_lines(statements(quads, ascii_only))) == rows(quads)


def test_bad_lines(spark):
    bad = spark.createDataFrame([("<urn:a> <urn:p> .",), ("<urn:a> <urn:p> <urn:b> .",)], "value string")
    assert parse_lines(bad, strict=False).count() == 1
    with pytest.raises(Exception, match="not a statement"):
        parse_lines(bad).collect()


def test_load_keeps_blank_nodes_apart(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.nt").write_text("_:x <urn:p> <urn:o> .\n")
    found = load(spark, [{"file": str(tmp_path / "a.nt"), "graph": "urn:1"}, {"file": str(tmp_path / "b.nt"), "graph": "urn:2"}])
    assert len({r["s"]["lex"] for r in found.collect()}) == 2
    assert rows(Dataset(found).graph_names().select("g.lex")) == [("urn:1",), ("urn:2",)]


def test_turtle(spark, tmp_path):
    from triplane.sources.turtle import read_turtle

    (tmp_path / "a.ttl").write_text("""# a comment
@prefix : <http://x/> . PREFIX p: <http://p#>
@base <http://b/dir/> .
:a p:b <c>, p:d\\-e ; a :T ;; p:n 1, -2.5, 3e4, true .
_:x p:list ( 1 "two"@en-GB [ p:q 'it\\u0041' ] ) .
[ p:own """ + '"""long "quoted"\ntext""" ' + """] .
[] p:typed "5"^^p:t ; p:empty () .
:dot.ted p:b :x.y .
""")
    got = read_turtle(spark, str(tmp_path / "*.ttl")).collect()
    plain = {(r["s"]["lex"] if r["s"]["kind"] == 0 else "_", r["p"]["lex"], tuple(r["o"])[1:] if r["o"]["kind"] != 1 else "_") for r in got}
    xsd, rdf = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    want = {("http://x/a", "http://p#b", (o, None, None)) for o in ("http://b/dir/c", "http://p#d-e")} | {("http://x/a", rdf + "type", ("http://x/T", None, None))}
    want |= {("http://x/a", "http://p#n", (v, xsd + k, None)) for v, k in (("1", "integer"), ("-2.5", "decimal"), ("3e4", "double"), ("true", "boolean"))}
    want |= {("_", "http://p#list", "_"), ("_", rdf + "first", ("1", xsd + "integer", None)), ("_", rdf + "first", ("two", None, "en-GB")), ("_", rdf + "first", "_"), ("_", rdf + "rest", "_"), ("_", rdf + "rest", (rdf + "nil", None, None))}
    want |= {("_", "http://p#q", ("itA", None, None)), ("_", "http://p#own", ('long "quoted"\ntext', None, None)), ("_", "http://p#typed", ("5", "http://p#t", None)), ("_", "http://p#empty", (rdf + "nil", None, None))}
    assert plain == want | {("http://x/dot.ted", "http://p#b", ("http://x/x.y", None, None))} and len(got) == len(plain) + 1
    (tmp_path / "b.ttl").write_text("_:x <urn:p> 1 .")
    found = load(spark, [{"file": str(tmp_path / "b.ttl"), "graph": "urn:g"}, {"file": str(tmp_path / "b.ttl"), "graph": "urn:h"}])
    assert len({r["s"]["lex"] for r in found.collect()}) == 2
    (tmp_path / "c.ttl").write_text("<urn:a> <urn:b> .")
    with pytest.raises(Exception, match="mark|expected"):
        read_turtle(spark, str(tmp_path / "c.ttl")).collect()


def test_result_files(spark, tmp_path):
    import csv
    import json
    import xml.etree.ElementTree as tree

    df = spark.range(1000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('a "<&,'), F.col("id").cast("string"))).alias("x")).repartition(5)

    def text(kind, table=df):
        path = tmp_path / f"{kind}{table is df}"
        results.write_results(table, str(path), kind)
        return "".join(p.read_text() for p in sorted(path.glob("part-*")))

    want = sorted((k, f'a "<&,{k}' if k % 3 else None) for k in range(1000))
    found = list(csv.reader(text("csv").splitlines()))
    assert found[0] == ["n", "x"] and sorted((int(n), x or None) for n, x in found[1:]) == want
    assert text("tsv").startswith("?n\t?x\n") and len(text("tsv", df.limit(3)).splitlines()) == 4
    found = json.loads(text("json"))
    assert found["head"] == {"vars": ["n", "x"]} and sorted((int(b["n"]["value"]), b.get("x", {}).get("value")) for b in found["results"]["bindings"]) == want
    assert json.loads(text("json", df.limit(0)))["results"]["bindings"] == []
    assert rows(results.read_json(spark, str(tmp_path / "jsonTrue"), ["x"]).select("x.lex")) == sorted(((x,) for _, x in want), key=repr)
    found = tree.fromstring(text("xml"))
    assert len(found[1]) == 1000 and found[0][0].attrib == {"name": "n"}
    with pytest.raises(ValueError):
        results.to_csv(df, rows=999)


def test_results_round_trip(spark, quads, tmp_path):
    df = match(quads, var("s"), var("p"), var("o"))
    df = df.withColumn("n", F.when(F.col("s.kind") == 1, F.col("s")))
    for name, write, read in (("x.srj", results.to_json, results.read_json), ("x.srx", results.to_xml, results.read_xml)):
        (tmp_path / name).write_text(write(df))
        assert rows(read(spark, str(tmp_path / name), ["s", "p", "o", "n"])) == rows(df)
    assert results.to_csv(df.select("n").where("n IS NULL").limit(1)) == "n\n\n"
    assert results.to_json(forms.ask(df)) == '{"head": {}, "boolean": true}'
    assert "<boolean>true</boolean>" in results.to_xml(forms.ask(df))
    assert results.serialize(df.limit(1), "text/csv;q=0.5, application/sparql-results+json")[0] == "application/sparql-results+json"
    assert "h:a" in results.to_table(df, prefixes={"h": "urn:"})


def test_patterns(quads):
    assert match(quads, var("x"), node("urn:q"), blank("b1")).count() == 1
    assert match(quads, var("x"), var("p"), value("5", INTEGER)).count() == 1
    assert bgp(quads, (node("urn:a"), node("urn:q"), var("b")), (var("b"), node("urn:p"), var("n"))).count() == 1


def test_order_of_terms(spark):
    terms = [literal("b"), integer(F.lit(10)), integer(F.lit(9)), iri("urn:a"), F.lit(None).cast("struct<kind:tinyint,lex:string,dt:string,lang:string>")]
    df = spark.range(1).select(F.explode(F.array(*terms)).alias("t"))
    assert [r[0] and r[0]["lex"] for r in solutions.order(df, (F.col("t"), True)).collect()] == [None, "urn:a", "9", "10", "b"]


def test_sum_needs_numbers(spark):
    df = spark.range(3).select(F.when(F.col("id") < 2, integer(F.col("id"))).otherwise(literal("x")).alias("t"))
    assert agg.group(df, [], s=agg.total_terms(F.col("t"))).first()[0] is None
    assert agg.group(df.where("t.lex <> 'x'"), [], s=agg.total_terms(F.col("t"))).first()[0]["lex"] == "1"
    assert agg.group(df.limit(0), [], s=agg.total_terms(F.col("t")), n=agg.count_all()).first()["n"] == 0
    assert agg.group(df.limit(0).withColumn("k", F.lit(1)), ["k"], n=agg.count_all()).count() == 0


def test_construct_names_new_nodes(spark):
    df = spark.createDataFrame([("urn:a", 1), ("urn:b", 2)], "x string, n int").select(iri(F.col("x")).alias("x"))
    made = forms.construct(df, (blank("n"), node("urn:p"), var("x")), (blank("n"), node("urn:q"), value("v")))
    assert made.count() == 4 and made.select("s").distinct().count() == 2


def test_describe_follows_blank_nodes(spark):
    lines = spark.createDataFrame([("<urn:a> <urn:p> _:x .",), ("_:x <urn:p> _:y .",), ("_:y <urn:p> <urn:b> .",), ("<urn:b> <urn:p> <urn:c> .",)], "value string")
    quads = parse_lines(lines)
    assert forms.describe(quads, quads.where("s.lex = 'urn:a'").select("s")).count() == 3


def test_insertions_append(spark, quads):
    n = len(quads.collect())
    store = Store(quads.unionByName(quads).withColumn("g", F.coalesce("g", iri("urn:d"))), parts=3)
    more = quads.drop("g").withColumn("p", iri("urn:new"))
    store.insert(more, "urn:h")
    files = set(store.quads.inputFiles())
    before = store.quads
    store.insert(more.unionByName(more), "urn:h")  # nothing new
    assert store.quads.count() == before.count() == 2 * n and files <= set(store.quads.inputFiles())
    store.insert(more.limit(1), "urn:i")
    assert store.parts == 1 and store.quads.count() == 2 * n + 1 and not files & set(store.quads.inputFiles())
    store.insert(more, "urn:j")
    assert store.parts == 2 and store.quads.count() == 3 * n + 1
    stored = Store(store.quads, distinct=True).insert(more, "urn:k")
    assert set(store.quads.inputFiles()) < set(stored.quads.inputFiles()) and stored.quads.count() == 4 * n + 1


def test_exists_of_maybe_bound(maybe):
    from triplane.plans import explain

    left, right, a, b = maybe
    want = sorted((tuple(p[n] for n in "kxy") for p in a if any(fits(p, q) for q in b)), key=repr)
    got = joins.exists(left, right, maybe=("x", "y"))
    assert rows(got) == want
    rest = joins.not_exists(left, right, maybe=("x", "y"))
    assert rows(rest) == sorted((tuple(p[n] for n in "kxy") for p in a if not any(fits(p, q) for q in b)), key=repr)
    assert "NestedLoop" not in explain(got) + explain(rest) and "Cartesian" not in explain(got) + explain(rest)
    flagged = {tuple(r)[:3]: r["f"] for r in joins.exists_flag(left, right, "f", maybe=("x", "y")).collect()}
    assert flagged == {tuple(p[n] for n in "kxy"): any(fits(p, q) for q in b) for p in a}
    some = joins.exists(left, right, joins.right("z") > 104, maybe=("x", "y"))
    assert rows(some) == sorted((tuple(p[n] for n in "kxy") for p in a if any(fits(p, q) and q["z"] > 104 for q in b)), key=repr)
    assert {r["f"] for r in joins.exists_flag(left, right.select("z"), "f").collect()} == {True}


def test_join_of_three_maybe_bound(spark):
    rng = random.Random(8)
    v = lambda: rng.choice((None, 1, 2))
    a, b = ([dict(zip("xyz", (v(), v(), v())), **{k: i}) for i in range(12)] for k in "kl")
    left, right = solutions_of(spark, "xyzk", [tuple(r.values()) for r in a]), solutions_of(spark, "xyzl", [tuple(r.values()) for r in b])
    want = sorted((tuple(merged(p, q)[n] for n in "xyzkl") for p in a for q in b if fits(p, q)), key=repr)
    assert rows(joins.join(left, right, maybe=("x", "y", "z")).select(*"xyzkl")) == want
    assert joins.join(left.limit(0), right, maybe=("x", "y", "z")).count() == 0


def test_updates(spark, quads, tmp_path):
    store = Store(quads.withColumn("g", F.coalesce("g", iri("urn:d"))))
    count = lambda: dict(rows(store.quads.groupBy("g.lex").count()))
    assert count() == {"urn:d": 3, "urn:g": 1}
    with pytest.raises(ValueError):
        store.create("urn:g")
    with pytest.raises(ValueError):
        store.delete(quads.where("s.kind = 1"))
    with pytest.raises(ValueError):
        store.drop("urn:none")
    (tmp_path / "more.nt").write_text("<urn:z> <urn:p> <urn:o> .\n")
    store.load(str(tmp_path / "more.nt"), "urn:new").load(str(tmp_path / "none.nt"), "urn:new", silent=True)
    assert count()["urn:new"] == 1
    store.move("urn:new", "urn:g").drop_named()
    assert count() == {}
    with pytest.raises(ReadOnly):
        Store(quads, read_only=True).clear_all()


def test_service(spark):
    with pytest.raises(KeyError):
        service.service(spark, "urn:none")
    assert service.service(spark, "urn:none", silent=True).count() == 1


def test_star_reads_only_its_columns(spark):
    from triplane.plans import explain
    from triplane.sources.tables import mapped_tables

    rows_ = mapped_tables(spark, "/root/testdata/sf0.001")["lineitem"].star(None, l_returnflag="f", l_quantity="q").where("q > 10").select("f")
    plan = explain(rows_)
    assert "GreaterThan(l_quantity,10.0)" in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_placed(spark):
    rows = [(k * 7919 % 4001, None if k % 50 == 0 else k % 90) for k in range(4000)]
    df = spark.createDataFrame(rows, "x long, y long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several partitions have rows
    try:
        got = sorted(tuple(r) for r in solutions.placed(df, (F.col("y"), False), (F.col("x"), True)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == [(k + 1, *r) for k, r in enumerate(want)]
    assert solutions.placed(df.limit(0), (F.col("x"), True)).count() == 0
