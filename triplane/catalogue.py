"""Queries over the mapped tables, one for each operator or function, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import triplane.functions as fn
from triplane.operators import aggregates as agg
from triplane.operators import forms, joins, language, paths, service, solutions
from triplane.operators.graphs import Dataset
from triplane.operators.patterns import A, bgp, match, node, value, var
from triplane.operators.updates import Store
from triplane.sources import statistics
from triplane.sources.tables import NS, Mapped, mapped_tables
from triplane.terms import DATETIME, STRING, XSD, date_time, decimal, double, integer, iri, literal, number

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    """Registers a query that takes the mapped tables by name."""

    def add(f: Callable[[dict[str, Mapped]], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(mapped_tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return add


def _p(name: str):
    return node(NS + name)


def _key(t):
    """The number at the end of a subject's IRI."""
    return F.substring_index(t["lex"], "/", -1).cast("bigint")


# --- scans and sources ---


@_query("S1_scan", "SELECT l_returnflag AS flag, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_discount < 0.05 GROUP BY ALL")
def _(t):
    rows = t["lineitem"].star(None, l_returnflag="flag", l_quantity="qty", l_discount="d").where("d < 0.05")
    return agg.group(rows, ["flag"], sum_qty=F.sum("qty"), n=agg.count_all())


@_query("S1_star_baseline", "SELECT l_returnflag AS flag, round(sum(l_quantity * l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    rows = t["lineitem"].star(None, l_returnflag="flag", l_quantity="q", l_extendedprice="e")
    return agg.group(rows, ["flag"], total=F.round(F.sum(F.col("q") * F.col("e")), 2), n=agg.count_all())


@_query("S1_quad_scan", "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return match(t["orders"].quads(only=("o_orderstatus",)), var("o"), _p("o_orderstatus"), value("F")).select(_key(F.col("o")).alias("o"))


@_query("S2_repeated_var", "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey = n_regionkey")
def _(t):
    # a nation whose key is its region's: the quads of one predicate, with region keys put in the nations' place
    quads = t["nation"].quads(only=("n_region",))
    as_nation = quads.withColumn("o", iri(F.replace(F.col("o.lex"), F.lit("/region/"), F.lit("/nation/"))))
    return match(as_nation, var("x"), _p("n_region"), var("x")).select(_key(F.col("x")).alias("k"))


@_query("S6_graphs", "SELECT 'http://ex.org/g/nation' AS g UNION ALL SELECT 'http://ex.org/g/region'")
def _(t):
    quads = t["region"].quads(NS + "g/region").unionByName(t["nation"].quads(NS + "g/nation"))
    return Dataset(quads).graph_names().select(F.col("g.lex").alias("g"))


@_query("S8_federation", "SELECT 'region' AS source, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation")
def _(t):
    quads = t["region"].quads("region", only=("r_name",)).unionByName(t["nation"].quads("nation", only=("n_name",)))
    return agg.group(quads.select(F.col("g.lex").alias("source")), ["source"], n=agg.count_all())


_PREFERRED = """
WITH s AS (SELECT doc_id % 50 AS k, text, lang, CASE lang WHEN 'de' THEN 0.9 WHEN 'fr' THEN 0.5 ELSE 0.1 END AS q FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT k, lang, md5(text) AS h FROM s QUALIFY q = max(q) OVER (PARTITION BY k)
"""


@_query("S9_langpref", _PREFERRED)
def _(t):
    rows = t["documents"].df.where("text IS NOT NULL")
    quads = rows.select(iri(F.concat(F.lit(NS + "topic/"), (F.col("doc_id") % 50).cast("string"))).alias("s"), iri(NS + "text").alias("p"), literal(F.col("text"), None, F.col("lang")).alias("o"), iri(NS + "g").alias("g"))
    best = language.prefer_language(quads, {"de": 0.9, "fr": 0.5, "*": 0.1})
    return best.select(_key(F.col("s")).alias("k"), F.col("o.lang").alias("lang"), F.md5(F.col("o.lex").cast("binary")).alias("h")).distinct()


@_query("S10_langpref_triples", _PREFERRED)
def _(t):
    rows = t["documents"].df.where("text IS NOT NULL")
    triples = rows.select((F.col("doc_id") % 50).alias("s"), F.lit("text").alias("p"), literal(F.col("text"), None, F.col("lang")).alias("o"))
    best = language.prefer_language(triples, {"de": 0.9, "fr": 0.5, "*": 0.1})
    return best.select(F.col("s").alias("k"), F.col("o.lang").alias("lang"), F.md5(F.col("o.lex").cast("binary")).alias("h")).distinct()


@_query("S15_service", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    service.register_endpoint("urn:regions", lambda: t["region"].star("r", r_name="region"))
    spark = t["nation"].df.sparkSession
    return joins.join(t["nation"].star("n", n_name="nation", n_region="r"), service.service(spark, "urn:regions")).select("nation", "region")


@_query("S16_values", "SELECT n_name AS name, w FROM nation JOIN (VALUES ('GERMANY', 1), ('FRANCE', 2), ('NATION_3', 3), ('NATION_7', 7)) v(n, w) ON n_name = n")
def _(t):
    rows = solutions.values(t["nation"].df.sparkSession, "name string, w int", [("GERMANY", 1), ("FRANCE", 2), ("NATION_3", 3), ("NATION_7", 7)])
    return joins.join(t["nation"].star("n", n_name="name"), rows).select("name", "w")


@_query("S16_values_undef", "SELECT n_nationkey AS n, n_regionkey AS r, w FROM nation JOIN (VALUES (3, NULL, 1), (NULL, 2, 2), (NULL, NULL, 3), (5, 0, 4)) v(a, b, w) ON (a IS NULL OR a = n_nationkey) AND (b IS NULL OR b = n_regionkey)")
def _(t):
    rows = solutions.values(t["nation"].df.sparkSession, "n int, r int, w int", [(3, None, 1), (None, 2, 2), (None, None, 3), (5, 0, 4)])
    return joins.join(t["nation"].star("n", n_region="r"), rows, maybe=("n", "r"))


@_query("S17_unit_join", "SELECT n_name AS name FROM nation")
def _(t):
    return joins.join(solutions.unit(t["nation"].df.sparkSession), t["nation"].star("n", n_name="name")).select("name")


def _written_lines(t, name: str, **kind) -> str:
    """A folder of statements of one table."""
    from triplane.sources.rdf import write_rdf
    from triplane.written import shared_dir

    path = f"{shared_dir(t[name].df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write_rdf(t[name].quads(**kind).drop("g"), path)
    return path


@_query("S4_whole_scan", "SELECT 'http://ex.org/nation/' || n_nationkey AS s, p FROM nation, (VALUES ('n_name'), ('n_region'), ('type'), ('n_regionkey')) v(p)")
def _(t):
    rows = match(t["nation"].quads(), var("s"), var("p"), var("o"))
    return rows.select(F.col("s.lex").alias("s"), F.regexp_extract(F.col("p.lex"), "[^/#]+$", 0).alias("p"))


@_query("S7_load_sources", "SELECT 'urn:n' AS g, count(*) AS n FROM nation UNION ALL SELECT 'urn:r', count(*) FROM region")
def _(t):
    from triplane.sources.rdf import load

    sources = [{"file": _written_lines(t, "nation", only=("n_name",)), "graph": "urn:n"}, {"file": _written_lines(t, "region", only=("r_name",)), "graph": "urn:r"}]
    return agg.group(load(t["nation"].df.sparkSession, sources).select(F.col("g.lex").alias("g")), ["g"], n=agg.count_all())


@_query("S12_ntriples", "SELECT c_custkey AS c, c_name AS name FROM customer")
def _(t):
    from triplane.sources.rdf import read_rdf

    quads = read_rdf(t["customer"].df.sparkSession, _written_lines(t, "customer", only=("c_name",)))
    return match(quads, var("c"), _p("c_name"), var("name")).select(_key(F.col("c")).alias("c"), F.col("name.lex").alias("name"))


@_query("S11_turtle", """
SELECT 'http://ex.org/region/' || r_regionkey AS s, r_name AS name, n AS nations FROM region
JOIN (SELECT n_regionkey AS k, string_agg(n_name, ' ' ORDER BY n_name) AS n FROM nation GROUP BY ALL) ON k = r_regionkey""")
def _(t):
    from triplane.sources.turtle import read_turtle
    from triplane.written import shared_dir

    spark = t["region"].df.sparkSession
    names = agg.group(t["nation"].star("n", n_region="r", n_name="x"), ["r"], names=F.concat_ws(", ", F.collect_list(F.concat(F.lit("[ ex:n_name '"), "x", F.lit("' ]")))))
    text = F.format_string("@prefix ex: <http://ex.org/> . <region/%d> a ex:Region ; ex:r_name \"%s\" ; ex:has %s .", "r", "name", "names")
    path = f"{shared_dir(spark)}/turtle-{uuid.uuid4().hex}"
    joins.join(t["region"].star("r", r_name="name"), names).select(text.alias("value")).write.text(path)
    rows = bgp(read_turtle(spark, path, base=NS), (var("s"), _p("r_name"), var("name")), (var("s"), _p("has"), var("x")), (var("x"), _p("n_name"), var("nation")))
    rows = rows.select(F.col("s.lex").alias("s"), F.col("name.lex").alias("name"), F.col("nation.lex").alias("nation"))
    return agg.group(rows, ["s", "name"], nations=agg.group_concat(F.col("nation"), " "))


# --- sinks ---


@_query("K2_csv_lines", "SELECT r_regionkey || ',' || r_name AS value FROM region")
def _(t):
    from triplane.sources.results import csv_lines

    return csv_lines(t["region"].star("r", r_name="name"))


@_query("K3_tsv_lines", "SELECT '\"' || r_regionkey || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' || chr(9) || '\"' || r_name || '\"' AS value FROM region")
def _(t):
    from triplane.sources.results import tsv_lines

    return tsv_lines(t["region"].star("r", r_name="name"))


@_query("K4_xml_results", """SELECT '<result><binding name="name"><literal>' || r_name || '</literal></binding></result>' AS value FROM region""")
def _(t):
    from triplane.sources.results import xml_lines

    return xml_lines(t["region"].star("r", r_name="name").select("name"))


def _result_file(t, kind: str) -> DataFrame:
    """All lines of a table's result file, as the executors wrote it."""
    from triplane.sources.results import write_results
    from triplane.written import shared_dir

    spark = t["customer"].df.sparkSession
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    write_results(t["customer"].star("c", c_name="name").select("name"), path, kind)
    return spark.read.text(path)


@_query("K2_csv_file", "SELECT 'name' AS value UNION ALL SELECT c_name FROM customer")
def _(t):
    return _result_file(t, "csv")


@_query("K3_tsv_file", "SELECT '?name' AS value UNION ALL SELECT '\"' || c_name || '\"' FROM customer")
def _(t):
    return _result_file(t, "tsv")


@_query("K4_xml_file", """
SELECT unnest(['<?xml version="1.0"?>', '<sparql xmlns="http://www.w3.org/2005/sparql-results#">', '<head><variable name="name"/></head>', '<results>', '</results>', '</sparql>']) AS value
UNION ALL SELECT '<result><binding name="name"><literal>' || c_name || '</literal></binding></result>' FROM customer""")
def _(t):
    return _result_file(t, "xml")


@_query("K7_json_file", "SELECT c_name AS name FROM customer")
def _(t):
    from triplane.sources.results import read_json, write_results
    from triplane.written import shared_dir

    spark = t["customer"].df.sparkSession
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    write_results(t["customer"].star("c", c_name="name").select("name"), path, "json")
    return read_json(spark, path, ["name"]).select(F.col("name.lex").alias("name"))


@_query("K5_ntriples", "SELECT '<http://ex.org/customer/' || c_custkey || '> <http://ex.org/c_name> \"' || c_name || '\" .' AS value FROM customer")
def _(t):
    from triplane.sources.rdf import statements

    return statements(t["customer"].quads(only=("c_name",)).drop("g"))


@_query("K6_nquads", "SELECT '<http://ex.org/customer/' || c_custkey || '> <http://ex.org/c_nation> <http://ex.org/nation/' || c_nationkey || '> <urn:g> .' AS value FROM customer")
def _(t):
    from triplane.sources.rdf import statements

    return statements(t["customer"].quads("urn:g", only=("c_nation",)))


@_query("K7_json_bindings", """SELECT '{"name":{"type":"literal","value":"' || r_name || '"}}' AS value FROM region""")
def _(t):
    from triplane.sources.results import json_lines

    return json_lines(t["region"].star("r", r_name="name").select("name"))


@_query("K9_dump", """
SELECT '<http://ex.org/region/' || r_regionkey || '> <http://ex.org/r_name> "' || r_name || '" <urn:g> .' AS value FROM region
UNION ALL SELECT '<http://ex.org/region/' || r_regionkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex.org/Region> <urn:g> .' FROM region""")
def _(t):
    from triplane.sources.rdf import statements

    return statements(t["region"].quads("urn:g"))


@_query("K8_void_stats", """
SELECT 'triples' AS kind, NULL AS term, (SELECT count(*) * 4 FROM nation) AS n
UNION ALL SELECT 'predicate', p, (SELECT count(*) FROM nation) FROM (VALUES ('http://ex.org/n_name'), ('http://ex.org/n_regionkey'), ('http://ex.org/n_region'), ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type')) v(p)
UNION ALL SELECT 'class', 'http://ex.org/Nation', (SELECT count(*) FROM nation)""")
def _(t):
    return statistics.counts(t["nation"].quads())


@_query("K8_void_top", "SELECT 'predicate' AS kind, p AS term, (SELECT count(*) FROM customer) AS n FROM (VALUES ('http://ex.org/c_acctbal'), ('http://ex.org/c_mktsegment'), ('http://ex.org/c_name')) v(p)")
def _(t):
    return statistics.top_share(statistics.counts(t["customer"].quads()), "predicate", 3)


# --- projection, filter, extension ---


@_query("P1_project", "SELECT c_custkey AS c, c_name AS name, NULL AS missing FROM customer")
def _(t):
    return solutions.project(t["customer"].star("c", c_name="name"), "c", "name", "missing").withColumn("missing", F.col("missing.lex"))


@_query("P2_select_star", "SELECT c_acctbal AS bal, c_custkey AS c, c_name AS name FROM customer")
def _(t):
    return solutions.project_all(t["customer"].star("c", c_name="name", c_acctbal="bal").withColumn(".hidden", F.lit(1)))


@_query("P3_select_expr", "SELECT l_orderkey AS o, round(l_extendedprice * (1 - l_discount), 4) AS price FROM lineitem")
def _(t):
    return solutions.extend(t["lineitem"].star(None, l_order="o", l_extendedprice="e", l_discount="d"), "price", F.round(F.col("e") * (1 - F.col("d")), 4)).select("o", "price")


@_query("P4_filter", "SELECT o_orderkey AS o FROM orders WHERE o_totalprice > 200000 AND o_orderpriority LIKE '1%'")
def _(t):
    rows = t["orders"].star("o", o_totalprice="price", o_orderpriority="pr")
    return solutions.keep(rows, (F.col("price") > 200000) & F.col("pr").startswith("1")).select("o")


@_query("P4_filter_terms", "SELECT o_orderkey AS o FROM orders WHERE o_totalprice > 200000")
def _(t):
    rows = match(t["orders"].quads(only=("o_totalprice",)), var("o"), _p("o_totalprice"), var("x"))
    return solutions.keep(rows, fn.gt(F.col("x"), integer(F.lit(200000)))).select(_key(F.col("o")).alias("o"))


@_query("P5_bind", "SELECT n_nationkey AS n, n_regionkey AS r FROM nation WHERE n_regionkey = n_nationkey % 5")
def _(t):
    return solutions.extend(t["nation"].star("n", n_region="r"), "r", (F.col("n") % 5).cast("int"))


@_query("P6_filters", "SELECT p_partkey AS p FROM part WHERE p_size > 10 AND p_size < 20 AND p_retailprice > 1000")
def _(t):
    rows = t["part"].star("p", p_size="size", p_retailprice="price")
    return rows.where("size > 10").where("size < 20").where("price > 1000").select("p")


@_query("P7_reduced", "SELECT DISTINCT c_mktsegment AS seg FROM customer")
def _(t):
    return solutions.reduced(t["customer"].star("c", c_mktsegment="seg").select("seg"))


# --- joins ---


@_query("J2_join_2hop", "SELECT c_name AS name, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    rows = joins.join(t["customer"].star("c", c_name="name", c_nation="n"), t["nation"].star("n", n_name="nation", n_region="r"))
    return joins.join(rows, t["region"].star("r", r_name="region")).select("name", "nation", "region")


@_query("J2_star_5", "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 4) AS disc, count(*) AS n FROM lineitem WHERE l_tax <= 0.06 GROUP BY ALL")
def _(t):
    rows = t["lineitem"].star(None, l_returnflag="flag", l_linestatus="status", l_quantity="q", l_extendedprice="e", l_discount="d", l_tax="x").where("x <= 0.06")
    return agg.group(rows, ["flag", "status"], qty=F.round(F.sum("q"), 2), price=F.round(F.sum("e"), 2), disc=F.round(F.avg("d"), 4), n=agg.count_all())


@_query("J2_quad_bgp", "SELECT o_orderkey AS o, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def _(t):
    quads = t["orders"].quads(only=("o_orderstatus", "o_customer")).unionByName(t["customer"].quads(only=("c_name",)))
    rows = bgp(quads, (var("o"), _p("o_customer"), var("c")), (var("o"), _p("o_orderstatus"), value("F")), (var("c"), _p("c_name"), var("name")))
    return rows.select(_key(F.col("o")).alias("o"), F.col("name.lex").alias("name"))


@_query("J3_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b")
def _(t):
    return joins.join(t["region"].star("r1", r_name="a"), t["region"].star("r2", r_name="b")).select("a", "b")


@_query("J4_optional", "SELECT o_orderkey AS o, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def _(t):
    return joins.optional(t["orders"].star("o"), t["lineitem"].star(None, l_order="o", l_quantity="q")).select("o", "q")


@_query("J4_optional_filter", "SELECT o_orderkey AS o, l_extendedprice AS e FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_extendedprice > o_totalprice / 4")
def _(t):
    return joins.optional(t["orders"].star("o", o_totalprice="t"), t["lineitem"].star(None, l_order="o", l_extendedprice="e"), joins.right("e") > F.col("t") / 4).select("o", "e")


@_query("J4_optional_nested", """
SELECT n_nationkey AS n, c.c_custkey AS c, o.o_orderkey AS o FROM nation
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) c ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey""")
def _(t):
    poor = t["customer"].star("c", c_nation="n", c_acctbal="b").where("b < 0").select("n", "c")
    done = t["orders"].star("o", o_customer="c", o_orderstatus="s").where("s = 'F'").select("c", "o")
    return joins.optional(t["nation"].star("n"), joins.optional(poor, done)).select("n", "c", "o")


@_query("J4_maybe_bound", """
WITH a AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey END AS r FROM nation),
b AS (SELECT r_regionkey AS r, r_name AS name FROM region UNION ALL SELECT NULL, 'ANY')
SELECT n, coalesce(a.r, b.r) AS r, name FROM a JOIN b ON a.r IS NULL OR b.r IS NULL OR a.r = b.r""")
def _(t):
    left = t["nation"].star("n", n_region="r").withColumn("r", F.when(F.col("n") % 3 > 0, F.col("r")))
    extra = solutions.values(t["region"].df.sparkSession, "r int, name string", [(None, "ANY")])
    return joins.join(left, t["region"].star("r", r_name="name").unionByName(extra), maybe=("r",))


@_query("J4_maybe_optional", """
WITH a AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey END AS r FROM nation),
b AS (SELECT r_regionkey AS r, r_name AS name FROM region WHERE r_regionkey < 2)
SELECT n, coalesce(a.r, b.r) AS r, name FROM a LEFT JOIN b ON a.r IS NULL OR a.r = b.r""")
def _(t):
    left = t["nation"].star("n", n_region="r").withColumn("r", F.when(F.col("n") % 3 > 0, F.col("r")))
    return joins.optional(left, t["region"].star("r", r_name="name").where("r < 2"), maybe=("r",))


@_query("J5_join_list", """
SELECT o_orderkey AS o, n_name AS nation, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'O' GROUP BY ALL""")
def _(t):
    rows = joins.join(t["lineitem"].star(None, l_order="o", l_extendedprice="e", l_discount="d"), t["orders"].star("o", o_customer="c", o_orderstatus="s").where("s = 'O'"))
    rows = joins.join(joins.join(rows, t["customer"].star("c", c_nation="k")), t["nation"].star("k", n_name="nation"))
    return agg.group(rows, ["o", "nation"], n=agg.count_all(), revenue=F.round(F.sum(F.col("e") * (1 - F.col("d"))), 4))


@_query("J6_cartesian", "SELECT r_name AS region, n_name AS nation FROM region, nation")
def _(t):
    return joins.join(t["region"].star("r", r_name="region"), t["nation"].star("n", n_name="nation")).select("region", "nation")


@_query("J7_minus", "SELECT o_orderkey AS o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return joins.minus(t["orders"].star("o"), t["lineitem"].star(None, l_order="o").select("o"))


@_query("J7_minus_disjoint", "SELECT r_name AS name FROM region")
def _(t):
    return joins.minus(t["region"].star("r", r_name="name"), t["nation"].star("n").select("n")).select("name")


@_query("J7_minus_maybe", """
WITH a AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey END AS r FROM nation)
SELECT n, r FROM a WHERE r IS NULL OR r NOT IN (1, 2)""")
def _(t):
    left = t["nation"].star("n", n_region="r").withColumn("r", F.when(F.col("n") % 3 > 0, F.col("r")))
    gone = solutions.values(left.sparkSession, "r int", [(1,), (2,), (None,)])
    return joins.minus(left, gone, maybe=("r",))


@_query("J8_exists", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(t):
    return joins.exists(t["customer"].star("c"), t["orders"].star("o", o_customer="c", o_totalprice="p").where("p > 300000").select("c"))


@_query("J8_not_exists", "SELECT o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > o_totalprice / 10)")
def _(t):
    return joins.not_exists(t["orders"].star("o", o_totalprice="t"), t["lineitem"].star(None, l_order="o", l_extendedprice="e").select("o", "e"), joins.right("e") > F.col("t") / 10).select("o")


@_query("J8_exists_in_or", "SELECT o_orderkey AS o FROM orders WHERE o_totalprice < 5000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def _(t):
    rows = joins.exists_flag(t["orders"].star("o", o_totalprice="t"), t["lineitem"].star(None, l_order="o", l_quantity="q").where("q > 49").select("o"), "big")
    return rows.where(F.col("big") | (F.col("t") < 5000)).select("o")


_MAYBE = """
WITH a AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey END AS r FROM nation),
b AS (SELECT o_orderkey % 50 AS n, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 5 END AS r FROM orders WHERE o_totalprice > 350000)"""


def _maybe(t):
    left = t["nation"].star("n", n_region="r").withColumn("r", F.when(F.col("n") % 3 > 0, F.col("r")))
    dear = t["orders"].star("o", o_customer="c", o_orderstatus="s", o_totalprice="p").where("p > 350000")
    return left, dear.select((F.col("o") % 50).cast("int").alias("n"), F.when(F.col("s") != "P", (F.col("c") % 5).cast("int")).alias("r"))


@_query("J8_exists_unbound", f"{_MAYBE} SELECT n, r FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.n = a.n AND (a.r IS NULL OR b.r IS NULL OR a.r = b.r))")
def _(t):
    return joins.exists(*_maybe(t), maybe=("r",))


@_query("J8_not_exists_unbound", f"{_MAYBE} SELECT n, r FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.n = a.n AND (a.r IS NULL OR b.r IS NULL OR a.r = b.r))")
def _(t):
    return joins.not_exists(*_maybe(t), maybe=("r",))


@_query("J10_range_filter_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(t):
    return joins.join(t["nation"].star("a", n_region="r"), t["nation"].star("b", n_region="r")).where("a < b").select("a", "b")


# --- paths ---


@_query("X1_link", "SELECT n_nationkey::BIGINT AS a, n_regionkey::BIGINT AS b FROM nation")
def _(t):
    return _keys(paths.link(t["nation"].quads(only=("n_region",)), _p("n_region")))


def _keys(edges: DataFrame) -> DataFrame:
    return edges.select(_key(F.col("a")).alias("a"), _key(F.col("b")).alias("b"))


@_query("X2_inverse", "SELECT n_regionkey::BIGINT AS a, n_nationkey::BIGINT AS b FROM nation")
def _(t):
    return _keys(paths.inverse(paths.link(t["nation"].quads(only=("n_region",)), _p("n_region"))))


def _customer_quads(t):
    return t["customer"].quads(only=("c_nation",)).unionByName(t["nation"].quads(only=("n_region",)))


@_query("X3_seq", "SELECT c_custkey AS a, n_regionkey::BIGINT AS b FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    q = _customer_quads(t)
    return _keys(paths.sequence(paths.link(q, _p("c_nation")), paths.link(q, _p("n_region"))))


@_query("X4_alt", "SELECT c_custkey AS a, c_nationkey::BIGINT AS b FROM customer UNION ALL SELECT n_nationkey, n_regionkey FROM nation")
def _(t):
    q = _customer_quads(t)
    return _keys(paths.alternative(paths.link(q, _p("c_nation")), paths.link(q, _p("n_region"))))


@_query("X5_opt", "SELECT DISTINCT a::BIGINT AS a, b::BIGINT AS b FROM (SELECT n_nationkey AS a, n_regionkey AS b, 1 AS k FROM nation UNION ALL SELECT n_nationkey, n_nationkey, 2 FROM nation UNION ALL SELECT r_regionkey, r_regionkey, 3 FROM region) WHERE k < 4 GROUP BY a, b, k")
def _(t):
    q = t["nation"].quads(only=("n_region",))
    return _keys(paths.zero_or_one(paths.link(q, _p("n_region")), paths.nodes(q))).distinct()


def _chain(t) -> DataFrame:
    """Each order of a customer leads to the customer's next, by key; with the order's status."""
    from pyspark.sql import Window

    rows = t["orders"].star("a", o_customer="c", o_orderstatus="s")
    return rows.withColumn("b", F.lead("a").over(Window.partitionBy("c").orderBy("a"))).where("b IS NOT NULL").select("a", "b", "s")


#: The chain of a customer closes to all pairs of its orders, lower key first, so the SQL needs no recursion.
_LATER = "SELECT x.o_orderkey AS a, y.o_orderkey AS b FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey"


@_query("X6_plus", _LATER)
def _(t):
    return paths.one_or_more(_chain(t).select("a", "b"))


@_query("X6_plus_start", f"{_LATER} WHERE x.o_orderstatus = 'F'")
def _(t):
    edges = _chain(t)
    return paths.one_or_more(edges.select("a", "b"), start=edges.where("s = 'F'").select("a"))


@_query("X6_plus_cycle", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE a.n_nationkey % 5 = b.n_nationkey % 5")
def _(t):
    n = t["nation"].star("a").select("a")
    return paths.one_or_more(n.select("a", ((F.col("a") + 5) % 25).cast("int").alias("b")))


@_query("X7_star", f"WITH c AS ({_LATER}) SELECT a, b FROM c UNION SELECT a, a FROM c UNION SELECT b, b FROM c")
def _(t):
    edges = _chain(t).select("a", "b")
    some = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).distinct()
    return paths.zero_or_more(edges, some)


@_query("X8_nps", "SELECT c_custkey AS a, c_name AS b FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer")
def _(t):
    q = t["customer"].quads(only=("c_name", "c_mktsegment", "c_nation"))
    return paths.negated(q, forward=(_p("c_nation"),)).select(_key(F.col("a")).alias("a"), F.col("b.lex").alias("b"))


@_query("X8_nps_inverse", "SELECT r_name AS a, r_regionkey::BIGINT AS b FROM region")
def _(t):
    q = t["region"].quads(only=("r_name", "a"))
    return paths.negated(q, backward=(A,)).select(F.col("a.lex").alias("a"), _key(F.col("b")).alias("b"))


# --- aggregates ---


@_query("A1_group_expr", "SELECT year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    return agg.group(t["orders"].star("o", o_orderdate="d"), {"y": F.year("d")}, n=agg.count_all())


@_query("A1_unbound_key", "SELECT CASE WHEN p_size > 25 THEN p_brand END AS brand, count(*) AS n FROM part GROUP BY ALL")
def _(t):
    return agg.group(t["part"].star("p", p_size="s", p_brand="b"), {"brand": F.when(F.col("s") > 25, F.col("b"))}, n=agg.count_all())


@_query("A2_implicit_group", "SELECT count(*) AS n, coalesce(sum(l_quantity), 0) AS q FROM lineitem WHERE l_quantity < 0")
def _(t):
    return agg.group(t["lineitem"].star(None, l_quantity="q").where("q < 0"), [], n=agg.count_all(), q=agg.total(F.col("q")))


@_query("A3_count_distinct", "SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY ALL")
def _(t):
    return agg.group(t["orders"].star("o", o_orderstatus="s", o_customer="c"), ["s"], n=agg.count_all(), c=agg.count(F.col("c"), distinct=True))


@_query("A4_count_distinct_star", "SELECT count(*) AS n FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)")
def _(t):
    return agg.group(t["customer"].star("c", c_mktsegment="s", c_nation="k").select("s", "k"), [], n=agg.count_distinct_rows("s", "k"))


@_query("A5_sum", "SELECT l_returnflag AS flag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL")
def _(t):
    return agg.group(t["lineitem"].star(None, l_returnflag="flag", l_quantity="q"), ["flag"], q=agg.total(F.col("q")))


@_query("A5_sum_terms", "SELECT p_brand AS brand, CASE WHEN bool_or(p_size = 50) THEN NULL ELSE sum(p_size) END::BIGINT AS total FROM part GROUP BY ALL")
def _(t):
    rows = t["part"].star("p", p_brand="brand", p_size="size")
    rows = rows.withColumn("v", F.when(F.col("size") == 50, literal("big")).otherwise(integer(F.col("size"))))
    return agg.group(rows, ["brand"], total=agg.total_terms(F.col("v"))).select("brand", F.col("total.lex").cast("bigint").alias("total"))


@_query("A6_avg", "SELECT c_mktsegment AS seg, round(avg(c_acctbal), 4) AS bal FROM customer GROUP BY ALL")
def _(t):
    return agg.group(t["customer"].star("c", c_mktsegment="seg", c_acctbal="b"), ["seg"], bal=F.round(agg.average(F.col("b")), 4))


@_query("A6_avg_empty", "SELECT 0.0::DOUBLE AS bal")
def _(t):
    return agg.group(t["customer"].star("c", c_acctbal="b").where("b > 1e12"), [], bal=agg.average(F.col("b")))


@_query("A7_min_max", "SELECT o_orderstatus AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL")
def _(t):
    return agg.group(t["orders"].star("o", o_orderstatus="s", o_totalprice="p"), ["s"], lo=F.min("p"), hi=F.max("p"))


@_query("A7_min_max_terms", "SELECT n_regionkey AS r, min(n_nationkey)::VARCHAR AS lo, max(n_name) AS hi FROM nation GROUP BY ALL")
def _(t):
    n = t["nation"].star("n", n_region="r", n_name="name")
    mixed = n.select("r", integer(F.col("n")).alias("v")).unionByName(n.select("r", literal(F.col("name")).alias("v")))
    return agg.group(mixed, ["r"], lo=agg.least(F.col("v")), hi=agg.greatest(F.col("v"))).select("r", F.col("lo.lex").alias("lo"), F.col("hi.lex").alias("hi"))


@_query("A8_sample", "SELECT n_regionkey AS r, min(n_name) AS name FROM nation GROUP BY ALL")
def _(t):
    return agg.group(t["nation"].star("n", n_region="r", n_name="name"), ["r"], name=agg.sample(F.col("name")))


@_query("A9_group_concat", "SELECT n_regionkey AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY ALL")
def _(t):
    return agg.group(t["nation"].star("n", n_region="r", n_name="name"), ["r"], names=agg.group_concat(F.col("name"), ", "))


@_query("A9_group_concat_distinct", "SELECT c_nationkey AS n, string_agg(DISTINCT c_mktsegment, ' ' ORDER BY c_mktsegment) AS segs FROM customer GROUP BY ALL")
def _(t):
    return agg.group(t["customer"].star("c", c_nation="n", c_mktsegment="s"), ["n"], segs=agg.group_concat(F.col("s"), distinct=True))


@_query("A10_sum_distinct", "SELECT p_brand AS brand, sum(DISTINCT p_size)::BIGINT AS s, round(avg(DISTINCT p_size), 4) AS a FROM part GROUP BY ALL")
def _(t):
    return agg.group(t["part"].star("p", p_brand="brand", p_size="x"), ["brand"], s=agg.total(F.col("x"), distinct=True), a=F.round(agg.average(F.col("x"), distinct=True), 4))


@_query("A11_having", "SELECT o_custkey AS c, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY ALL HAVING count(*) > 12 AND sum(o_totalprice) > 1000000")
def _(t):
    return agg.group(t["orders"].star("o", o_customer="c", o_totalprice="p"), ["c"], agg.all_of(F.col("n") > 12, F.col("t") > 1000000), n=agg.count_all(), t=F.round(F.sum("p"), 2))


@_query("A14_subselect", "SELECT n_name AS nation, max(n) AS most FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def _(t):
    per = agg.group(t["orders"].star("o", o_customer="c"), ["c"], n=agg.count_all())
    rows = joins.join(joins.join(per, t["customer"].star("c", c_nation="k")), t["nation"].star("k", n_name="nation"))
    return agg.group(rows, ["nation"], most=F.max("n"))


# --- order, slices, sets ---


@_query("O1_order_desc", "SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS pos, c_custkey AS c FROM customer")
def _(t):
    return solutions.placed(t["customer"].star("c", c_acctbal="b"), (F.col("b"), False), (F.col("c"), True)).select("pos", "c")


@_query("O1_order_terms", "SELECT row_number() OVER (ORDER BY k, n, v) AS pos, v FROM (SELECT c_name AS v, 1 AS k, 0 AS n FROM customer UNION ALL SELECT n_nationkey::VARCHAR, 0, n_nationkey FROM nation)")
def _(t):
    rows = t["customer"].star("c", c_name="v").select(literal(F.col("v")).alias("v")).unionByName(t["nation"].star("n").select(integer(F.col("n")).alias("v")))
    return solutions.placed(rows, (F.col("v"), True)).select("pos", F.col("v.lex").alias("v"))


@_query("O2_order_aggregate", "SELECT row_number() OVER (ORDER BY round(t, 2) DESC, c) AS pos, c, t FROM (SELECT o_custkey AS c, sum(o_totalprice) AS t FROM orders GROUP BY ALL)")
def _(t):
    rows = agg.group(t["orders"].star("o", o_customer="c", o_totalprice="p"), ["c"], t=F.sum("p"))
    return solutions.placed(rows, (F.round("t", 2), False), (F.col("c"), True))


@_query("O3_limit_offset", "SELECT p_partkey AS p, p_retailprice AS r FROM part ORDER BY r DESC, p LIMIT 25 OFFSET 10")
def _(t):
    return solutions.cut(solutions.order(t["part"].star("p", p_retailprice="r"), (F.col("r"), False), (F.col("p"), True)), 25, 10)


@_query("O4_top_k", "SELECT l_orderkey AS o, l_extendedprice AS e FROM lineitem ORDER BY e DESC, o LIMIT 40")
def _(t):
    rows = t["lineitem"].star(None, l_order="o", l_extendedprice="e").select("o", "e")
    return solutions.cut(solutions.order(rows, (F.col("e"), False), (F.col("o"), True)), 40)


@_query("O5_distinct_ordered", "SELECT row_number() OVER (ORDER BY b DESC) AS pos, b FROM (SELECT DISTINCT p_brand AS b FROM part)")
def _(t):
    return solutions.placed(solutions.distinct(t["part"].star("p", p_brand="b").select("b")), (F.col("b"), False))


@_query("T1_union", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def _(t):
    return solutions.union(t["customer"].star("c", c_name="name").select("name"), t["supplier"].star("s", s_name="name").select("name"))


@_query("T1_union_schema_mismatch", "SELECT n_name AS x, n_nationkey AS n, NULL AS r FROM nation UNION ALL SELECT r_regionkey::VARCHAR, NULL, r_name FROM region")
def _(t):
    a = t["nation"].star("n", n_name="x")
    b = t["region"].star("x", r_name="r")
    return solutions.union(a, b).select(F.col("x.lex").alias("x"), "n", "r")


@_query("T2_distinct", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem")
def _(t):
    return solutions.distinct(t["lineitem"].star(None, l_returnflag="f", l_linestatus="s").select("f", "s"))


# --- graphs ---


def _graphs(t) -> DataFrame:
    return t["nation"].quads(NS + "g/1").unionByName(t["nation"].quads(NS + "g/2", only=("n_name",))).unionByName(t["region"].quads(NS + "g/2"))


@_query("G1_graph", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def _(t):
    triples = Dataset(_graphs(t)).graph(NS + "g/2")
    return solutions.union(match(triples, var("x"), _p("r_name"), var("name")), match(triples, var("x"), _p("n_name"), var("name"))).select(F.col("name.lex").alias("name"))


@_query("G2_graph_var", "SELECT 'http://ex.org/g/1' AS g, n_name AS name FROM nation UNION ALL SELECT 'http://ex.org/g/2', n_name FROM nation")
def _(t):
    return match(Dataset(_graphs(t)).graphs(), var("x"), _p("n_name"), var("name"), var("g")).select(F.col("g.lex").alias("g"), F.col("name.lex").alias("name"))


@_query("G3_from_named", "SELECT 'http://ex.org/g/2' AS g, r_name AS name FROM region")
def _(t):
    seen = Dataset(_graphs(t), defaults=(NS + "g/1",), named=(NS + "g/2",)).graphs()
    return match(seen, var("x"), _p("r_name"), var("name"), var("g")).select(F.col("g.lex").alias("g"), F.col("name.lex").alias("name"))


@_query("G4_from_merge", "SELECT (SELECT count(*) * 4 FROM nation) + (SELECT count(*) * 2 FROM region) AS n")
def _(t):
    return agg.group(Dataset(_graphs(t), defaults=(NS + "g/1", NS + "g/2")).default(), [], n=agg.count_all())


@_query("G5_outside", "SELECT 0::BIGINT AS n")
def _(t):
    return agg.group(Dataset(_graphs(t), named=(NS + "g/1",)).graph(NS + "g/2"), [], n=agg.count_all())


# --- forms ---


@_query("F2_ask", "SELECT count(*) > 0 AS result FROM orders WHERE o_totalprice > 400000")
def _(t):
    return forms.ask(t["orders"].star("o", o_totalprice="p").where("p > 400000"))


@_query("F3_construct", "SELECT DISTINCT 'http://ex.org/nation/' || n_nationkey AS s, 'http://ex.org/named' AS p, n_name AS o FROM nation UNION SELECT DISTINCT 'http://ex.org/nation/' || n_nationkey, 'http://ex.org/near', 'http://ex.org/region/' || n_regionkey FROM nation")
def _(t):
    rows = t["nation"].star("n", n_name="name", n_region="r").select(t["nation"].subject(F.col("n")).alias("n"), literal(F.col("name")).alias("name"), t["region"].subject(F.col("r")).alias("r"))
    made = forms.construct(rows, (var("n"), _p("named"), var("name")), (var("n"), _p("near"), var("r")), (var("name"), _p("wrong"), var("n")))
    return made.select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"))


@_query("F4_construct_where", "SELECT DISTINCT 'http://ex.org/nation/' || n_nationkey AS s, 'http://ex.org/nation/n_name' AS p, n_name AS o FROM nation")
def _(t):
    pattern = (var("x"), _p("n_name"), var("name"))
    made = forms.construct(match(t["nation"].quads(), *pattern), pattern)
    return made.select(F.col("s.lex").alias("s"), F.concat(F.lit(NS + "nation/"), F.substring_index(F.col("p.lex"), "/", -1)).alias("p"), F.col("o.lex").alias("o"))


@_query("F6_subselect_limit", """
SELECT o_orderkey AS o, c_name AS name FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30) JOIN customer ON c_custkey = o_custkey""")
def _(t):
    top = solutions.cut(solutions.order(t["orders"].star("o", o_customer="c", o_totalprice="p"), (F.col("p"), False), (F.col("o"), True)), 30)
    return joins.join(top.select("o", "c"), t["customer"].star("c", c_name="name")).select("o", "name")


@_query("F8_values_after", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL")
def _(t):
    grouped = agg.group(t["customer"].star("c", c_mktsegment="seg"), ["seg"], n=agg.count_all())
    return joins.join(grouped, solutions.values(t["customer"].df.sparkSession, "seg string", [("BUILDING",), ("MACHINERY",)]))


@_query("F5_describe", "SELECT 'http://ex.org/region/1' AS s, 'http://ex.org/r_name' AS p, r_name AS o FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'http://ex.org/region/1', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://ex.org/Region'")
def _(t):
    quads = t["region"].quads()
    one = quads.where(F.col("s.lex") == NS + "region/1").select("s").limit(1)
    return forms.describe(quads, one).select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"))


# --- updates: what the store holds afterwards ---


def _held(store: Store) -> DataFrame:
    return store.quads.groupBy(F.col("g.lex").alias("g")).agg(F.count("*").alias("n"))


_N = "(SELECT count(*) FROM nation)"
_R = "(SELECT count(*) FROM region)"


def _store(t) -> Store:
    return Store(t["nation"].quads("urn:a", only=("n_name", "n_region")))


def _update(name: str, sql: str):
    def add(f: Callable[[Store, dict[str, Mapped]], Store]):
        _query(name, sql)(lambda t: _held(f(_store(t), t)))
        return f

    return add


@_update("U1_insert", f"SELECT 'urn:a' AS g, {_N} * 2 AS n UNION ALL SELECT 'urn:b', {_R} * 2")
def _(s, t):
    return s.insert(t["region"].quads("urn:b")).insert(t["nation"].quads("urn:a", only=("n_name",)))


@_update("U2_delete", f"SELECT 'urn:a' AS g, {_N} AS n")
def _(s, t):
    return s.delete(t["nation"].quads("urn:a", only=("n_name",)))


@_update("U3_load", f"SELECT 'urn:a' AS g, {_N} * 2 AS n UNION ALL SELECT 'urn:b', {_R}")
def _(s, t):
    return s.load(_written_lines(t, "region", only=("r_name",)), "urn:b")


@_update("U4_modify", f"SELECT 'urn:a' AS g, {_N} * 2 AS n UNION ALL SELECT 'urn:log', {_N}")
def _(s, t):
    found = match(s.quads, var("x"), _p("n_name"), var("name"))
    return s.modify(found, delete=((var("x"), _p("n_name"), var("name")),), insert=((var("x"), _p("label"), var("name")),), graph="urn:a").modify(match(s.quads, var("x"), _p("label"), var("name")), insert=((var("x"), _p("seen"), var("name")),), graph="urn:log")


@_update("U5_delete_where", f"SELECT 'urn:a' AS g, {_N} AS n")
def _(s, t):
    pattern = (var("x"), _p("n_region"), var("r"))
    return s.modify(match(s.quads, *pattern), delete=(pattern,), graph="urn:a")


@_update("U6_create", f"SELECT 'urn:a' AS g, {_N} * 2 AS n")
def _(s, t):
    return s.create("urn:new").create("urn:a", silent=True)


@_update("U7_drop", f"SELECT 'urn:a' AS g, {_N} * 2 AS n")
def _(s, t):
    return s.insert(t["region"].quads("urn:b")).drop("urn:b").drop("urn:none", silent=True)


@_update("U8_clear_all", "SELECT NULL::VARCHAR AS g, 0::BIGINT AS n WHERE false")
def _(s, t):
    return s.insert(t["region"].quads("urn:b")).clear_all()


@_update("U9_add", f"SELECT 'urn:a' AS g, {_N} * 2 AS n UNION ALL SELECT 'urn:b', {_N} * 2 + {_R} * 2")
def _(s, t):
    return s.insert(t["region"].quads("urn:b")).add("urn:a", "urn:b")


@_update("U10_copy", f"SELECT 'urn:a' AS g, {_N} * 2 AS n UNION ALL SELECT 'urn:b', {_N} * 2")
def _(s, t):
    return s.insert(t["region"].quads("urn:b")).copy("urn:a", "urn:b")


@_update("U10_move", f"SELECT 'urn:b' AS g, {_N} * 2 AS n")
def _(s, t):
    return s.insert(t["region"].quads("urn:b")).move("urn:a", "urn:b")


@_update("F7_sequence", f"SELECT 'urn:c' AS g, {_N} * 2 AS n UNION ALL SELECT 'urn:d', {_R} * 2")
def _(s, t):
    return s.insert(t["region"].quads("urn:b")).copy("urn:a", "urn:c").move("urn:b", "urn:d").drop("urn:a")


@_update("G6_using", f"SELECT 'urn:a' AS g, {_N} * 2 AS n UNION ALL SELECT 'urn:b', {_R} * 2 UNION ALL SELECT 'urn:names', {_N} + {_R}")
def _(s, t):
    s = s.insert(t["region"].quads("urn:b"))
    seen = Dataset(s.quads, defaults=("urn:a", "urn:b")).default()
    names = solutions.union(match(seen, var("x"), _p("n_name"), var("name")), match(seen, var("x"), _p("r_name"), var("name")))
    return s.modify(names, insert=((var("x"), _p("label"), var("name")),), graph="urn:names")


@_update("U11_silent", f"SELECT 'urn:a' AS g, {_N} * 2 AS n")
def _(s, t):
    return s.load("/none/such.nt", silent=True).add("urn:none", "urn:b", silent=True).move("urn:none", "urn:b", silent=True).clear("urn:none", silent=True)


# --- scalar functions, on columns of terms ---


def _scalar(name: str, table: str, key: str, make: Callable[[DataFrame], object], sql: str | None):
    """``k`` and the function's lexical value over a whole table."""

    def run(t):
        df = t[table].df
        return df.select(F.col(key).alias("k"), make(df)["lex"].alias("v"))

    _query(name, sql and f"SELECT {key} AS k, {sql} AS v FROM {table}")(run)


_text = lambda: literal(F.col("p_name"))
_lang = lambda: literal(F.col("text"), None, F.col("lang"))
_size = lambda: integer(F.col("p_size"))
_price = lambda: decimal(F.col("p_retailprice").cast("decimal(38,12)"))
_date = lambda: date_time(F.col("o_orderdate"))
_s = lambda x: literal(F.lit(x))
_i = lambda x: integer(F.lit(x))
_b = lambda x: f"CASE WHEN {x} THEN 'true' WHEN NOT ({x}) THEN 'false' END"
_error = lambda: literal(F.lit(None).cast("string"))



def _digests(name: str) -> str:
    """Digests that DuckDB has no function for, of every part size, as Python makes them."""
    return "CASE p_size " + " ".join(f"WHEN {k} THEN '{hashlib.new(name, str(k).encode()).hexdigest()}'" for k in range(1, 101)) + " END"


for _name, _make, _sql in [
    ("E1_or", lambda: fn.or_(fn.gt(_size(), _i(25)), fn.eq(_text(), _error())), "CASE WHEN p_size > 25 THEN 'true' END"),
    ("E2_and", lambda: fn.and_(fn.gt(_size(), _i(25)), fn.eq(_text(), _error())), "CASE WHEN p_size <= 25 THEN 'false' END"),
    ("E3_not", lambda: fn.not_(fn.gt(_size(), _i(25))), _b("p_size <= 25")),
    ("E4_eq", lambda: fn.eq(_size(), double(F.lit(7.0))), _b("p_size = 7")),
    ("E5_ne", lambda: fn.ne(_size(), _i(7)), _b("p_size <> 7")),
    ("E6_lt", lambda: fn.lt(_price(), _size()), _b("p_retailprice < p_size")),
    ("E7_gt", lambda: fn.gt(_text(), _s("part_5")), _b("p_name > 'part_5'")),
    ("E8_le", lambda: fn.le(_size(), _i(9)), _b("p_size <= 9")),
    ("E9_ge", lambda: fn.ge(_size(), _i(9)), _b("p_size >= 9")),
    ("E10_in", lambda: fn.in_(_size(), _i(1), _i(2), _s("3")), _b("p_size IN (1, 2)")),
    ("E11_not_in", lambda: fn.not_in(_size(), _i(1), _i(2)), _b("p_size NOT IN (1, 2)")),
    ("E12_same_term", lambda: fn.same_term(_size(), integer(F.col("p_partkey"))), _b("p_size = p_partkey")),
    ("E13_bound", lambda: fn.bound(F.when(F.col("p_size") > 10, _size())), _b("p_size > 10")),
    ("E14_if", lambda: fn.if_(fn.gt(_size(), _i(25)), _s("big"), _s("small")), "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END"),
    ("E15_coalesce", lambda: fn.coalesce(F.when(F.col("p_size") > 10, _size()), _s("none")), "CASE WHEN p_size > 10 THEN p_size::VARCHAR ELSE 'none' END"),
    ("M1_add", lambda: fn.add(_size(), _i(5)), "(p_size + 5)::VARCHAR"),
    ("M1_subtract", lambda: fn.subtract(_size(), _i(30)), "(p_size - 30)::VARCHAR"),
    ("M1_multiply", lambda: fn.multiply(_size(), _size()), "(p_size * p_size)::VARCHAR"),
    ("M2_divide", lambda: fn.divide(fn.multiply(_size(), _i(3)), _i(4)), "CASE p_size * 3 % 4 WHEN 0 THEN (p_size * 3 // 4) || '.0' WHEN 1 THEN (p_size * 3 // 4) || '.25' WHEN 2 THEN (p_size * 3 // 4) || '.5' ELSE (p_size * 3 // 4) || '.75' END"),
    ("M2_divide_by_zero", lambda: fn.divide(fn.multiply(_size(), fn.subtract(_size(), _i(7))), fn.subtract(_size(), _i(7))), "CASE WHEN p_size <> 7 THEN p_size || '.0' END"),
    ("M3_negate", lambda: fn.negate(_size()), "(-p_size)::VARCHAR"),
    ("M4_abs", lambda: fn.abs_(fn.subtract(_size(), _i(30))), "abs(p_size - 30)::VARCHAR"),
    ("M5_ceil", lambda: fn.ceil(fn.divide(_size(), _i(4))), "ceil(p_size / 4.0)::BIGINT || '.0'"),
    ("M5_floor", lambda: fn.floor(fn.divide(_size(), _i(4))), "floor(p_size / 4.0)::BIGINT || '.0'"),
    ("M6_round", lambda: fn.round_(fn.divide(fn.negate(_size()), _i(2))), "floor(-p_size / 2.0 + 0.5)::BIGINT || '.0'"),
    ("M8_is_numeric", lambda: fn.is_numeric_(F.when(F.col("p_size") > 10, _size()).otherwise(_text())), _b("p_size > 10")),
    ("N1_str", lambda: fn.str_(_size()), "p_size::VARCHAR"),
    ("N2_strlen", lambda: fn.strlen(_text()), "length(p_name)::VARCHAR"),
    ("N3_substr", lambda: fn.substr(_text(), _i(3), _i(4)), "substr(p_name, 3, 4)"),
    ("N3_substr_before", lambda: fn.substr(_text(), _i(-1), _i(5)), "substr(p_name, 1, 3)"),
    ("N4_ucase", lambda: fn.ucase(_text()), "upper(p_name)"),
    ("N4_lcase", lambda: fn.lcase(literal(F.col("p_brand"))), "lower(p_brand)"),
    ("N5_strstarts", lambda: fn.strstarts(_text(), _s("part_1")), _b("starts_with(p_name, 'part_1')")),
    ("N6_strends", lambda: fn.strends(_text(), _s("1")), _b("p_name LIKE '%1'")),
    ("N7_contains", lambda: fn.contains(_text(), _s("12")), _b("contains(p_name, '12')")),
    ("N8_strbefore", lambda: fn.strbefore(_text(), _s("1")), "CASE WHEN contains(p_name, '1') THEN substr(p_name, 1, instr(p_name, '1') - 1) ELSE '' END"),
    ("N9_strafter", lambda: fn.strafter(_text(), _s("1")), "CASE WHEN contains(p_name, '1') THEN substr(p_name, instr(p_name, '1') + 1) ELSE '' END"),
    ("N11_concat", lambda: fn.concat(_text(), _s("-"), literal(F.col("p_brand"))), "p_name || '-' || p_brand"),
    ("N12_replace", lambda: fn.replace(_text(), _s("[0-4]+"), _s("<$0>")), r"regexp_replace(p_name, '([0-4]+)', '<\1>', 'g')"),
    ("N13_regex", lambda: fn.regex(_text(), _s("^PART.*[37]$"), "i"), _b("regexp_matches(p_name, '(?i)^part.*[37]$')")),
    ("N14_encode_for_uri", lambda: fn.encode_for_uri(fn.concat(_text(), _s(" *~é/"))), "replace(p_name, ' ', '%20') || '%20%2A~%C3%A9%2F'"),
    ("N17_datatype", lambda: fn.datatype(F.when(F.col("p_size") > 10, _size()).otherwise(_text())), f"CASE WHEN p_size > 10 THEN '{XSD}integer' ELSE '{STRING}' END"),
    ("N18_strdt", lambda: fn.datatype(fn.strdt(fn.str_(_size()), iri(XSD + "byte"))), f"'{XSD}byte'"),
    ("N18_strlang", lambda: fn.lang(fn.strlang(_text(), _s("de"))), "'de'"),
    ("N19_iri", lambda: fn.iri_(fn.concat(_s("x/"), _text()), "http://ex.org/base/doc"), "'http://ex.org/base/x/' || p_name"),
    ("N21_is_iri", lambda: fn.is_iri(fn.iri_(_text(), NS)), "'true'"),
    ("N22_is_literal", lambda: fn.is_literal(_text()), "'true'"),
    ("N22_is_blank", lambda: fn.is_blank(fn.bnode_(F.col("p_partkey"), _text())), "'true'"),
    ("D6_md5", lambda: fn.md5(_text()), "md5(p_name)"),
    ("D6_sha1", lambda: fn.sha1(_text()), "sha1(p_name)"),
    ("D6_sha256", lambda: fn.sha(_text(), 256), "sha256(p_name)"),
    ("D6_sha512", lambda: fn.sha(fn.str_(_size()), 512), _digests("sha512")),
    ("D7_sha384", lambda: fn.sha(fn.str_(_size()), 384), _digests("sha384")),
    ("C1_string", lambda: fn.to_string(_size()), "p_size::VARCHAR"),
    ("C2_double", lambda: fn.to_double(fn.str_(_size())), "p_size || '.0'"),
    ("C2_float", lambda: fn.to_float(_size()), "p_size || '.0'"),
    ("C3_decimal", lambda: fn.to_decimal(_s("1e3")), "NULL::VARCHAR"),
    ("C4_integer", lambda: fn.to_integer(fn.divide(_size(), _i(4))), "(p_size // 4)::VARCHAR"),
    ("C6_boolean", lambda: fn.to_boolean(fn.subtract(_size(), _i(7))), _b("p_size <> 7")),
    ("M7_rand", lambda: fn.rand(), None),
    ("N20_bnode", lambda: fn.bnode_(F.col("p_partkey"), _text()), None),
    ("D1_now", lambda: fn.now(), None),
    ("D9_uuid", lambda: fn.uuid(), None),
    ("D9_struuid", lambda: fn.struuid(), None),
]:
    _scalar(_name, "part", "p_partkey", (lambda make: lambda df: make())(_make), _sql)

_zoned = lambda: literal(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".25"), F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 3 == 1, "-05:30").otherwise("")), DATETIME)
for _name, _make, _sql in [
    ("D2_year", lambda: fn.year(_zoned()), "year(o_orderdate)::VARCHAR"),
    ("D2_month", lambda: fn.month(_zoned()), "month(o_orderdate)::VARCHAR"),
    ("D2_day", lambda: fn.day(_zoned()), "day(o_orderdate)::VARCHAR"),
    ("D2_hours", lambda: fn.hours(_zoned()), "hour(o_orderdate)::VARCHAR"),
    ("D2_minutes", lambda: fn.minutes(_zoned()), "minute(o_orderdate)::VARCHAR"),
    ("D3_seconds", lambda: fn.seconds(_zoned()), "second(o_orderdate) || '.25'"),
    ("D4_tz", lambda: fn.tz(_zoned()), "CASE o_orderkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '-05:30' ELSE '' END"),
    ("D5_timezone", lambda: fn.timezone(_zoned()), "CASE o_orderkey % 3 WHEN 0 THEN 'PT0S' WHEN 1 THEN '-PT5H30M' END"),
    ("C5_date_time", lambda: fn.to_date_time(fn.str_(_date())), "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"),
    ("E6_lt_date", lambda: fn.lt(_date(), literal("1996-01-01T00:00:00", DATETIME)), _b("o_orderdate < TIMESTAMP '1996-01-01'")),
]:
    _scalar(_name, "orders", "o_orderkey", (lambda make: lambda df: make())(_make), _sql)

for _name, _make, _sql in [
    ("N10_compatible", lambda: fn.contains(_lang(), literal(F.lit("die"), None, F.lit("de"))), "CASE WHEN lang = 'de' AND text IS NOT NULL THEN CASE WHEN contains(text, 'die') THEN 'true' ELSE 'false' END END"),
    ("N15_lang", lambda: fn.lang(_lang()), "CASE WHEN text IS NOT NULL THEN coalesce(lang, '') END"),
    ("N16_langmatches", lambda: fn.langmatches(fn.lang(_lang()), _s("DE")), "CASE WHEN text IS NOT NULL THEN CASE WHEN lang = 'de' THEN 'true' ELSE 'false' END END"),
]:
    _scalar(_name, "documents", "doc_id", (lambda make: lambda df: make())(_make), _sql)


@_query("C7_user_function", "SELECT p_partkey AS k, (p_size * 2 + 1)::BIGINT AS v FROM part")
def _(t):
    fn.register("urn:twice-and-one", lambda x: fn.add(fn.multiply(x, integer(F.lit(2))), integer(F.lit(1))))
    rows = t["part"].star("k", p_size="s")
    return rows.select("k", number(fn.call("urn:twice-and-one", integer(F.col("s")))).cast("bigint").alias("v"))


def headline(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities by return flag of lines with a small discount: one scan of three columns."""
    return QUERIES["S1_scan"](spark, folder)


