"""Solutions as CSV, TSV, JSON, XML and text tables, and back from JSON and XML.

``write_results`` writes whole files by the executors. The functions that give one string are for what a client reads
at once: they take a number of solutions that they refuse to exceed.
"""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.sources.rdf import render
from triplane.terms import BNODE, IRI, LITERAL, lift, term
from triplane.written import discard, written


def as_terms(df: DataFrame) -> DataFrame:
    return df.select(*(lift(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def _lexical(df: DataFrame) -> DataFrame:
    return df.select(*(lift(F.col(f"`{f.name}`"), f.dataType)["lex"].alias(f.name) for f in df.schema))


def _csv(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike(r'[",\n\r]'), quoted).otherwise(text), F.lit(""))


def csv_lines(df: DataFrame) -> DataFrame:
    """Lexical values, quoted where they must be; unbound is empty. ``value`` is a record each."""
    return _lexical(df).select(F.concat_ws(",", *(_csv(F.col(f"`{c}`")) for c in df.columns)).alias("value"))


def tsv_lines(df: DataFrame) -> DataFrame:
    """Terms as N-Triples writes them; unbound is empty. The head of such a file is ``?a<TAB>?b``."""
    return as_terms(df).select(F.concat_ws("\t", *(F.coalesce(render(F.col(f"`{c}`"), ascii_only=False), F.lit("")) for c in df.columns)).alias("value"))


def _binding(t: Column) -> Column:
    kind = F.when(t["kind"] == IRI, "uri").when(t["kind"] == BNODE, "bnode").when(t["kind"] == LITERAL, "literal")
    return F.when(t.isNotNull(), F.struct(kind.alias("type"), t["lex"].alias("value"), t["lang"].alias("xml:lang"), t["dt"].alias("datatype")))


def json_lines(df: DataFrame) -> DataFrame:
    """A JSON object for each solution, as it stands among the bindings; unbound variables are left out."""
    return as_terms(df).select(F.to_json(F.struct(*(_binding(F.col(f"`{c}`")).alias(c) for c in df.columns))).alias("value"))


def _marked(text: Column) -> Column:
    """Text as it stands in XML, in attributes too; a carriage return is a reference, as readers would change it."""
    for c, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(c), F.lit(mark))
    return text


def xml_lines(df: DataFrame) -> DataFrame:
    """A ``result`` element for each solution; unbound variables are left out."""

    def binding(name: str) -> Column:
        t = F.col(f"`{name}`")
        attribute = lambda key, c: F.coalesce(F.concat(F.lit(f' {key}="'), _marked(c), F.lit('"')), F.lit(""))
        tag = F.when(t["kind"] == IRI, "uri").when(t["kind"] == BNODE, "bnode").otherwise("literal")
        opened = F.concat(F.lit("<"), tag, attribute("xml:lang", t["lang"]), attribute("datatype", t["dt"]), F.lit(">"))
        return F.when(t.isNotNull(), F.concat(F.lit(f"<binding name={quoteattr(name)}>"), opened, _marked(t["lex"]), F.lit("</"), tag, F.lit("></binding>")))

    return as_terms(df).select(F.concat_ws("", F.lit("<result>"), *(binding(c) for c in df.columns), F.lit("</result>")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


XML_HEAD = '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n'


def _frame(kind: str, names: list[str]) -> tuple[str, str]:
    """What stands before and after the solutions."""
    if kind == "csv":
        return ",".join(names), ""
    if kind == "tsv":
        return "\t".join(f"?{c}" for c in names), ""
    if kind == "json":
        return f'{{"head":{json.dumps({"vars": names})},"results":{{"bindings":[', "]}}"
    variables = "".join(f"<variable name={quoteattr(c)}/>" for c in names)
    return f"{XML_HEAD}<head>{variables}</head>\n<results>", "</results>\n</sparql>"


def write_results(df: DataFrame, path: str, kind: str) -> None:
    """``csv``, ``tsv``, ``json`` or ``xml`` files in the folder ``path``, whose concatenation by name is one document.

    The head and the end are rows of their own before and behind the solutions, so all is written by the executors.
    """
    lines = {"csv": csv_lines, "tsv": tsv_lines, "json": json_lines, "xml": xml_lines}[kind](df)
    head, end = (df.sparkSession.createDataFrame([(x,)], "value string").coalesce(1) for x in _frame(kind, df.columns))
    rows = None
    if kind == "json":  # a comma before each but the first, which the least number tells
        rows = written(lines.withColumn("id", F.monotonically_increasing_id()), "bindings")
        first = rows.agg(F.min("id")).first()[0]
        lines = rows.orderBy("id").select(F.when(F.col("id") == F.lit(first), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    whole = head.unionByName(lines)
    write_lines(whole.unionByName(end) if kind in ("json", "xml") else whole, path)
    if rows is not None:
        discard(rows)


def _document(df: DataFrame, kind: str, rows: int) -> str:
    lines = {"csv": csv_lines, "tsv": tsv_lines, "json": json_lines, "xml": xml_lines}[kind](df)
    found = [r[0] for r in lines.limit(rows + 1).collect()]
    if len(found) > rows:
        raise ValueError(f"more than {rows} solutions: write them with write_results")
    head, end = _frame(kind, df.columns)
    if kind == "json":
        return head + ",".join(found) + end
    return "".join(f"{x}\n" for x in (head, *found, *([end] if end else [])))


#: Most solutions that one string may hold.
ROWS = 100_000


def to_csv(df: DataFrame, rows: int = ROWS) -> str:
    return _document(df, "csv", rows)


def to_tsv(df: DataFrame, rows: int = ROWS) -> str:
    return _document(df, "tsv", rows)


def to_json(df: DataFrame, rows: int = ROWS) -> str:
    """A one-column table ``result`` of booleans, as ask() gives, is a boolean result."""
    if df.columns == ["result"] and df.schema[0].dataType.simpleString() == "boolean":
        return json.dumps({"head": {}, "boolean": df.first()[0]})
    return _document(df, "json", rows)


def to_xml(df: DataFrame, rows: int = ROWS) -> str:
    if df.columns == ["result"] and df.schema[0].dataType.simpleString() == "boolean":
        return f"{XML_HEAD}<head></head>\n<boolean>{str(df.first()[0]).lower()}</boolean>\n</sparql>\n"
    return _document(df, "xml", rows)


def to_table(df: DataFrame, rows: int = 100, prefixes: dict[str, str] | None = None, numbers: bool = False) -> str:
    """A text table of at most ``rows`` solutions; IRIs shorten to ``prefix:rest`` where a prefix fits."""
    shown = as_terms(df).select(*(render(F.col(f"`{c}`"), ascii_only=False).alias(c) for c in df.columns)).limit(rows).collect()

    def short(x: str | None) -> str:
        for name, start in (prefixes or {}).items():
            if x and x.startswith("<" + start):
                return f"{name}:{x[len(start) + 1 : -1]}"
        return x or ""

    head = (["#"] if numbers else []) + df.columns
    body = [([str(i)] if numbers else []) + [short(x) for x in row] for i, row in enumerate(shown, 1)]
    width = [max(len(r[k]) for r in [head, *body]) for k in range(len(head))]
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, width)) + " |"
    bar = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    return "\n".join([bar, line(head), bar, *map(line, body), bar]) + "\n"


#: Media types by writer.
WRITERS = {"text/csv": to_csv, "text/tab-separated-values": to_tsv, "application/sparql-results+json": to_json, "application/sparql-results+xml": to_xml, "text/plain": to_table}


def serialize(df: DataFrame, accept: str = "text/plain") -> tuple[str, str]:
    """(media type, text) in the writer that an Accept header likes best."""
    wanted = []
    for i, part in enumerate(accept.split(",")):
        kind, *params = [x.strip() for x in part.split(";")]
        q = next((float(p[2:]) for p in params if p.startswith("q=")), 1.0)
        wanted.append((-q, i, kind))
    for q, _, kind in sorted(wanted):
        for media, writer in WRITERS.items():
            if q and (kind in (media, "*/*") or kind.endswith("/*") and media.startswith(kind[:-1])):
                return media, writer(df)
    raise ValueError(f"no writer for {accept}")


def read_json(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """JSON result files -> solutions of the named variables.

    A file of one binding a line, as ``write_results`` gives them, is read line by line, in as many tasks as it has
    splits. Any other is one JSON value without lines to split at, so a task reads it whole: keep such files small.
    """
    one = "struct<type:string,value:string,`xml:lang`:string,datatype:string>"
    schema = f"struct<results:struct<bindings:array<struct<{','.join(f'`{v}`:{one}' for v in variables)}>>>>"
    split = spark.read.text(path).where(F.col("value").rlike(r'^,?\{(?:"[^"]*":\{"type"|\}$)'))
    if not split.isEmpty():
        rows = split.select(F.from_json(F.regexp_replace("value", "^,", ""), f"struct<{','.join(f'`{v}`:{one}' for v in variables)}>").alias("b"))
    else:
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["results"]["bindings"]).alias("b"))

    def back(b: Column) -> Column:
        kind = F.when(b["type"] == "uri", IRI).when(b["type"] == "bnode", BNODE).otherwise(LITERAL)
        return F.when(b["value"].isNotNull(), term(0, b["value"], b["datatype"], b["xml:lang"]).withField("kind", kind.cast("tinyint")))

    return rows.select(*(back(F.col("b")[v]).alias(v) for v in variables))


def read_xml(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """An XML result file -> solutions of the named variables."""
    schema = "binding array<struct<_name:string,uri:string,bnode:string,literal:struct<_VALUE:string,_datatype:string,`_xml:lang`:string>>>"
    rows = spark.read.format("xml").option("rowTag", "result").schema(schema).load(path)

    def back(name: str) -> Column:
        b = F.get(F.filter("binding", lambda x: x["_name"] == name), F.lit(0))
        return F.coalesce(term(IRI, b["uri"]), term(BNODE, b["bnode"]), term(LITERAL, F.when(b.isNotNull(), F.coalesce(b["literal"]["_VALUE"], F.lit(""))), b["literal"]["_datatype"], b["literal"]["_xml:lang"]))

    return rows.select(*(F.when(F.size("binding") > 0, back(v)).alias(v) for v in variables))
