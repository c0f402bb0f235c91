"""N-Triples and N-Quads: one statement a line, so files are read and written by all executors, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.terms import BNODE, IRI, LITERAL, STRING, bnode, iri, term

_IRI, _BNODE = r"<([^<>\"{}|^`\x00-\x20]*)>", r"_:([^\s<\"]+?)"
_TEXT = r'"((?:[^"\\\n\r]|\\.)*)"'
_LINE = rf"^\s*(?:{_IRI}|{_BNODE})\s+{_IRI}\s+(?:{_IRI}|{_BNODE}|{_TEXT}(?:\^\^{_IRI}|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)\s*(?:{_IRI}|{_BNODE})?\s*\.\s*(?:#.*)?$"
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescape(text: Column) -> Column:
    def plain(piece: Column) -> Column:
        code = F.substr(piece, F.lit(3))
        out = F.when(F.startswith(piece, F.lit("\\U")), F.decode(F.unhex(code), "UTF-32")).when(F.startswith(piece, F.lit("\\u")), F.decode(F.unhex(F.concat(F.lit("0000"), code)), "UTF-32"))
        for mark, c in _ESCAPES.items():
            out = out.when(piece == "\\" + mark, c)
        return out.when(F.startswith(piece, F.lit("\\")), F.substr(piece, F.lit(2))).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\U[0-9A-Fa-f]{8}|\\u[0-9A-Fa-f]{4}|\\.|[^\\]+"), F.lit(0))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, plain), "")).otherwise(text)


def escape(text: Column, ascii_only: bool = True) -> Column:
    for c, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(c), F.lit(mark))
    if not ascii_only:
        return text

    def plain(piece: Column) -> Column:
        code = F.hex(F.encode(piece, "UTF-32"))
        return F.when(piece.rlike(r"^[\x00-\x7F]"), piece).when(F.startswith(code, F.lit("0000")), F.concat(F.lit("\\u"), F.substr(code, F.lit(5)))).otherwise(F.concat(F.lit("\\U"), code))

    pieces = F.regexp_extract_all(text, F.lit(r"(?s)[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(pieces, plain), "")).otherwise(text)


def parse_lines(lines: DataFrame, scope: str = "", strict: bool = True) -> DataFrame:
    """``value`` -> ``s, p, o, g``; g is NULL in triples. ``scope`` goes before blank node labels, to keep loads apart.

    Empty lines and comments are passed over. Another line that is no statement fails the query, or is left out if not
    ``strict``.
    """
    line = F.col("value")
    rows = lines.where(~line.rlike(r"^\s*(#.*)?$")).withColumn("ok", line.rlike(_LINE))
    checked = rows.where("ok") if not strict else rows.where(F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), F.substring(line, 1, 200))).cast("boolean")))
    part = lambda i: F.regexp_extract(line, _LINE, i)
    names = ("s_iri", "s_b", "p", "o_iri", "o_b", "text", "dt", "lang", "g_iri", "g_b")
    cut = checked.select(line.alias("value"), *(part(i + 1).alias(n) for i, n in enumerate(names)))
    is_text = F.col("value").rlike(rf"^\s*(?:{_IRI}|{_BNODE})\s+{_IRI}\s+\"")
    label = lambda c: bnode(F.concat(F.lit(scope), F.col(c)))
    has = lambda c: F.col(c) != ""
    o = F.when(is_text, term(LITERAL, unescape(F.col("text")), F.when(has("dt") & (F.col("dt") != STRING), unescape(F.col("dt"))), F.when(has("lang"), F.col("lang")))).when(has("o_b"), label("o_b")).otherwise(iri(unescape(F.col("o_iri"))))
    return cut.select(
        F.when(has("s_b"), label("s_b")).otherwise(iri(unescape(F.col("s_iri")))).alias("s"),
        iri(unescape(F.col("p"))).alias("p"),
        o.alias("o"),
        F.when(has("g_b"), label("g_b")).when(has("g_iri"), iri(unescape(F.col("g_iri")))).alias("g"),
    )


def read_rdf(spark: SparkSession, path: str | list[str], scope: str = "", strict: bool = True) -> DataFrame:
    """N-Triples or N-Quads files, folders or globs, compressed or not; equal statements count once."""
    return parse_lines(spark.read.text(path), scope, strict).dropDuplicates()


def read_any(spark: SparkSession, path: str, scope: str = "", syntax: str | None = None) -> DataFrame:
    """As :func:`read_rdf`, or Turtle where ``syntax`` or the name's ending says so."""
    if syntax == "turtle" or syntax is None and path.endswith((".ttl", ".turtle")):
        from triplane.sources.turtle import read_turtle

        return read_turtle(spark, path, scope)
    return read_rdf(spark, path, scope)


def load(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """``[{"file": ..., "graph": ..., "syntax": ...}]`` -> quads; a file's blank nodes are its own, its triples go to ``graph``."""
    out = None
    for i, source in enumerate(sources):
        rows = read_any(spark, source["file"], f"f{i}_", source.get("syntax"))
        rows = rows.withColumn("g", F.coalesce("g", iri(source.get("graph", "urn:x-default"))))
        out = rows if out is None else out.unionByName(rows)
    return out.dropDuplicates()


def render(t: Column, ascii_only: bool = True) -> Column:
    """A term as N-Triples writes it."""
    text = F.concat(F.lit('"'), escape(t["lex"], ascii_only), F.lit('"'))
    text = F.when(t["lang"].isNotNull(), F.concat(text, F.lit("@"), t["lang"])).when(t["dt"].isNotNull() & (t["dt"] != STRING), F.concat(text, F.lit("^^<"), t["dt"], F.lit(">"))).otherwise(text)
    return F.when(t["kind"] == IRI, F.concat(F.lit("<"), escape(t["lex"], ascii_only), F.lit(">"))).when(t["kind"] == BNODE, F.concat(F.lit("_:"), t["lex"])).otherwise(text)


def statements(rows: DataFrame, ascii_only: bool = True) -> DataFrame:
    """``s, p, o`` and, if there, ``g`` -> ``value``, a line each."""
    places = [c for c in ("s", "p", "o", "g") if c in rows.columns]
    return rows.select(F.concat_ws(" ", *(render(F.col(c), ascii_only) for c in places), F.lit(".")).alias("value"))


def write_rdf(rows: DataFrame, path: str, ascii_only: bool = True, compression: str | None = None) -> None:
    statements(rows, ascii_only).write.text(path, compression=compression)
