"""RDF terms as struct columns, for variables that may hold any kind of term.

Where a variable always holds one kind of value, keep the native column: it joins, sorts and aggregates natively, and
:func:`lift` makes terms of it where the two meet. NULL is an unbound variable, and the value of an expression in error.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IRI, BNODE, LITERAL = 0, 1, 2
TERM = "struct<kind:tinyint,lex:string,dt:string,lang:string>"
#: Namespaces and datatypes of XML Schema and RDF.
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
INTEGER, DECIMAL, FLOAT, DOUBLE = XSD + "integer", XSD + "decimal", XSD + "float", XSD + "double"
BOOLEAN, STRING, DATETIME, DURATION = XSD + "boolean", XSD + "string", XSD + "dateTime", XSD + "dayTimeDuration"
LANGSTRING, TYPE = RDF + "langString", RDF + "type"
#: Integer types derived from xsd:integer.
INTEGERS = tuple(XSD + t for t in (
    "integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger",
    "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte",
))
NUMERIC = (*INTEGERS, DECIMAL, FLOAT, DOUBLE)
EXACT = "decimal(38,12)"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` mentions it."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def once(f):
    """Makes a function bind its longer arguments first, so that nested calls grow in their sum and not their product."""

    @wraps(f)
    def run(*args, **named):
        for i, a in enumerate(args):
            if isinstance(a, Column) and len(str(a)) > 400:
                return let(a, lambda v: run(*args[:i], v, *args[i + 1 :], **named))  # noqa: B023
        return f(*args, **named)

    return run


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def term(kind: int, lex, dt=None, lang=None) -> Column:
    """A term; NULL where ``lex`` is."""
    lex = _col(lex).cast("string")
    if len(str(lex)) > 400:
        return let(lex, lambda v: term(kind, v, dt, lang))
    made = F.struct(F.lit(kind).cast("tinyint").alias("kind"), lex.alias("lex"), _col(dt).cast("string").alias("dt"), _col(lang).cast("string").alias("lang"))
    return F.when(lex.isNotNull(), made)


def iri(x) -> Column:
    return term(IRI, x)


def bnode(x) -> Column:
    return term(BNODE, x)


def literal(x, dt: str | None = None, lang=None) -> Column:
    return term(LITERAL, x, dt, lang)


def boolean(x: Column) -> Column:
    return literal(x.cast("string"), BOOLEAN)


@once
def integer(x: Column) -> Column:
    return literal(x.cast("bigint"), INTEGER)


@once
def canonical_decimal(x: Column) -> Column:
    """Decimal text without trailing zeros: 2.50 -> 2.5, 2.00 -> 2.0."""
    text = x.cast(EXACT).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", ".0")


@once
def decimal(x: Column) -> Column:
    return literal(canonical_decimal(x), DECIMAL)


@once
def double(x: Column, dt: str = DOUBLE) -> Column:
    text = F.when(F.isnan(x), "NaN").when(x == float("inf"), "INF").when(x == float("-inf"), "-INF").otherwise(x.cast("string"))
    return literal(text, dt)


@once
def date_time(x: Column) -> Column:
    return literal(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), DATETIME)


def lift(x: Column, kind: T.DataType) -> Column:
    """A native column as terms; a term column as it is."""
    if isinstance(kind, T.StructType):
        return x
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return integer(x)
    if isinstance(kind, T.DecimalType):
        return decimal(x)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return double(x, FLOAT if isinstance(kind, T.FloatType) else DOUBLE)
    if isinstance(kind, T.BooleanType):
        return boolean(x)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return date_time(x)
    return literal(x)


def lex(t: Column) -> Column:
    return t["lex"]


def is_plain(t: Column) -> Column:
    """A string without language."""
    return (t["kind"] == LITERAL) & t["lang"].isNull() & (t["dt"].isNull() | (t["dt"] == STRING))


def is_text(t: Column) -> Column:
    """A string, with or without language."""
    return (t["kind"] == LITERAL) & (t["dt"].isNull() | (t["dt"] == STRING))


@once
def is_numeric(t: Column) -> Column:
    return (t["kind"] == LITERAL) & F.coalesce(t["dt"].isin(*NUMERIC), F.lit(False)) & number(t).isNotNull()


def rank(t: Column) -> Column:
    """1 integer, 2 decimal, 3 float, 4 double; NULL for other terms."""
    return F.when(t["dt"].isin(*INTEGERS), 1).when(t["dt"] == DECIMAL, 2).when(t["dt"] == FLOAT, 3).when(t["dt"] == DOUBLE, 4)


_PLAIN_NUMBER, _ANY_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$", r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


@once
def number(t: Column) -> Column:
    """The value as double; NULL where it is not a sound number."""
    lex = t["lex"]
    special = F.when(lex.isin("INF", "+INF"), float("inf")).when(lex == "-INF", float("-inf")).when(lex == "NaN", float("nan"))
    sound = F.when(rank(t) <= 2, lex.rlike(_PLAIN_NUMBER)).when(rank(t) >= 3, lex.rlike(_ANY_NUMBER))
    return F.when(rank(t).isNotNull(), F.when(sound, lex.try_cast("double")).when(rank(t) >= 3, special))


@once
def exact(t: Column) -> Column:
    """The value of an integer or decimal as decimal; NULL for others."""
    return F.when((rank(t) <= 2) & t["lex"].rlike(_PLAIN_NUMBER), t["lex"].try_cast(EXACT))


@once
def instant(t: Column) -> Column:
    """A dateTime as a timestamp; without a time zone it counts as UTC."""
    sound = (t["dt"] == DATETIME) & t["lex"].rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$")
    zoned = F.when(t["lex"].rlike(r"(Z|[+-]\d\d:\d\d)$"), t["lex"]).otherwise(F.concat(t["lex"], F.lit("Z")))
    return F.when(sound, zoned.try_cast("timestamp"))


@once
def truth(t: Column) -> Column:
    """A boolean literal's value."""
    return F.when(t["dt"] == BOOLEAN, F.when(t["lex"].isin("true", "1"), True).when(t["lex"].isin("false", "0"), False))


@once
def ebv(t: Column) -> Column:
    """Effective boolean value; NULL is an error."""
    n = number(t)
    return F.when(t["kind"] != LITERAL, F.lit(None)).when(t["dt"] == BOOLEAN, F.coalesce(truth(t), F.lit(False))).when(is_text(t), t["lex"] != "").when(
        rank(t).isNotNull(), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False))
    )


def order_keys(t: Column) -> list[Column]:
    """Keys that sort terms: unbound, blank nodes, IRIs, literals; numbers by value, then times, then text."""
    kind = F.when(t.isNull(), 0).when(t["kind"] == BNODE, 1).when(t["kind"] == IRI, 2).when(rank(t).isNotNull(), 3).when(t["dt"] == DATETIME, 4).otherwise(5)
    return [kind, number(t), instant(t), t["lex"], t["lang"], t["dt"]]
