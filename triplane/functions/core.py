from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from triplane.terms import (
    BNODE, DATETIME, DECIMAL, DOUBLE, DURATION, FLOAT, IRI, LANGSTRING, LITERAL, STRING,
    bnode, boolean, canonical_decimal, decimal, double, ebv, exact, instant, integer, iri, is_numeric, is_plain, is_text, literal, number, once, rank, truth,
)

# --- logic; three-valued as Spark's own: NULL is an error ---


def or_(a: Column, b: Column) -> Column:
    return boolean(ebv(a) | ebv(b))


def and_(a: Column, b: Column) -> Column:
    return boolean(ebv(a) & ebv(b))


def not_(a: Column) -> Column:
    return boolean(~ebv(a))


def _same(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & (a["lex"] == b["lex"]) & a["dt"].eqNullSafe(b["dt"]) & a["lang"].eqNullSafe(b["lang"])


def _equal(a: Column, b: Column) -> Column:
    """Equality of values: NULL where the datatypes do not tell."""
    known = lambda t: is_text(t) | truth(t).isNotNull() | instant(t).isNotNull()
    literals = (
        F.when(is_numeric(a) & is_numeric(b), F.coalesce(exact(a) == exact(b), number(a) == number(b)))
        .when(is_text(a) & is_text(b), (a["lex"] == b["lex"]) & F.lower(a["lang"]).eqNullSafe(F.lower(b["lang"])))
        .when(truth(a).isNotNull() & truth(b).isNotNull(), truth(a) == truth(b))
        .when(instant(a).isNotNull() & instant(b).isNotNull(), instant(a) == instant(b))
        .when(_same(a, b), True)
        .when((known(a) | is_numeric(a)) & (known(b) | is_numeric(b)), False)
    )
    return F.when(a.isNull() | b.isNull(), None).when((a["kind"] == LITERAL) & (b["kind"] == LITERAL), literals).otherwise((a["kind"] == b["kind"]) & (a["lex"] == b["lex"]))


def eq(a: Column, b: Column) -> Column:
    return boolean(_equal(a, b))


def ne(a: Column, b: Column) -> Column:
    return boolean(~_equal(a, b))


def _less(a: Column, b: Column, or_equal: bool) -> Column:
    less = (lambda x, y: x <= y) if or_equal else (lambda x, y: x < y)
    return (
        F.when(is_numeric(a) & is_numeric(b), F.coalesce(less(exact(a), exact(b)), less(number(a), number(b))))
        .when(is_plain(a) & is_plain(b), less(a["lex"], b["lex"]))
        .when(truth(a).isNotNull() & truth(b).isNotNull(), less(truth(a), truth(b)))
        .when(instant(a).isNotNull() & instant(b).isNotNull(), less(instant(a), instant(b)))
    )


def lt(a: Column, b: Column) -> Column:
    return boolean(_less(a, b, False))


def le(a: Column, b: Column) -> Column:
    return boolean(_less(a, b, True))


def gt(a: Column, b: Column) -> Column:
    return boolean(_less(b, a, False))


def ge(a: Column, b: Column) -> Column:
    return boolean(_less(b, a, True))


def in_(a: Column, *others: Column) -> Column:
    return boolean(reduce(lambda x, y: x | y, (_equal(a, b) for b in others), F.lit(False)))


def not_in(a: Column, *others: Column) -> Column:
    return boolean(~truth(in_(a, *others)))


def same_term(a: Column, b: Column) -> Column:
    return boolean(F.when(a.isNotNull() & b.isNotNull(), _same(a, b)))


def bound(a: Column) -> Column:
    return boolean(a.isNotNull())


def if_(c: Column, a: Column, b: Column) -> Column:
    return F.when(ebv(c), a).when(~ebv(c), b)


coalesce = F.coalesce

# --- arithmetic: integer < decimal < float < double ---


def _arithmetic(a: Column, b: Column, whole, real) -> Column:
    kind = F.greatest(rank(a), rank(b))
    value = real(number(a), number(b))
    made = F.when(kind == 1, whole(exact(a), exact(b), integer)).when(kind == 2, whole(exact(a), exact(b), decimal)).when(kind == 3, double(value, FLOAT)).otherwise(double(value))
    return F.when(is_numeric(a) & is_numeric(b), made)


def add(a: Column, b: Column) -> Column:
    return _arithmetic(a, b, lambda x, y, t: t(F.try_add(x, y)), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _arithmetic(a, b, lambda x, y, t: t(F.try_subtract(x, y)), lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return _arithmetic(a, b, lambda x, y, t: t(F.try_multiply(x, y)), lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Integers give a decimal; an exact zero divisor is an error, a floating one gives INF or NaN."""
    x, y = number(a), number(b)
    real = F.when(y != 0, F.try_divide(x, y)).when(F.isnan(x) | F.isnan(y) | (x == 0), float("nan")).otherwise(F.when(x > 0, float("inf")).otherwise(float("-inf")))
    return _arithmetic(a, b, lambda p, q, _: decimal(F.try_divide(p, q)), lambda p, q: real)


def negate(a: Column) -> Column:
    return subtract(integer(F.lit(0)), a)


def _unary(a: Column, whole, real) -> Column:
    kind = rank(a)
    made = F.when(kind == 1, integer(whole(exact(a)))).when(kind == 2, decimal(whole(exact(a)))).when(kind == 3, double(real(number(a)), FLOAT)).otherwise(double(real(number(a))))
    return F.when(is_numeric(a), made)


def _whole(f):
    """Of doubles: what is not finite stays as it is, as do sizes that have no fraction."""
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(f(x).cast("double"))


def abs_(a: Column) -> Column:
    return _unary(a, F.abs, F.abs)


def ceil(a: Column) -> Column:
    return _unary(a, F.ceil, _whole(F.ceil))


def floor(a: Column) -> Column:
    return _unary(a, F.floor, _whole(F.floor))


def round_(a: Column) -> Column:
    """Halves go up: -2.5 gives -2."""
    half = F.lit("0.5").cast("decimal(2,1)")
    return _unary(a, lambda x: F.floor(x + half), _whole(lambda x: F.floor(x + 0.5)))


def rand() -> Column:
    return double(F.rand())


# --- strings ---


def _as(t: Column, lex: Column) -> Column:
    """A string of the same language and datatype."""
    return F.when(is_text(t), literal(lex, t["dt"], t["lang"]))


def _fits(a: Column, b: Column) -> Column:
    """Two strings may meet if the second has no language or that of the first."""
    return is_text(a) & is_text(b) & (b["lang"].isNull() | F.lower(a["lang"]).eqNullSafe(F.lower(b["lang"])))


def str_(t: Column) -> Column:
    return F.when(t["kind"] != BNODE, literal(t["lex"]))


def strlen(t: Column) -> Column:
    return F.when(is_text(t), integer(F.length(t["lex"])))


def substr(t: Column, start: Column, length: Column | None = None) -> Column:
    """Positions from 1; what lies outside the text is cut off."""
    first = F.floor(number(start) + 0.5)
    end = F.length(t["lex"]) + 1 if length is None else first + F.floor(number(length) + 0.5)
    begin = F.greatest(first, F.lit(1))
    return _as(t, F.when(begin < end, F.substr(t["lex"], begin.cast("int"), F.least(end - begin, F.length(t["lex"])).cast("int"))).when(first.isNotNull() & end.isNotNull(), ""))


def ucase(t: Column) -> Column:
    return _as(t, F.upper(t["lex"]))


def lcase(t: Column) -> Column:
    return _as(t, F.lower(t["lex"]))


def strstarts(a: Column, b: Column) -> Column:
    return F.when(_fits(a, b), boolean(F.startswith(a["lex"], b["lex"])))


def strends(a: Column, b: Column) -> Column:
    return F.when(_fits(a, b), boolean(F.endswith(a["lex"], b["lex"])))


def contains(a: Column, b: Column) -> Column:
    return F.when(_fits(a, b), boolean(F.contains(a["lex"], b["lex"])))


def strbefore(a: Column, b: Column) -> Column:
    at = F.position(b["lex"], a["lex"])
    return F.when(_fits(a, b), F.when(at == 0, literal("")).otherwise(_as(a, F.substr(a["lex"], F.lit(1), at - 1))))


def strafter(a: Column, b: Column) -> Column:
    at = F.position(b["lex"], a["lex"])
    return F.when(_fits(a, b), F.when(at == 0, literal("")).otherwise(_as(a, F.substr(a["lex"], at + F.length(b["lex"])))))


def concat(*ts: Column) -> Column:
    """The common language or datatype stays."""
    lang = reduce(lambda x, y: F.when(x == y, x), (F.lower(t["lang"]) for t in ts))
    dt = reduce(lambda x, y: F.when(x == y, x), (t["dt"] for t in ts))
    sound = reduce(lambda x, y: x & y, (is_text(t) for t in ts))
    return F.when(sound, literal(F.concat(*(t["lex"] for t in ts)), dt, F.when(lang.isNotNull(), ts[0]["lang"])))


def _flagged(pattern: Column, flags: str) -> Column:
    if "q" in flags:
        pattern = F.concat(F.lit(r"\Q"), pattern, F.lit(r"\E"))
    kept = "".join(f for f in flags if f in "ismx")
    return F.concat(F.lit(f"(?{kept})" if kept else ""), pattern)


def regex(t: Column, pattern: Column, flags: str = "") -> Column:
    return F.when(is_text(t) & is_plain(pattern), boolean(F.rlike(t["lex"], _flagged(pattern["lex"], flags))))


def replace(t: Column, pattern: Column, put: Column, flags: str = "") -> Column:
    return F.when(is_plain(pattern) & is_plain(put), _as(t, F.regexp_replace(t["lex"], _flagged(pattern["lex"], flags), put["lex"])))


def encode_for_uri(t: Column) -> Column:
    coded = F.url_encode(t["lex"])
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return F.when(is_text(t), literal(coded))


def lang(t: Column) -> Column:
    return F.when(t["kind"] == LITERAL, literal(F.coalesce(t["lang"], F.lit(""))))


def langmatches(tag: Column, wanted: Column) -> Column:
    a, b = F.lower(tag["lex"]), F.lower(wanted["lex"])
    return F.when(is_plain(tag) & is_plain(wanted), boolean(F.when(b == "*", a != "").otherwise((a == b) | F.startswith(a, F.concat(b, F.lit("-"))))))


def datatype(t: Column) -> Column:
    return F.when(t["kind"] == LITERAL, iri(F.when(t["lang"].isNotNull(), LANGSTRING).otherwise(F.coalesce(t["dt"], F.lit(STRING)))))


def strdt(t: Column, kind: Column) -> Column:
    return F.when(is_plain(t) & (kind["kind"] == IRI), F.when(t["lex"].isNotNull(), literal(t["lex"], kind["lex"])))


def strlang(t: Column, tag: Column) -> Column:
    return F.when(is_plain(t) & is_plain(tag), literal(t["lex"], None, tag["lex"]))


def iri_(t: Column, base: str = "") -> Column:
    """An IRI as it is, or of a string; a relative one after the folder of ``base``."""
    folder = base.rsplit("/", 1)[0] + "/" if "/" in base else base
    full = F.when(t["lex"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t["lex"]).when(F.startswith(t["lex"], F.lit("#")), F.concat(F.lit(base.split("#")[0]), t["lex"])).otherwise(F.concat(F.lit(folder), t["lex"]))
    return F.when(t["kind"] == IRI, t).when(is_plain(t), iri(full))


def bnode_(row_id: Column, t: Column | None = None) -> Column:
    """A blank node: the same text in the same row gives the same node, so pass what tells the rows apart."""
    tail = F.lit("new") if t is None else F.hex(F.xxhash64(t["lex"]))
    return F.when(F.lit(True) if t is None else is_plain(t), bnode(F.concat(F.lit("b"), row_id.cast("string"), F.lit("x"), tail)))


def is_iri(t: Column) -> Column:
    return boolean(t["kind"] == IRI)


def is_literal(t: Column) -> Column:
    return boolean(t["kind"] == LITERAL)


def is_blank(t: Column) -> Column:
    return boolean(t["kind"] == BNODE)


def is_numeric_(t: Column) -> Column:
    return boolean(F.when(t.isNotNull(), is_numeric(t)))


# --- time, hashes, identifiers ---

_ZONE = r"(Z|[+-]\d\d:\d\d)$"


def now() -> Column:
    """One instant for the whole query."""
    return literal(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), DATETIME)


def _field(t: Column, start: int, length: int) -> Column:
    """A field of the text itself, and so in the literal's own time zone."""
    return F.when(instant(t).isNotNull(), integer(F.substring(t["lex"], start, length).try_cast("int")))


def year(t: Column) -> Column:
    return F.when(instant(t).isNotNull(), integer(F.regexp_extract(t["lex"], r"^(-?\d+)-", 1).try_cast("int")))


def month(t: Column) -> Column:
    return _field(t, 6, 2)


def day(t: Column) -> Column:
    return _field(t, 9, 2)


def hours(t: Column) -> Column:
    return _field(t, 12, 2)


def minutes(t: Column) -> Column:
    return _field(t, 15, 2)


def seconds(t: Column) -> Column:
    return F.when(instant(t).isNotNull(), decimal(F.regexp_extract(t["lex"], r":(\d\d(\.\d+)?)(Z|[+-]\d\d:\d\d)?$", 1).try_cast("decimal(38,12)")))


def tz(t: Column) -> Column:
    return F.when(instant(t).isNotNull(), literal(F.regexp_extract(t["lex"], _ZONE, 1)))


def timezone(t: Column) -> Column:
    """The offset as a duration; an error where there is none."""
    zone = F.regexp_extract(t["lex"], _ZONE, 1)
    h, m = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    parts = F.concat(F.when(F.startswith(zone, F.lit("-")), "-").otherwise(""), F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    lex = F.when((zone == "Z") | ((h == 0) & (m == 0)), "PT0S").otherwise(parts)
    return F.when(instant(t).isNotNull() & (zone != ""), literal(lex, DURATION))


def md5(t: Column) -> Column:
    return F.when(is_plain(t), literal(F.md5(t["lex"].cast("binary"))))


def sha1(t: Column) -> Column:
    return F.when(is_plain(t), literal(F.sha1(t["lex"].cast("binary"))))


def sha(t: Column, bits: int) -> Column:
    """bits: 256, 384 or 512."""
    return F.when(is_plain(t), literal(F.sha2(t["lex"].cast("binary"), bits)))


def uuid() -> Column:
    return iri(F.concat(F.lit("urn:uuid:"), F.uuid()))


def struuid() -> Column:
    return literal(F.uuid())


# --- casts ---


def _source(t: Column) -> Column:
    return F.trim(t["lex"])


def to_string(t: Column) -> Column:
    return F.when(t["kind"] != BNODE, literal(t["lex"], STRING))


def to_double(t: Column, dt: str = DOUBLE) -> Column:
    lex = _source(t)
    of = F.when(is_numeric(t), number(t)).when(truth(t).isNotNull(), truth(t).cast("double")).when(is_plain(t), number(literal(lex, DOUBLE)))
    return double(of, dt)


def to_float(t: Column) -> Column:
    return to_double(t, FLOAT)


def to_decimal(t: Column) -> Column:
    of = F.when(rank(t) <= 2, exact(t)).when(is_numeric(t), number(t).try_cast("decimal(38,12)")).when(truth(t).isNotNull(), truth(t).cast("int").cast("decimal(38,12)")).when(is_plain(t), exact(literal(_source(t), DECIMAL)))
    return literal(canonical_decimal(of), DECIMAL)


def to_integer(t: Column) -> Column:
    """Numbers lose their fraction; a string must be an integer."""
    of = F.when(rank(t) <= 2, F.when(exact(t) < 0, F.ceil(exact(t))).otherwise(F.floor(exact(t))).try_cast("bigint")).when(
        is_numeric(t), F.when(F.isnan(number(t)) | (F.abs(number(t)) == float("inf")), None).otherwise(number(t).try_cast("bigint"))
    ).when(truth(t).isNotNull(), truth(t).cast("bigint")).when(is_plain(t) & _source(t).rlike(r"^[+-]?\d+$"), _source(t).try_cast("bigint"))
    return integer(of)


def to_date_time(t: Column) -> Column:
    made = literal(_source(t), DATETIME)
    return F.when((is_plain(t) | (t["dt"] == DATETIME)) & instant(made).isNotNull(), made)


def to_boolean(t: Column) -> Column:
    lex = _source(t)
    of = F.when(truth(t).isNotNull(), truth(t)).when(is_numeric(t), (number(t) != 0) & ~F.isnan(number(t))).when(is_plain(t), F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False))
    return boolean(of)




for _name, _function in list(globals().items()):
    if getattr(_function, "__module__", "") == __name__ and not _name.startswith("_") and callable(_function):
        globals()[_name] = once(_function)
del _name, _function
