"""Functions on terms: values, errors and the datatypes of results."""

import hashlib

import pytest
from pyspark.sql import functions as F

import triplane.functions as fn
from triplane.terms import BOOLEAN, DATETIME, DECIMAL, DOUBLE, INTEGER, XSD, bnode, ebv, iri, literal

i = lambda x: literal(F.lit(str(x)), INTEGER)
d = lambda x: literal(F.lit(x), DECIMAL)
f = lambda x: literal(F.lit(x), DOUBLE)
s = lambda x, lang=None: literal(F.lit(x), None, F.lit(lang)) if lang else literal(F.lit(x))
t = lambda x: literal(F.lit(x), DATETIME)
odd = lambda x: literal(F.lit(x), "urn:odd")
null = lambda: literal(F.lit(None).cast("string"))
TRUE, FALSE = ("true", BOOLEAN), ("false", BOOLEAN)

CASES = {
    "add": (lambda: fn.add(i(2), i(3)), ("5", INTEGER)),
    "add decimal": (lambda: fn.add(i(2), d("0.50")), ("2.5", DECIMAL)),
    "add double": (lambda: fn.add(d("1.5"), f("1e0")), ("2.5", DOUBLE)),
    "add text": (lambda: fn.add(i(2), s("3")), None),
    "sound numbers only": (lambda: fn.add(i(2), literal(F.lit("x"), INTEGER)), None),
    "divide": (lambda: fn.divide(i(1), i(4)), ("0.25", DECIMAL)),
    "divide by zero": (lambda: fn.divide(i(1), i(0)), None),
    "divide by floating zero": (lambda: fn.divide(f("1"), f("0")), ("INF", DOUBLE)),
    "zero by zero": (lambda: fn.divide(f("0"), f("0")), ("NaN", DOUBLE)),
    "round half up": (lambda: fn.round_(d("-2.5")), ("-2.0", DECIMAL)),
    "ceil": (lambda: fn.ceil(d("1.2")), ("2.0", DECIMAL)),
    "floor of double": (lambda: fn.floor(f("-1.5")), ("-2.0", DOUBLE)),
    "eq across types": (lambda: fn.eq(i(1), d("1.0")), TRUE),
    "eq of unknown types": (lambda: fn.eq(odd("a"), odd("b")), None),
    "eq of the same unknown": (lambda: fn.eq(odd("a"), odd("a")), TRUE),
    "eq of iri and text": (lambda: fn.eq(iri("a"), s("a")), FALSE),
    "eq by language": (lambda: fn.eq(s("a", "EN"), s("a", "en")), TRUE),
    "ne": (lambda: fn.ne(s("a"), s("b")), TRUE),
    "eq of instants": (lambda: fn.eq(t("2020-01-01T00:00:00Z"), t("2020-01-01T01:00:00+01:00")), TRUE),
    "lt of text and number": (lambda: fn.lt(s("a"), i(1)), None),
    "in with an error": (lambda: fn.in_(i(1), i(2), null()), None),
    "in past an error": (lambda: fn.in_(i(1), null(), i(1)), TRUE),
    "or past an error": (lambda: fn.or_(null(), fn.eq(i(1), i(1))), TRUE),
    "and with an error": (lambda: fn.and_(null(), fn.eq(i(1), i(1))), None),
    "not an error": (lambda: fn.not_(null()), None),
    "if with an error": (lambda: fn.if_(null(), i(1), i(2)), None),
    "substr": (lambda: fn.substr(s("motor car"), i(6)), (" car", None)),
    "substr from before": (lambda: fn.substr(s("12345"), i(0), i(3)), ("12", None)),
    "substr of nothing": (lambda: fn.substr(s("12345"), i(6), i(3)), ("", None)),
    "strlen in code points": (lambda: fn.strlen(s("a😀")), ("2", INTEGER)),
    "strbefore": (lambda: fn.lang(fn.strbefore(s("abc", "en"), s("b"))), ("en", None)),
    "strbefore at the start": (lambda: fn.lang(fn.strbefore(s("abc", "en"), s(""))), ("en", None)),
    "strbefore of none": (lambda: fn.lang(fn.strbefore(s("abc", "en"), s("z"))), ("", None)),
    "strafter": (lambda: fn.strafter(s("abc"), s("b")), ("c", None)),
    "strends at the end only": (lambda: fn.strends(s("abcab"), s("ab")), TRUE),
    "starts with nothing": (lambda: fn.strstarts(s("a"), s("")), TRUE),
    "languages that do not fit": (lambda: fn.contains(s("a", "en"), s("a", "de")), None),
    "regex flags": (lambda: fn.regex(s("A\nb"), s("a.B"), "is"), TRUE),
    "replace": (lambda: fn.replace(s("abab"), s("B"), s("[$0]"), "i"), ("a[b]a[b]", None)),
    "encode": (lambda: fn.encode_for_uri(s("a b*~/é")), ("a%20b%2A~%2F%C3%A9", None)),
    "langmatches at a border": (lambda: fn.langmatches(s("eng"), s("en")), FALSE),
    "langmatches a range": (lambda: fn.langmatches(s("en-GB"), s("EN")), TRUE),
    "langmatches any": (lambda: fn.langmatches(s(""), s("*")), FALSE),
    "concat keeps a language": (lambda: fn.lang(fn.concat(s("a", "en"), s("b", "en"))), ("en", None)),
    "concat loses it": (lambda: fn.lang(fn.concat(s("a", "en"), s("b"))), ("", None)),
    "year": (lambda: fn.year(t("2011-01-10T14:45:13.815-05:00")), ("2011", INTEGER)),
    "hours in the own zone": (lambda: fn.hours(t("2011-01-10T04:45:13.815-05:00")), ("4", INTEGER)),
    "seconds": (lambda: fn.seconds(t("2011-01-10T14:45:13.815-05:00")), ("13.815", DECIMAL)),
    "tz": (lambda: fn.tz(t("2011-01-10T14:45:13+01:00")), ("+01:00", None)),
    "timezone": (lambda: fn.timezone(t("2011-01-10T14:45:13-05:00")), ("-PT5H", XSD + "dayTimeDuration")),
    "no timezone": (lambda: fn.timezone(t("2011-01-10T14:45:13")), None),
    "sha384": (lambda: fn.sha(s("abc"), 384), (hashlib.sha384(b"abc").hexdigest(), None)),
    "integer of decimal": (lambda: fn.to_integer(d("-3.7")), ("-3", INTEGER)),
    "integer of text": (lambda: fn.to_integer(s("3.7")), None),
    "double of spaces": (lambda: fn.to_double(s(" 7 ")), ("7.0", DOUBLE)),
    "decimal of exponent": (lambda: fn.to_decimal(s("1e3")), None),
    "boolean of number": (lambda: fn.to_boolean(f("0.0")), FALSE),
    "dateTime of text": (lambda: fn.to_date_time(s("2011-13-10T14:45:13")), None),
    "iri of a relative": (lambda: fn.iri_(s("x"), "http://e.org/a/b"), ("http://e.org/a/x", None)),
    "datatype of a language": (lambda: fn.datatype(s("a", "en")), ("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", None)),
    "str of a blank node": (lambda: fn.str_(bnode("b")), None),
}


@pytest.fixture(scope="module")
def results(spark):
    one = spark.range(1)
    names = list(CASES)
    out = {}
    for start in range(0, len(names), 12):
        part = names[start : start + 12]
        row = one.select(*(CASES[n][0]().alias(str(k)) for k, n in enumerate(part))).first()
        out.update(zip(part, row))
    return out


@pytest.mark.parametrize("name", list(CASES))
def test_function(results, name):
    got, want = results[name], CASES[name][1]
    assert (None if got is None else (got["lex"], got["dt"])) == want


def test_truth(spark):
    row = spark.range(1).select(*(ebv(x).alias(str(k)) for k, x in enumerate((s(""), s("a"), i(0), f("NaN"), literal(F.lit("x"), INTEGER), iri("a"), odd("a"))))).first()
    assert list(row) == [False, True, False, False, False, None, None]


def test_nesting_stays_small(spark):
    x = i(1)
    for _ in range(12):
        x = fn.add(x, i(1))
    assert spark.range(1).select(x["lex"]).first()[0] == "13"
