"""Turtle files. The syntax carries prefixes and blank nodes through a file, so a task reads a file whole: many files are
read side by side, but a single very large graph is better kept as N-Triples."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.terms import BNODE, BOOLEAN, DECIMAL, DOUBLE, INTEGER, IRI, LITERAL, RDF, TERM, TYPE

#: Tokens as the Turtle recommendation defines them.
_PART = r"(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])"
_TOKENS = re.compile(
    r"""(?P<space>(?:\s|\#[^\n]*)+)
    |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<long>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3})
    |(?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |@(?P<at>[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |_:(?P<blank>\w(?:[\w.\-·]*[\w\-·])?)
    |(?P<double>[+-]?(?:\d+(?:\.\d*)?|\.\d+)[eE][+-]?\d+)
    |(?P<decimal>[+-]?\d*\.\d+)
    |(?P<integer>[+-]?\d+)
    |(?P<name>(?:[^\W\d_](?:[\w.\-·]*[\w\-·])?)?:(?:(?!-)PART(?:PART|\.(?=\.*PART))*)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\]()])""".replace("PART", _PART),
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
Term = tuple[int, str, str | None, str | None]


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[3] is None else _PLAIN.get(m[3], m[3]), text)


class _Reader:
    """One pass over a file; statements are kept as (subject, predicate, object)."""

    def __init__(self, text: str, base: str, scope: str):
        self.text, self.base, self.scope, self.prefixes = text, base, scope, {}
        self.at, self.fresh, self.out = 0, 0, []
        self.advance()

    def advance(self) -> None:
        while True:
            m = _TOKENS.match(self.text, self.at)
            if m is None and self.at < len(self.text):
                raise ValueError(f"not Turtle: {self.text[self.at : self.at + 80]!r}")
            self.kind, self.value = (m.lastgroup, m[m.lastgroup]) if m else ("end", "")
            self.at = m.end() if m else self.at
            if self.kind != "space":
                return

    def take(self, kind: str, value: str | None = None) -> str:
        if self.kind != kind or value is not None and self.value != value:
            raise ValueError(f"{value or kind} expected before {self.text[self.at - len(self.value) : self.at + 60]!r}")
        found = self.value
        self.advance()
        return found

    def iri(self) -> str:
        if self.kind == "iri":
            return urljoin(self.base, _unescaped(self.take("iri")[1:-1])) if self.base else _unescaped(self.take("iri")[1:-1])
        prefix, _, local = self.take("name").partition(":")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def blank(self, label: str | None = None) -> Term:
        self.fresh += label is None
        return BNODE, f"{self.scope}b_{label}" if label else f"{self.scope}a_{self.fresh}", None, None

    def statements(self) -> list[tuple[Term, Term, Term]]:
        while self.kind != "end":
            word = self.value.lower() if self.kind in ("at", "word") else ""
            if word in ("prefix", "base"):
                marked = self.kind == "at"
                self.advance()
                if word == "prefix":
                    name = self.take("name")
                    self.prefixes[name[:-1]] = self.iri()
                else:
                    self.base = self.iri()
                if marked:
                    self.take("mark", ".")
                continue
            listed = self.kind == "mark" and self.value == "["
            subject = self.term()
            if not (listed and self.value == "."):
                self.properties(subject)
            self.take("mark", ".")
        return self.out

    def properties(self, subject: Term) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                self.advance()
                predicate = TYPE
            else:
                predicate = self.iri()
            while True:
                self.out.append((subject, (IRI, predicate, None, None), self.term()))
                if self.value != "," or self.kind != "mark":
                    break
                self.advance()
            if self.value != ";" or self.kind != "mark":
                return
            while self.kind == "mark" and self.value == ";":
                self.advance()
            if self.kind == "mark":
                return

    def term(self) -> Term:
        kind = self.kind
        if kind in ("iri", "name"):
            return IRI, self.iri(), None, None
        if kind == "blank":
            return self.blank(self.take("blank"))
        if kind in ("integer", "decimal", "double"):
            return LITERAL, self.take(kind), {"integer": INTEGER, "decimal": DECIMAL, "double": DOUBLE}[kind], None
        if kind == "word" and self.value in ("true", "false"):
            return LITERAL, self.take("word"), BOOLEAN, None
        if kind in ("text", "long"):
            cut = 1 if kind == "text" else 3
            text = _unescaped(self.take(kind)[cut:-cut])
            if self.kind == "at":
                return LITERAL, text, None, self.take("at")
            if self.kind == "type":
                self.advance()
                return LITERAL, text, self.iri(), None
            return LITERAL, text, None, None
        if self.value == "[":
            self.advance()
            node = self.blank()
            if self.value != "]":
                self.properties(node)
            self.take("mark", "]")
            return node
        self.take("mark", "(")
        items = []
        while not (self.kind == "mark" and self.value == ")"):
            items.append(self.term())
        self.advance()
        rest: Term = (IRI, RDF + "nil", None, None)
        for item in reversed(items):
            node = self.blank()
            self.out += [(node, (IRI, RDF + "first", None, None), item), (node, (IRI, RDF + "rest", None, None), rest)]
            rest = node
        return rest


def read_turtle(spark: SparkSession, path: str | list[str], scope: str = "", base: str | None = None) -> DataFrame:
    """Turtle files, folders or globs -> ``s, p, o, g`` with g NULL; equal triples of a file count once.

    ``base``: what relative IRIs stand against, the file's own IRI if not given. Blank nodes are those of their file:
    their labels begin with ``scope`` and a hash of the file's name. A file that is no Turtle fails the query.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["value"]):
                own = f"{scope}t{hashlib.md5(file.encode()).hexdigest()[:12]}_"
                found = _Reader(text, base if base is not None else file, own).statements()
                for at in range(0, len(found), 10_000):
                    flat = [[x for t in triple for x in t] for triple in found[at : at + 10_000]]
                    yield pd.DataFrame(flat, columns=[f"{place}_{part}" for place in "spo" for part in ("kind", "lex", "dt", "lang")]).astype(object)

    schema = ", ".join(f"{place}_kind tinyint, {place}_lex string, {place}_dt string, {place}_lang string" for place in "spo")
    rows = files.mapInPandas(run, schema)
    made = [F.struct(*(F.col(f"{place}_{part}").alias(part) for part in ("kind", "lex", "dt", "lang"))).alias(place) for place in "spo"]
    return rows.select(*made, F.lit(None).cast(TERM).alias("g")).dropDuplicates()
