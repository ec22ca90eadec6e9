"""Turtle: a parser, a Python data source and a reader of many files as triples and prefixes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.terms import RDF, XSD

SCHEMA = "graph_id string, row string, seq long, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dtype string"
NAME = r"[^\W\d_]|[\u00b7\u0300-\u036f]"
LOCAL = r"(?:[\w:\-.\u00b7]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])"
TOKEN = re.compile(
    r"""(?P<space>(?:\s+|\#[^\n\r]*)+)
    |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|(?i:prefix|base)(?=\s+(?:[\w.\-]*:\s*)?<))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<blank>_:[\w](?:[\w.\-\u00b7]*[\w\-\u00b7])?)
    |(?P<double>[+-]?(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)
    |(?P<decimal>[+-]?\d*\.\d+)
    |(?P<integer>[+-]?\d+(?![\w:]))
    |(?P<name>(?:[^\W\d_](?:[\w.\-\u00b7]*[\w\-\u00b7])?)?:(?:""" + LOCAL + r"""*(?:[\w:\-\u00b7]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]))?)
    |(?P<word>true\b|false\b|a(?![\w:]))
    |(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TurtleError(ValueError):
    pass


def unescape(text: str) -> str:
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        x = m.group(1)
        return chr(int(x[1:], 16)) if x[0] in "uU" else ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


class Parser:
    """One document. Terms are (kind, text, lang, dtype); triples keep document order; names follow the binding in force."""

    def __init__(self, text: str, graph_id: str = "", base: str = ""):
        self.text, self.graph_id, self.base = text.lstrip("\ufeff"), graph_id, base
        self.names: dict[str, str] = {}
        self.prefixes: list[tuple[str, str]] = []
        self.triples: list[tuple] = []
        self.count, self.labels = 0, {}
        self.at, self.kind, self.token = 0, "", ""
        self.advance()

    def advance(self) -> None:
        while True:
            if self.at >= len(self.text):
                self.kind, self.token = "end", ""
                return
            m = TOKEN.match(self.text, self.at)
            if not m:
                line = self.text.count("\n", 0, self.at) + 1
                raise TurtleError(f"line {line}: unexpected {self.text[self.at:self.at + 20]!r}")
            self.at = m.end()
            if m.lastgroup != "space":
                self.kind, self.token = m.lastgroup, m.group()
                return

    def fail(self, wanted: str):
        line = self.text.count("\n", 0, self.at) + 1
        raise TurtleError(f"line {line}: {wanted} wanted, found {self.token!r}")

    def expect(self, mark: str) -> None:
        if self.token != mark or self.kind != "mark":
            self.fail(mark)
        self.advance()

    def new_blank(self) -> tuple:
        self.count += 1
        return "bnode", f"_:{self.graph_id}#b{self.count}", None, None

    def iri(self) -> str:
        if self.kind == "iri":
            x = urljoin(self.base, y) if (y := unescape(self.token[1:-1])) == "" or not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", y) else y
        elif self.kind == "name":
            prefix, _, local = self.token.partition(":")
            if prefix not in self.names:
                self.fail(f"a bound prefix ({prefix}:)")
            x = self.names[prefix] + re.sub(r"\\(.)", r"\1", local)
        else:
            self.fail("an IRI")
        self.advance()
        return x

    def parse(self) -> Parser:
        while self.kind != "end":
            if self.kind == "directive":
                self.directive()
            else:
                self.statement()
        return self

    def directive(self) -> None:
        word, dotted = self.token.lstrip("@").lower(), self.token.startswith("@")
        self.advance()
        if word == "prefix":
            if self.kind != "name" or not self.token.endswith(":"):
                self.fail("a prefix")
            name = self.token[:-1]
            self.advance()
            self.names[name] = self.iri()
            self.prefixes.append((name, self.names[name]))
        else:
            self.base = self.iri()
        if dotted:
            self.expect(".")

    def statement(self) -> None:
        alone = self.token == "["
        subject = self.node()
        if not (alone and self.token == "." and self.kind == "mark"):
            self.properties(subject)
        self.expect(".")

    def properties(self, subject: tuple) -> None:
        while True:
            if self.kind == "word" and self.token == "a":
                predicate = RDF + "type"
                self.advance()
            else:
                predicate = self.iri()
            while True:
                self.add(subject, predicate, self.node())
                if self.token != "," or self.kind != "mark":
                    break
                self.advance()
            if self.token != ";" or self.kind != "mark":
                return
            while self.token == ";" and self.kind == "mark":
                self.advance()
            if self.kind in ("end", "mark"):
                return

    def add(self, s: tuple, p: str, o: tuple) -> None:
        self.triples.append((s, p, o))

    def node(self) -> tuple:
        kind, token = self.kind, self.token
        if kind in ("iri", "name"):
            return "iri", self.iri(), None, None
        if kind == "blank":
            self.advance()
            if token not in self.labels:
                self.labels[token] = ("bnode", f"_:{self.graph_id}#{token[2:]}", None, None)
            return self.labels[token]
        if kind in ("string", "long"):
            text = unescape(token[3:-3] if kind == "long" else token[1:-1])
            self.advance()
            if self.kind == "lang":
                lang = self.token[1:]
                self.advance()
                return "literal", text, lang, None
            if self.kind == "type":
                self.advance()
                return "literal", text, None, self.iri()
            return "literal", text, None, None
        if kind in ("integer", "decimal", "double"):
            self.advance()
            return "literal", token, None, XSD + kind
        if kind == "word" and token != "a":
            self.advance()
            return "literal", token, None, XSD + "boolean"
        if token == "[":
            self.advance()
            x = self.new_blank()
            if self.token != "]":
                self.properties(x)
            self.expect("]")
            return x
        if token == "(":
            self.advance()
            items = []
            while self.token != ")" or self.kind != "mark":
                if self.kind == "end":
                    self.fail(")")
                items.append(self.node())
            self.advance()
            head = ("iri", RDF + "nil", None, None)
            for item in reversed(items):
                cell = self.new_blank()
                self.add(cell, RDF + "first", item)
                self.add(cell, RDF + "rest", head)
                head = cell
            return head
        self.fail("a term")


def rows(text: str, graph_id: str) -> Iterator[tuple]:
    """A document's triples and prefixes as rows of SCHEMA, or one row with the error."""
    try:
        p = Parser(text, graph_id).parse()
    except TurtleError as e:
        yield (graph_id, "error", 0, str(e), None, None, None, None, None, None)
        return
    for i, (name, ns) in enumerate(p.prefixes):
        yield (graph_id, "prefix", i, name, None, None, ns, None, None, None)
    for i, (s, pred, o) in enumerate(p.triples):
        yield (graph_id, "triple", i, s[1], s[0], pred, o[1], o[0], o[2], o[3])


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as f:
            yield from rows(f.read(), partition.path)


class TurtleSource(DataSource):
    """spark.read.format("turtle").option("paths", "a.ttl;b.ttl"): a partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        paths = self.options.get("paths") or self.options.get("path") or ""
        return _Reader([p for p in paths.split(";") if p])


def parse_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of SCHEMA of any number of files, packed into tasks by size, from any file system Spark reads."""

    def parse(frames):
        import pandas as pd

        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                yield pd.DataFrame(list(rows(bytes(content).decode("utf-8"), re.sub(r"^file:/*", "/", path))), columns=columns)

    return spark.read.format("binaryFile").load([str(p) for p in paths]).select("path", "content").mapInPandas(parse, SCHEMA)


def parse_text(spark: SparkSession, documents: dict[str, str]) -> DataFrame:
    """Rows of SCHEMA of documents at hand, by graph_id."""
    return spark.createDataFrame([r for k, t in documents.items() for r in rows(t, k)], SCHEMA)


def triples(parsed: DataFrame, merged: bool = False) -> DataFrame:
    """The set of triples of each graph, or of all graphs as one ('merged'), with the first place of each."""
    t = parsed.where(F.col("row") == "triple").drop("row")
    if merged:
        t = t.withColumn("graph_id", F.lit("merged"))
    key = ["graph_id", "s_kind", "s", "p", "o_kind", "o", "o_lang", "o_dtype"]
    return t.groupBy(*key).agg(F.min("seq").alias("seq")).select("graph_id", "seq", "s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dtype")


def prefixes(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("row") == "prefix").select("graph_id", F.col("seq").cast("int").alias("seq"), F.col("s").alias("prefix"), F.col("o").alias("ns"))


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("row") == "error").select("graph_id", F.col("s").alias("error"))
