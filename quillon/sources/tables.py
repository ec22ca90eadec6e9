"""Relational tables as triples: the mapping that registered queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import terms as T
from ..plans.kg import KnowledgeGraph

BASE = "http://ex.org/onto#"
TABLES = ("region", "nation", "supplier", "customer", "part", "events", "documents", "pages")
PREFIX = BASE


def _id(name: str, key: str) -> str:
    return f"concat('{BASE}{name}', cast({key} as varchar(20)))"


def _row(table: str, s: str, p: str, o: str, kind: str = "iri", where: str = "", seq: int = 1, s_kind: str = "iri", distinct: bool = False) -> str:
    return f"SELECT {'DISTINCT ' if distinct else ''}'tables' AS graph_id, CAST({seq} AS BIGINT) AS seq, {s} AS s, '{s_kind}' AS s_kind, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, CAST(NULL AS VARCHAR(20)) AS o_lang, CAST(NULL AS VARCHAR(20)) AS o_dtype FROM {table}" + (f" WHERE {where}" if where else "")


CLASS, RCLASS = f"'{T.OWL}Class'", f"'{T.RDFS}Class'"
REGION, NATION, SUPPLIER, CUSTOMER, PART = (_id(n, k) for n, k in (("Region", "r_regionkey"), ("Nation", "n_nationkey"), ("Supplier", "s_suppkey"), ("Customer", "c_custkey"), ("part", "p_partkey")))
BRAND, BLANK = f"concat('{BASE}', replace(p_brand, '#', ''))", "concat('_:r', cast(p_partkey as varchar(20)))"
PROP, DOC, PAGE = f"concat('{BASE}prop_', event_type)", _id("doc", "doc_id"), _id("page", "page_id")
TRIPLES = "\nUNION ALL ".join([
    _row("region", REGION, T.TYPE, CLASS), _row("region", REGION, T.LABEL, "lower(r_name)", "literal"),
    _row("nation", NATION, T.TYPE, CLASS), _row("nation", NATION, T.SUBCLASS, _id("Region", "n_regionkey")), _row("nation", NATION, T.LABEL, "lower(n_name)", "literal", "n_nationkey % 5 <> 0"),
    _row("supplier", SUPPLIER, T.SUBCLASS, _id("Nation", "s_nationkey")), _row("supplier", SUPPLIER, T.SKOS + "definition", "CASE WHEN s_acctbal < 0 THEN '' ELSE lower(s_name) END", "literal"),
    _row("customer", CUSTOMER, T.TYPE, RCLASS), _row("customer", CUSTOMER, T.SUBCLASS, _id("Nation", "c_nationkey")), _row("customer", CUSTOMER, T.SKOS + "altLabel", "CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END", "literal"),
    _row("part", PART, T.TYPE, CLASS), _row("part", PART, T.LABEL, "lower(p_name)", "literal"), _row("part", PART, T.LABEL, "lower(p_brand)", "literal", "p_partkey % 10 = 0", 2),
    _row("part", PART, T.SKOS + "broader", BRAND), _row("part", BRAND, T.TYPE, CLASS, distinct=True),
    _row("part", PART, T.SUBCLASS, BLANK, "bnode", "p_partkey % 7 = 0"), _row("part", BLANK, T.TYPE, f"'{T.OWL}Restriction'", "iri", "p_partkey % 7 = 0", s_kind="bnode"),
    _row("part", BLANK, T.OWL + "someValuesFrom", _id("Nation", "p_partkey % 25"), "iri", "p_partkey % 7 = 0", s_kind="bnode"),
    _row("events", PROP, T.TYPE, f"'{T.OWL}ObjectProperty'", distinct=True), _row("events", PROP, T.RDFS + "domain", f"'{BASE}Nation1'", "iri", "event_type < 'm'", distinct=True),
    _row("events", PROP, T.RDFS + "range", f"'{BASE}Region1'", "iri", "event_type > 'd'", distinct=True), _row("events", PROP, T.RDFS + "subPropertyOf", f"'{BASE}prop'", "iri", "event_type > 'p'", distinct=True),
    _row("documents", DOC, T.RDFS + "comment", "lower(text)", "literal", "text IS NOT NULL"),
    _row("pages", PAGE, T.RDFS + "seeAlso", "url", "iri", "url IS NOT NULL"), _row("pages", PAGE, T.DCAT + "downloadURL", "CASE WHEN page_id % 3 = 0 THEN concat(url, '.TTL') ELSE url END", "iri", "url IS NOT NULL"),
    _row("pages", PAGE, T.VOID + "sparqlEndpoint", "concat(url, '/sparql')", "iri", "url IS NOT NULL AND page_id % 11 = 0"),
])
UNION, CELL = f"concat('{BASE}Union', cast(p_partkey as varchar(20)))", "concat('_:c', cast(p_partkey as varchar(20)))"
#: The same graph with what the plain mapping lacks: roots in upper ontologies, foundational and blank names, unions of classes.
RICH = TRIPLES + "\nUNION ALL " + "\nUNION ALL ".join([
    _row("supplier", SUPPLIER, T.SUBCLASS, "concat('https://www.commoncoreontologies.org/ont', cast(s_nationkey as varchar(20)))", where="s_acctbal > 3000"),
    _row("customer", CUSTOMER, T.SUBCLASS, "concat('http://purl.obolibrary.org/obo/BFO_', cast(c_nationkey as varchar(20)))", where="c_acctbal > 6000"),
    _row("customer", CUSTOMER, T.SUBCLASS, "concat('http://www.ontologyrepository.com/CommonCoreOntologies/Old', cast(c_nationkey as varchar(20)))", where="c_acctbal < 100"),
    _row("nation", f"concat('{T.SKOS}Concept', cast(n_nationkey as varchar(20)))", T.TYPE, CLASS), _row("nation", "concat('http://other.org/x/', lower(n_name))", T.LABEL, "lower(n_name)", "literal"),
    _row("region", "'http://ex.org/blank#'", T.LABEL, "'blank'", "literal", distinct=True),
    _row("part", UNION, T.TYPE, CLASS, where="p_size % 4 = 1"), _row("part", UNION, T.OWL + "unionOf", CELL, "bnode", "p_size % 4 = 1"),
    _row("part", UNION, T.TYPE, CLASS, where="p_size % 4 = 2"), _row("part", UNION, T.SUBCLASS, CELL, "bnode", "p_size % 4 = 2"),
    _row("part", CELL, T.OWL + "unionOf", CELL.replace("_:c", "_:d"), "bnode", "p_size % 4 = 2", s_kind="bnode"), _row("part", CELL.replace("_:c", "_:d"), T.RDF + "first", NATION.replace("n_nationkey", "p_partkey % 25"), "iri", "p_size % 4 = 2", s_kind="bnode"),
    _row("part", CELL, T.RDF + "first", f"'{BASE}Nation2'", "iri", "p_size % 4 = 1", s_kind="bnode"), _row("part", UNION, T.TYPE, CLASS, where="p_size % 4 = 3"),
    _row("part", UNION, T.OWL + "disjointWith", f"concat('{BASE}Nowhere', cast(p_size as varchar(20)))", where="p_size % 4 = 3"),
])
QUESTIONS = f"""SELECT concat('SELECT ?x WHERE {{ ?x a ex:part', cast(p_partkey as varchar(20)), ' }}') AS sparql FROM part
UNION ALL SELECT concat('SELECT ?x WHERE {{ ?x a ex:Unknown', cast(r_regionkey as varchar(20)), ' ; ex:Nation1 ?y }}') AS sparql FROM region"""


def views(spark: SparkSession, sf_dir: str, names=TABLES) -> dict:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def sql(spark: SparkSession, sf_dir: str, text: str, names=TABLES):
    """Runs text over the tables, which its FROM clauses name, without touching the session's views."""
    frames = views(spark, sf_dir, names)
    for n in frames:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text.replace("{ ?x", "{{ ?x").replace(" }'", " }}'"), **frames)


def graph(spark: SparkSession, sf_dir: str, keep: bool = False, text: str = TRIPLES) -> KnowledgeGraph:
    """keep: for plans that read the triples many times, which are then computed once."""
    t = sql(spark, sf_dir, text)
    prefixes = spark.createDataFrame([("tables", 0, "ex", BASE)], "graph_id string, seq int, prefix string, ns string")
    graphs = spark.createDataFrame([("tables",)], "graph_id string")
    return KnowledgeGraph(t, prefixes, None, None, graphs, keep)


def questions(spark: SparkSession, sf_dir: str):
    return sql(spark, sf_dir, QUESTIONS, ("part", "region"))
