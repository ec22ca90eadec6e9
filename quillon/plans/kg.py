"""A set of graphs as DataFrames, and the sets that several metrics share, each derived once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..sources import text, turtle


class KnowledgeGraph:
    """triples(graph_id, seq, s, s_kind, p, o, o_kind, o_lang, o_dtype), prefixes, texts and parse errors of graphs."""

    def __init__(self, triples: DataFrame, prefixes: DataFrame | None = None, texts: DataFrame | None = None, errors: DataFrame | None = None, graphs: DataFrame | None = None, keep: bool = False):
        self.spark: SparkSession = triples.sparkSession
        self.keep = keep
        self.triples = triples.persist() if keep else triples
        declared = prefixes if prefixes is not None else self.spark.createDataFrame([], "graph_id string, seq int, prefix string, ns string")
        self.prefixes, self.texts = declared, texts
        self.errors = errors if errors is not None else self.spark.createDataFrame([], "graph_id string, error string")
        self._graphs = graphs

    @classmethod
    def read(cls, spark: SparkSession, paths, merged: bool = False) -> KnowledgeGraph:
        """Turtle files, each a graph of its own, or all one graph."""
        paths = [str(p) for p in (paths if isinstance(paths, (list, tuple)) else [paths])]
        parsed = turtle.parse_files(spark, paths).persist()
        graphs = spark.createDataFrame([("merged",)] if merged else [(p,) for p in dict.fromkeys(paths)], "graph_id string")
        one = (lambda x: x.withColumn("graph_id", F.lit("merged"))) if merged else (lambda x: x)
        return cls(turtle.triples(parsed, merged), one(turtle.prefixes(parsed)), one(text.whole_texts(spark, paths)), turtle.errors(parsed), graphs, keep=True)

    @classmethod
    def from_text(cls, spark: SparkSession, documents: dict[str, str] | str) -> KnowledgeGraph:
        documents = {"g": documents} if isinstance(documents, str) else documents
        parsed = turtle.parse_text(spark, documents).persist()
        texts = spark.createDataFrame(list(documents.items()), "graph_id string, text string")
        return cls(turtle.triples(parsed), turtle.prefixes(parsed), texts, turtle.errors(parsed), texts.select("graph_id"), keep=True)

    def _kept(self, df: DataFrame) -> DataFrame:
        return df.persist() if self.keep else df

    @cached_property
    def graphs(self) -> DataFrame:
        return self._graphs if self._graphs is not None else self.triples.select("graph_id").distinct()

    @cached_property
    def bound(self) -> DataFrame:
        """The graphs' prefixes after those that are always bound."""
        fixed = self.spark.createDataFrame([(-1, k, v) for k, v in T.BOUND.items()], "seq int, prefix string, ns string")
        return self.graphs.crossJoin(F.broadcast(fixed)).unionByName(self.prefixes)  # a few constant rows for each graph

    @cached_property
    def few_bound(self) -> bool:
        """Whether the bound prefixes fit into 16 MB."""
        size = sum(F.octet_length(c) for c in ("graph_id", "prefix", "ns")) + 64
        return (self.bound.agg(F.sum(size)).first()[0] or 0) <= 16 << 20

    def typed(self, *types: str) -> DataFrame:
        """(graph_id, s, s_kind) of the subjects of one of the types, once each."""
        return self.triples.where((F.col("p") == T.TYPE) & F.col("o").isin(*types)).select("graph_id", "s", "s_kind").distinct()

    def pattern(self, *predicates: str) -> DataFrame:
        return self.triples.where(F.col("p").isin(*predicates))

    def values(self, predicate: str) -> DataFrame:
        return self.triples.where(F.col("p") == predicate)

    def first(self, predicate: str, name: str, where=None) -> DataFrame:
        """(graph_id, s, name): each subject's first object in document order."""
        x = self.values(predicate)
        if where is not None:
            x = x.where(where)
        return x.groupBy("graph_id", "s").agg(F.min_by("o", "seq").alias(name))

    @cached_property
    def named_classes(self) -> DataFrame:
        """(graph_id, s): IRIs that are typed as classes or stand at either end of rdfs:subClassOf."""
        t = self.triples
        sub = t.where(F.col("p") == T.SUBCLASS)
        typed = (F.col("p") == T.TYPE) & F.col("o").isin(T.OWL + "Class", T.RDFS + "Class")
        left = t.where((typed | (F.col("p") == T.SUBCLASS)) & (F.col("s_kind") == "iri")).select("graph_id", "s")
        return self._kept(left.unionByName(sub.where("o_kind = 'iri'").select("graph_id", F.col("o").alias("s"))).distinct())

    @cached_property
    def edges(self) -> DataFrame:
        """(graph_id, child, parent): subclass edges whose ends are both named."""
        sub = self.values(T.SUBCLASS).where("s_kind = 'iri' and o_kind = 'iri'")
        return self._kept(sub.select("graph_id", F.col("s").alias("child"), F.col("o").alias("parent")).distinct())

    @cached_property
    def roots(self) -> DataFrame:
        return self.named_classes.join(self.edges.select("graph_id", F.col("child").alias("s")).distinct(), ["graph_id", "s"], "left_anti")

    @cached_property
    def properties(self) -> DataFrame:
        return self.typed(T.OWL + "ObjectProperty", T.OWL + "DatatypeProperty")

    def qnames(self, nodes: DataFrame, column: str = "s", name: str = "qname") -> DataFrame:
        return T.with_qname(nodes, self.bound, column, name, self.few_bound)

    def labels(self, nodes: DataFrame) -> DataFrame:
        """nodes plus qname and preferred: the first prefLabel, else the first label, else the prefixed name."""
        present = T.truthy(F.col("o_kind"), F.col("o"), F.col("o_dtype"))
        x = self.qnames(nodes)
        firsts = [self.values(p).groupBy("graph_id", "s").agg(F.min_by(F.struct("o", present.alias("ok")), "seq").alias(n)) for p, n in ((T.SKOS + "prefLabel", "_pref"), (T.LABEL, "_label"))]
        for f in firsts:
            x = x.join(f, ["graph_id", "s"], "left")
        pick = lambda c: F.when(F.col(f"{c}.ok"), F.col(f"{c}.o"))
        return x.withColumn("preferred", F.coalesce(pick("_pref"), pick("_label"), "qname")).drop("_pref", "_label")
