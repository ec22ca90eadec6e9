"""Task-based assessment: the terms that competency queries need against those that an ontology defines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions import text as X


def ontology_terms(triples: DataFrame, fragments: list[str] | None = None) -> DataFrame:
    """(term): local names of declared, labelled, domained or ranged IRIs outside the foundational vocabularies."""
    declared = (F.col("p") == T.TYPE) & F.col("o").isin(T.OWL + "Class", T.RDFS + "Class", T.OWL + "ObjectProperty", T.OWL + "DatatypeProperty", T.RDF + "Property")
    x = triples.where("s_kind = 'iri'").where(declared | F.col("p").isin(T.LABEL, T.RDFS + "domain", T.RDFS + "range")).select("s").distinct()
    x = x.where(~T.foundational(F.col("s")) & T.any_fragment(F.col("s"), fragments)).select(T.task_local(F.col("s")).alias("term"))
    return x.where(T.nonblank(F.col("term"))).distinct()


def task_terms(questions: DataFrame, prefixes: list[str]) -> DataFrame:
    return questions.select(F.explode(X.prefixed_terms(F.col("sparql"), prefixes)).alias("term")).distinct()


def compare(have: DataFrame, need: DataFrame) -> DataFrame:
    """(term, side): both, missing from the ontology, or unused by the queries."""
    x = need.withColumn("need", F.lit(True)).join(have.withColumn("have", F.lit(True)), "term", "full")
    return x.select("term", F.when(F.col("have").isNull(), "missing").when(F.col("need").isNull(), "unused").otherwise("both").alias("side"))


def relevance_accuracy(have: DataFrame, need: DataFrame) -> DataFrame:
    x = compare(have, need).agg(F.count_if(F.col("side") != "missing").alias("t_o"), F.count_if(F.col("side") != "unused").alias("t_a"), F.count_if(F.col("side") == "both").alias("common"))
    return x.select(T.ratio(F.col("common"), F.col("t_a")).cast("double").alias("relevance"), T.ratio(F.col("common"), F.col("t_o")).cast("double").alias("accuracy"), "t_o", "t_a", "common")
