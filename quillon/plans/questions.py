"""Questions in plain language as question records with a star graph and a SPARQL text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.terms import MDS, RDFS
from ..sources.text import plain_questions


def records(questions: DataFrame, prefix: str = "mds", namespace_uri: str = MDS, starting_qid: int = 1_000_000) -> DataFrame:
    """questions(idx, question) as records in the shape of the question files."""
    name = lambda p: F.concat(F.lit(prefix + ":"), X.pascal(p))
    x = questions.withColumn("p", X.phrases(F.col("question")))
    node = lambda p, i: F.struct(
        i.cast("int").alias("nid"), F.lit("class").alias("node_type"), name(p).alias("id"), name(p).alias("class"),
        F.initcap(p).alias("friendly_name"), F.when(i > 0, 1).otherwise(0).alias("question_node"), F.lit("none").alias("function"),
    )
    edge = lambda i: F.struct(i.cast("int").alias("start"), F.lit(0).alias("end"), F.lit("rdfs:subClassOf").alias("relation"), F.lit("subclass of").alias("friendly_name"))
    n = F.size("p")
    edges = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), edge)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,relation:string,friendly_name:string>>)"))
    variables = F.when(n > 0, F.array_join(F.transform("p", lambda p: F.concat(F.lit("?"), X.camel(p))), " ")).otherwise(F.lit("?concept"))
    clause = lambda p: F.concat(F.lit("  ?"), X.camel(p), F.lit(" a "), name(p), F.lit(" ."))
    where = F.when(n > 0, F.array_join(F.transform("p", clause), "\n")).otherwise(F.lit(f"  ?concept a {prefix}:Concept ."))
    sparql = F.concat(F.lit(f"PREFIX {prefix}: <{namespace_uri}>\nPREFIX rdfs: <{RDFS}>\nSELECT "), variables, F.lit("\nWHERE {\n"), where, F.lit("\n}"))
    return x.select(
        (F.col("idx") + starting_qid).cast("long").alias("qid"), "question", F.array().cast("array<string>").alias("answer"), F.lit("none").alias("function"),
        F.lit(None).cast("double").alias("commonness"), n.alias("num_node"), F.greatest(n - 1, F.lit(0)).alias("num_edge"),
        F.struct(F.transform("p", node).alias("nodes"), edges.alias("edges")).alias("graph_query"), sparql.alias("sparql_query"),
    )


def build_question_json(spark: SparkSession, txt_path: str, output_json_path: str, prefix: str = "mds", namespace_uri: str = MDS, starting_qid: int = 1_000_000) -> None:
    """One JSON array of records, in the order of the text's lines; parent folders are made."""
    x = records(plain_questions(spark, txt_path), prefix, namespace_uri, starting_qid).orderBy("qid")
    out = Path(output_json_path)
    out.parent.mkdir(parents=True, exist_ok=True)
    with open(out, "w", encoding="utf-8") as f:
        json.dump([json.loads(r[0]) for r in x.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()], f, indent=2, ensure_ascii=False)
