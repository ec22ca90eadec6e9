"""Raw lines and whole texts, competency questions in JSON or Markdown, questions in plain language."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUESTION = """qid bigint, question string, answer array<string>, function string, commonness double, num_node int, num_edge int,
graph_query struct<nodes: array<struct<nid: int, node_type: string, id: string, class: string, friendly_name: string, question_node: int, function: string>>,
edges: array<struct<start: int, end: int, relation: string, friendly_name: string>>>, sparql_query string"""


def _path():
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")


def whole_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(graph_id, text), a row for each file."""
    return spark.read.text([str(p) for p in paths], wholetext=True).select(_path().alias("graph_id"), F.col("value").alias("text"))


def lines(texts: DataFrame) -> DataFrame:
    """(graph_id, line_no, text), numbered from 1."""
    x = texts.select("graph_id", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("n", "text"))
    return x.select("graph_id", (F.col("n") + 1).alias("line_no"), "text")


def json_questions(spark: SparkSession, path: str) -> DataFrame:
    """(sparql) of a JSON array's records that have a query."""
    x = spark.read.schema(QUESTION).json(str(path), multiLine=True)
    return x.where(F.coalesce("sparql_query", F.lit("")) != "").select(F.col("sparql_query").alias("sparql"))


def fenced_queries(texts: DataFrame) -> DataFrame:
    """(sparql) of the fenced blocks in the Markdown texts of one column."""
    return texts.select(F.explode(F.regexp_extract_all(texts.columns[0], F.lit(r"(?s)```sparql\s*(.*?)```"), F.lit(1))).alias("sparql"))


def markdown_questions(spark: SparkSession, path: str) -> DataFrame:
    return fenced_queries(spark.read.text(str(path), wholetext=True))


def questions(spark: SparkSession, source) -> DataFrame:
    """Queries of a .json or .md path or of a list of strings; a DataFrame with column sparql is taken as it is."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, list):
        return spark.createDataFrame([(q,) for q in source], "sparql string")
    if not isinstance(source, (str, Path)):
        raise ValueError(f"questions must be a path or a list of queries, not {type(source).__name__}")
    suffix = Path(source).suffix.lower()
    if suffix == ".json":
        return json_questions(spark, str(source))
    if suffix == ".md":
        return markdown_questions(spark, str(source))
    raise ValueError(f"questions must be a .json or .md file, not {suffix or 'one without a suffix'}")


def plain_questions(spark: SparkSession, path: str) -> DataFrame:
    """(idx, question): the non-blank lines of a text, in order."""
    x = lines(whole_texts(spark, [path])).select("line_no", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("question")).where("question <> ''")
    return x.select((F.row_number().over(Window.orderBy("line_no")) - 1).alias("idx"), "question")
