"""Scores of graphs as their files arrive: a file stream whose micro-batches are assessed and appended."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.kg import KnowledgeGraph
from ..plans.runner import results, run_metrics
from ..sources import turtle


def assess_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, metrics: list[str], search_term: str | None = None, **trigger) -> StreamingQuery:
    """Watches folder for Turtle files; result rows go to Parquet in output. trigger: e.g. availableNow=True."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.ttl").load(folder).select("path", "content")

    def assess(batch: DataFrame, batch_id: int) -> None:
        def parse(frames):
            import pandas as pd

            columns = [c.split()[0] for c in turtle.SCHEMA.split(", ")]
            for f in frames:
                for path, content in zip(f["path"], f["content"]):
                    yield pd.DataFrame(list(turtle.rows(bytes(content).decode(), re.sub("^file:/*", "/", path))), columns=columns)

        parsed = batch.mapInPandas(parse, turtle.SCHEMA).persist()
        graphs = parsed.select("graph_id").distinct()
        texts = batch.selectExpr("regexp_replace(path, '^file:/*', '/') AS graph_id", "decode(content, 'UTF-8') AS text")
        kg = KnowledgeGraph(turtle.triples(parsed), turtle.prefixes(parsed), texts, turtle.errors(parsed), graphs, keep=True)
        results(spark, run_metrics(kg, metrics, search_term)).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")  # a batch that is run again replaces itself
        parsed.unpersist()

    return files.writeStream.foreachBatch(assess).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
