"""The training-data pipeline: five operators of quillon.llm, each on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import minhash, mixing, packing, suffix_dedup, toxicity
from quillon.llm.common import shared_folder, table
from quillon.llm.queries import toxicity_model, word_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return minhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 400 that occur elsewhere leave their texts; n_chars follows."""
    found = suffix_dedup.remove_repeats(docs, with_text=True).select("k", "kept")
    rest = docs.withColumn("k", F.when(F.col("text").isNotNull(), suffix_dedup.text_key(F.col("text")))).drop("text")
    r = rest.join(found, "k", "left").withColumnRenamed("kept", "text")
    r = r.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return r.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 2 times: the part of a copy that it takes is the
    chance, drawn from the document's hash, that a whole copy enters."""
    x = mixing.mix(docs, keep=True).where("taken > 0")
    part = F.pmod(F.xxhash64(F.lit(17), "row.doc_id", "row.text"), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(F.col("taken") / F.col("size") + part).cast("int")
    return x.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_bpe())


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_copies), ("suffix_array_dedup", cut_repeats), ("mix_sources", mix_sources), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4()}/{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
