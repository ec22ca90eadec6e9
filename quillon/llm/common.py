"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
BLANK = [bytes([b]) for b in b" \t\n\x0b\x0c\r"]
WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all nodes share; without it, and in local mode only, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    return shared or tempfile.mkdtemp(prefix="quillon-")


def cut(df: DataFrame) -> DataFrame:
    """Ends df's lineage with a reliable checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Sets the session's Arrow batches to at most so many bytes, or one longer row: both sides of a Python stage hold a few."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def gives_back(run):
    """run for mapInArrow; after a task the worker's free memory goes back to the system, as later stages use the worker again."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(u, v) as rows (node, component), component = smallest node.

    Alternating large-star and small-star steps, each one shuffle with map-side minima, so a node
    that a third of all edges share costs one row per partition. Nodes without an edge don't appear.
    """
    both = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    e = cut(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u links to the smallest node around u
        two = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours link to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def slices(batches, rows: int = 512):
    """Arrow batches as smaller ones, so that Python's copies of a batch stay small."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def pieces(data: bytes, most: int, overlap: int = 0) -> Iterator[tuple[int, bytes]]:
    """(skip, piece): a text in pieces of at most `most` bytes that end between words.

    A later piece begins with the `overlap` words before it, its first `skip` bytes. A stretch of most / 2
    bytes without white space is cut inside, as if white space stood there."""
    at = skip = 0
    while len(data) - at > most:
        end = max(data.rfind(c, at + most // 2, at + most) for c in BLANK)
        end = end if end >= 0 else at + most
        yield skip, data[at:end]
        low = max(at + 1, end - most // 4)
        before = [m.start() for m in WORD.finditer(data, low, end)] if overlap else []
        back = before[-overlap] if overlap and len(before) >= overlap else before[0] if before else end
        at, skip = back, end - back
    yield skip, data[at:]


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
