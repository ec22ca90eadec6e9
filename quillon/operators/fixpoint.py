"""Iterations over edge tables: components, closures, lists and trees, with reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Ends df's lineage with a reliable checkpoint in the folder of spark.checkpoint.dir; only local mode may go without."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quillon-"))
    return df.checkpoint(eager=True)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(graph_id, s) with the smallest member of each one's component; edges(graph_id, a, b) are undirected.

    Each round takes the smallest neighbour's label and then that label's own label, so paths halve."""
    both = cut(edges.select("graph_id", "a", "b").unionByName(edges.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    x = cut(nodes.select("graph_id", "s", F.col("s").alias("label")))
    while True:
        near = both.join(x.select("graph_id", F.col("s").alias("b"), "label"), ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("s")).agg(F.min("label").alias("near"))
        y = x.join(near, ["graph_id", "s"], "left").select("graph_id", "s", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = x.select("graph_id", F.col("s").alias("new"), F.col("label").alias("far"))
        y = cut(y.join(jump, ["graph_id", "new"], "left").select("graph_id", "s", F.least("new", F.coalesce("far", "new")).alias("new"), "label"))
        x = y.select("graph_id", "s", F.col("new").alias("label"))
        if y.where("new <> label").isEmpty():
            return x


def backward_closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, s): nodes from which a start node is reachable along edges(graph_id, a, b), itself included."""
    edges = cut(edges.select("graph_id", "a", "b").distinct())
    found = frontier = cut(start.select("graph_id", "s").distinct())
    while True:
        new = edges.join(frontier.select("graph_id", F.col("s").alias("b")), ["graph_id", "b"]).select("graph_id", F.col("a").alias("s")).distinct()
        frontier = cut(new.join(found, ["graph_id", "s"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut(found.unionByName(frontier))


def list_items(heads: DataFrame, triples: DataFrame, rdf: str) -> DataFrame:
    """heads(graph_id, head) as (graph_id, head, i, item): items of RDF lists in order; of a list that runs into itself each cell once.

    Pointer doubling: after k rounds all cells up to 2^k steps are known, so a list of n items takes log n rounds."""
    first = triples.where(F.col("p") == rdf + "first").groupBy("graph_id", F.col("s").alias("cell")).agg(F.min_by("o", "seq").alias("item"))
    rest = triples.where(F.col("p") == rdf + "rest").groupBy("graph_id", F.col("s").alias("cell")).agg(F.min_by("o", "seq").alias("next"))
    cells = cut(first.join(rest, ["graph_id", "cell"], "left"))
    jump = cells.where(F.col("next").isNotNull() & (F.col("next") != rdf + "nil")).select("graph_id", "cell", F.col("next").alias("to"))
    jump = cut(jump.join(cells.select("graph_id", F.col("cell").alias("to")), ["graph_id", "to"], "left_semi").select("graph_id", "cell", "to"))
    at = cut(heads.select("graph_id", "head", F.col("head").alias("cell"), F.lit(0).alias("i")).distinct())
    step, before = 1, at.count()
    while True:
        new = at.join(jump, ["graph_id", "cell"]).select("graph_id", "head", F.col("to").alias("cell"), (F.col("i") + step).alias("i"))
        at = cut(at.unionByName(new).groupBy("graph_id", "head", "cell").agg(F.min("i").alias("i")))
        now = at.count()
        if now == before:
            break
        far = jump.select("graph_id", F.col("cell").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(far, ["graph_id", "to"]).select("graph_id", "cell", F.col("far").alias("to")))
        step, before = 2 * step, now
    return at.join(cells, ["graph_id", "cell"]).select("graph_id", "head", "i", "item")


def first_paths(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Pre-order walk from each root: (graph_id, root, node, path), where path holds the names of a node's first visit.

    roots(graph_id, s, qname), edges(graph_id, child, parent, qname of the child). A depth-first walk with children
    in order of name first meets a node on its smallest path, so only improvements go on; paths hold a name once, so they end."""
    best = frontier = cut(roots.select("graph_id", F.col("s").alias("root"), F.col("s").alias("node"), F.array("qname").alias("path")))
    edges = cut(edges.select("graph_id", F.col("parent").alias("node"), F.col("child"), "qname"))
    while True:
        new = frontier.join(edges, ["graph_id", "node"]).where(~F.expr("array_contains(path, qname)"))
        new = new.groupBy("graph_id", "root", F.col("child").alias("node")).agg(F.min(F.concat("path", F.array("qname"))).alias("path"))
        old = best.select("graph_id", "root", "node", F.col("path").alias("old"))
        frontier = cut(new.join(old, ["graph_id", "root", "node"], "left").where("old is null or path < old").select("graph_id", "root", "node", "path"))
        if frontier.isEmpty():
            return best
        best = cut(best.unionByName(frontier).groupBy("graph_id", "root", "node").agg(F.min("path").alias("path")))
