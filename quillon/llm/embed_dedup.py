"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

A hash function applies three rounds of random signs and a fast Hadamard transform and names the
closest signed axis; a table's bucket joins `functions` of them with the label. Multiprobe: each
vector also enters the buckets of its next closest axes. Only keys are shuffled to find the buckets of two
or more; vectors go to these alone. Within a bucket all cosines are computed in double
precision from the original vectors, in blocks; of a pair that meets in several buckets only the
one with the smallest key counts it, so counts add up without listing pairs. Equal vectors are one class throughout.
Buckets above `block` classes are split into pairs of blocks, each a task of its own. Vectors are scaled by a
power of two before products, which changes no cosine but for overflow.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with null
label, link with nothing; vectors of different widths never meet; repeated rows are vectors each; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, gives_back, mix64, slices, small_batches
from .vectors import matrix, rowwise_dot, valid


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows, a power of two wide."""
    return fast_hadamard(np.ascontiguousarray(x.T)).T


def fast_hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of columns."""
    d, n = x.shape
    h = 1
    while h < d:
        y = x.reshape(d // (2 * h), 2, h, n)
        x = np.empty_like(y)
        np.add(y[:, 0], y[:, 1], out=x[:, 0])
        np.subtract(y[:, 0], y[:, 1], out=x[:, 1])
        x = x.reshape(d, n)
        h *= 2
    return x / np.sqrt(d)


def axes(x: np.ndarray, rng: np.random.Generator, probes: int) -> np.ndarray:
    """The closest signed axes after a pseudo-random rotation, nearest first."""
    d, every = 1 << max(1, (x.shape[1] - 1).bit_length()), np.arange(len(x))
    y = np.zeros((d, len(x)))
    y[: x.shape[1]] = x.T
    for _ in range(3):
        y = fast_hadamard(y * rng.choice([-1.0, 1.0], d)[:, None])
    far, out = np.abs(y), []
    for _ in range(probes):
        top = far.argmax(0)
        far[top, every] = -1
        out.append(2 * top + (y[top, every] < 0))
    return np.stack(out, 1)


def buckets(x: np.ndarray, labels: np.ndarray, tables: int, functions: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables * combinations) bucket keys; the probes of a table are all combinations of the closest axes."""
    out = []
    for t in range(tables):
        keys = [mix64(labels.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t * 1000 + x.shape[1]))]
        for f in range(functions):
            a = axes(x, np.random.default_rng([seed, t, f]), min(probes, max(2, x.shape[1]))).astype(np.uint64)
            keys = [mix64(k ^ mix64(a[:, p] + np.uint64(1))) for k in keys for p in range(a.shape[1])]
        out += keys
    return np.stack(out, axis=1).view(np.int64)


def hash_label(label) -> int:
    return int(label) if isinstance(label, (int, np.integer)) else int.from_bytes(hashlib.blake2b(str(label).encode(), digest_size=7).digest(), "little")


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, with largest components from 0.5 to 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def pairs_within(x: np.ndarray, side: np.ndarray, threshold: float, step: int = 512):
    """Index pairs i < j with cosine at or above the threshold; side: None, or only pairs across its two values."""
    x = scaled(x)
    unit = x / np.sqrt(rowwise_dot(x, x))[:, None]
    for s in range(0, len(x), step):
        i, j = np.nonzero(unit[s : s + step] @ unit.T >= threshold - 1e-9)
        i += s
        keep = i < j
        if side is not None:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        exact = rowwise_dot(x[i], x[j]) / np.sqrt(rowwise_dot(x[i], x[i]) * rowwise_dot(x[j], x[j])) >= threshold
        yield i[exact], j[exact]


def near_vectors(rows: DataFrame, *, threshold: float = 0.98, tables: int = 5, functions: int = 3, probes: int = 2, block: int = 4096, seed: int = 11) -> DataFrame:
    """rows(vec_id, embedding, label) as (vec_id, n_links, component_id, kept)."""
    small_batches(rows.sparkSession)
    single = dict(rows.dtypes)["embedding"] == "array<float>"  # the original precision is sent
    kind = "array<float>" if single else "array<double>"
    ok = valid(F.col("embedding")) & F.col("label").isNotNull()
    base = rows.select("vec_id", "label", F.when(ok, F.col("embedding").cast(kind)).alias("x"))
    base = base.withColumn("c", F.when(F.col("x").isNotNull(), F.xxhash64("label", "x")))
    classes = cut(base.where("c is not null").groupBy("c").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("low")))

    def hash_rows(batches):
        """A row for each class and each of its buckets, once."""
        for b in slices(batches):
            width = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                part = b.take(pa.array(np.flatnonzero(width == w)))
                x = scaled(matrix(part.column(2)))
                label = np.array([hash_label(v) for v in part.column(1).to_pylist()], np.int64)
                keys = np.sort(buckets(x, label, tables, functions, probes, seed), axis=1)
                at, j = np.nonzero(np.c_[np.ones(len(keys), bool), keys[:, 1:] != keys[:, :-1]])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at, j]), part.column(0).take(pa.array(at))], names=["bucket", "c"])

    hashed = classes.select("c", "label", "x").mapInArrow(gives_back(hash_rows), "bucket long, c long")
    # counts with map-side sums; keys alone, so a bucket that a third of all rows share is no list
    met = hashed.groupBy("bucket").agg(F.min("c").alias("c"), F.max("c").alias("other"), F.count(F.lit(1)).alias("n")).where("c <> other")
    met = cut(met.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    side = F.broadcast(met) if met.count() * 32 <= 16 << 20 else met  # by its size; otherwise a shuffled join
    shared = cut(hashed.join(side, "bucket"))
    codes = shared.groupBy("c").agg(F.collect_list(F.struct("bucket", "blocks")).alias("s"))  # at most tables * probes ** functions
    placed = classes.select("c", "x", "m").join(codes, "c").select("c", "x", "m", F.array_sort("s.bucket").alias("codes"), F.explode("s").alias("s"))
    placed = placed.select("c", "x", "m", "codes", "s.bucket", "s.blocks").withColumn("b", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("b", "o"), F.greatest("b", "o"))).alias("g"), "bucket", "c", "m", "x", "codes", F.when(F.col("o") == F.col("b"), F.lit(-1)).otherwise(F.col("b")).alias("side"))

    def links(batches):
        for block_of in _blocks(batches):
            width = pc.list_value_length(block_of.column(4)).to_numpy()
            for w in np.unique(width):
                yield linked(block_of.take(pa.array(np.flatnonzero(width == w))), threshold)

    found = placed.repartition("g").sortWithinPartitions("g").mapInArrow(gives_back(links), "c long, n long, r long")
    found = cut(found)
    n = found.groupBy("c").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("c").alias("u"), F.col("r").alias("v"))).select(F.col("node").alias("c"), "component")
    x = classes.select("c", "m", "low").join(n, "c", "left").join(comp, "c", "left").withColumn("component", F.coalesce("component", "c"))
    lows = x.groupBy("component").agg(F.min("low").alias("component_id"))
    x = x.join(lows, "component").select("c", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    r = base.select("vec_id", "c").join(x, "c", "left")
    comp_id = F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return r.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.col("vec_id").eqNullSafe(comp_id).alias("kept"))


def linked(rows: pa.Table, threshold: float) -> pa.RecordBatch:
    """(c, n, r) of whole groups (g, bucket, c, m, x, codes, side): each vector's links that this bucket counts, and its smallest relative in the group."""
    g, bucket, c, m, side = (rows.column(i).to_numpy() for i in (0, 1, 2, 3, 6))
    x, own = scaled(matrix(rows.column(4).combine_chunks())), rows.column(5).to_pylist()
    codes = np.full((len(own), max(map(len, own))), np.iinfo(np.int64).max)
    for i, v in enumerate(own):
        codes[i, : len(v)] = v
    norm = rowwise_dot(x, x)
    links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        """Of pairs at or above the threshold those that no bucket with a smaller key counts."""
        for s in range(0, len(i), 4096):
            a, b = i[s : s + 4096], j[s : s + 4096]
            near = rowwise_dot(x[a], x[b]) / np.sqrt(norm[a] * norm[b]) >= threshold
            a, b = a[near], b[near]
            both = (codes[a][:, :, None] == codes[b][:, None, :]).any(2)
            # padding is never the least, as the two share this bucket
            first = np.where(both, codes[a], np.iinfo(np.int64).max).min(1) == bucket[a]
            links.append((a[first], b[first]))

    edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
    start, size = edges[:-1], np.diff(edges)
    for k in np.unique(size[size > 1]):
        here = start[size == k]
        if k <= 32:  # all pairs of many small groups at a time
            i, j = np.triu_indices(k, 1)
            for s in range(0, len(here), 1 + 65536 // len(i)):
                a, b = ((here[s : s + 1 + 65536 // len(i), None] + v).ravel() for v in (i, j))
                ok = (side[a] == -1) | (side[a] != side[b])
                keep(a[ok], b[ok])
        else:
            for s in here:
                z = slice(s, s + k)
                for i, j in pairs_within(x[z], None if (side[z] == -1).all() else side[z], threshold):
                    keep(i + s, j + s)
    a, b = (np.concatenate(v) for v in zip(*links))
    n, low = np.zeros(len(g), np.int64), np.arange(len(g))
    np.add.at(n, a, m[b])
    np.add.at(n, b, m[a])
    while True:
        least = np.minimum(low[a], low[b])
        if (least == low[a]).all() and (least == low[b]).all():
            break
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
    hit = n > 0
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (c[hit], n[hit], c[low[hit]])], names=["c", "n", "r"])


def _blocks(batches, most: int = 4 << 20):
    """Tables of whole groups of the first column (int64), some MB each."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        if held and size >= most:
            g, last = b.column(0).to_numpy(), held[-1].column(0)[-1].as_py()
            same = int(np.searchsorted(g, last, "right")) if g[0] == last else 0
            if same < b.num_rows:
                held.append(b.slice(0, same))
                yield pa.Table.from_batches(held)
                held, size, b = [], 0, b.slice(same)
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.Table.from_batches(held)
