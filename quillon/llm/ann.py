"""Largest inner products by vantage-point trees, one for each shard of the candidates.

In a shard of largest norm M, vectors gain the component sqrt(M^2 - |x|^2) and queries a zero: then
the nearest by Euclidean distance has the largest inner product, and the triangle inequality holds. A
node keeps a vantage point, and its points by distance from it in two halves, ties split by place, with the
largest distance of the near half and the least of the far half; a batch of queries descends together, closer
half first, and enters the other where its gap to d * factor <= distance of the k-th best: factor
1 is exact search, larger factors prune more. Scores are inner products of the original vectors.

Queries go to all shards in blocks (a stated query set against all rows); a shard and a block of
queries make one bounded task, and the k best of each shard merge by a window over the query.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; a
query with fewer candidates gets all; vectors of another width are no candidates; repeated rows
other than the query's own vec_id are candidates each, and a repeated query row asks once; vectors so long that
squares overflow are searched without a tree, infinite products tie, and products that are no number take no part; ties go to the smaller vec_id: trees hold distinct vectors, each with
its smallest ids, and scores that rounding alone could part are computed alike before the k-th is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import matrix, rowwise_dot, valid

NEAR = 1e-9  # of the product of norms: scores closer than this may differ by rounding alone, so they tie until they are computed alike


class VPTree:
    def __init__(self, x: np.ndarray, leaf: int, seed: int):
        self.x, self.leaf, self.rng = x, leaf, np.random.default_rng(seed)
        self.root = self.build(np.arange(len(x)))

    def build(self, at: np.ndarray):
        """A leaf's places, or (vantage point, largest near distance, least far distance, near, far); halves, so the depth is log n."""
        if len(at) <= self.leaf:
            return at
        vp = at[self.rng.integers(len(at))]
        d = np.sqrt(np.maximum(((self.x[at] - self.x[vp]) ** 2).sum(1), 0))
        half = len(at) // 2
        order = np.argpartition(d, (half - 1, half))
        near, far = order[:half], order[half:]
        return vp, d[near].max(), d[far].min(), self.build(at[near]), self.build(at[far])


def flat(x: np.ndarray, first: np.ndarray, second: np.ndarray, more: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As search, of all candidates, for products beyond the range of doubles."""
    at, best = np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(len(q)):
            score = np.concatenate([rowwise_dot(q[i][None], x[s : s + 4096]) for s in range(0, len(x), 4096)])
            mine = first == own[i]
            use = np.flatnonzero(~np.isnan(score) & ~(mine & ~more))
            order = use[np.lexsort((np.where(mine, second, first)[use], -score[use]))][:k]
            at[i, : len(order)], best[i, : len(order)] = order, score[order]
    return at, best


def search(x: np.ndarray, first: np.ndarray, second: np.ndarray, more: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, factor: float, leaf: int = 96, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(positions in x or -1, inner products) of the k best for each query, by score and then smallest id other than its own.

    x are distinct vectors, first and (where more) second their smallest ids; those that have only the query's own don't count."""
    with np.errstate(over="ignore"):
        norm, qq = rowwise_dot(x, x), rowwise_dot(q, q)
    top = norm.max()
    if max(top, qq.max()) > 1e300:
        return flat(x, first, second, more, q, own, k)
    lifted = np.column_stack([x, np.sqrt(np.maximum(top - norm, 0))])
    tree = VPTree(lifted, leaf, seed)
    close = NEAR * np.sqrt(qq * top)
    flat_q = np.column_stack([q, np.zeros(len(q))])
    best, at, low = np.full((len(q), k), -np.inf), np.full((len(q), k), -1), np.zeros((len(q), k), first.dtype)

    def meet(part: np.ndarray, who: np.ndarray) -> None:
        score = q[who] @ x[part].T
        mine = own[who][:, None] == first[part][None, :]
        score[mine & ~more[part]] = -np.inf
        least = best[who, -1]
        if len(part) > k:
            least = np.maximum(least, np.partition(score, len(part) - k, axis=1)[:, len(part) - k])
        i, j = np.nonzero((score >= (least - close[who])[:, None]) & np.isfinite(score))
        if not len(i):
            return
        some, i = np.unique(i, return_inverse=True)
        w, v = who[some], part[j]
        exact = np.concatenate([rowwise_dot(q[w[i[s : s + 65536]]], x[v[s : s + 65536]]) for s in range(0, len(i), 65536)])
        number = np.where(first[v] == own[w[i]], second[v], first[v])
        row, score = np.concatenate([np.repeat(np.arange(len(w)), k), i]), np.concatenate([best[w].ravel(), exact])
        place, number = np.concatenate([at[w].ravel(), v]), np.concatenate([low[w].ravel(), number])
        order = np.lexsort((number, -score, row))
        begin = np.searchsorted(row[order], np.arange(len(w)))
        pick = order[begin[:, None] + np.arange(k)]
        best[w], at[w], low[w] = score[pick], place[pick], number[pick]

    def visit(node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            for s in range(0, len(node), 1024):
                for r in range(0, len(who), 2048):
                    meet(node[s : s + 1024], who[r : r + 2048])
            return
        vp, inside, outside, near, far = node
        d = np.sqrt(np.maximum(((flat_q[who] - lifted[vp]) ** 2).sum(1), 0))
        inner = d < (inside + outside) / 2
        visit(near, who[inner])
        visit(far, who[~inner])
        tau = np.sqrt(np.maximum(qq[who] + top - 2 * best[who, -1], 0) + 1e-12 * (qq[who] + top))  # of the k-th best so far; infinite before k
        visit(far, who[inner & ((outside - d) * factor <= tau + 1e-9)])
        visit(near, who[~inner & ((d - inside) * factor <= tau + 1e-9)])

    visit(tree.root, np.arange(len(q)))
    at[~np.isfinite(best)] = -1
    return at, best


def distinct(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors; the ids of all, by vector and size, and the vectors' bounds in them. An id has k rows of a vector at most, a vector 2k."""
    x = np.ascontiguousarray(x + 0.0)  # no -0.0
    _, at, group = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    group = group.ravel()
    order = np.lexsort((ids, group))
    for key in (np.stack([group, ids], 1), group[:, None]):
        sorted_key = key[order]
        new = np.append(True, (sorted_key[1:] != sorted_key[:-1]).any(1))
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        order = order[np.arange(len(order)) - begin < (k if key.shape[1] == 2 else 2 * k)]
    bounds = np.searchsorted(group[order], np.arange(len(at) + 1))
    return x[at], ids[order], bounds[:-1], bounds[1:]


def nearest(rows: DataFrame, is_query, *, k: int = 20, factor: float = 1.2, shard: int = 8192, query_block: int = 16384) -> DataFrame:
    """rows(vec_id, embedding) as (query_id, rank, vec_id, score): the k nearest found of each query row."""
    good = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(valid(F.col("embedding")) & F.col("vec_id").isNotNull())
    good = good.select("vec_id", "x", F.size("x").alias("w"))
    n = rows.count()
    shards, n_blocks = max(1, -(-n // shard)), max(1, -(-good.where(is_query).select("vec_id").count() // query_block))
    base = good.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asked = good.where(is_query).dropDuplicates(["vec_id", "x"]).withColumn("q", F.xxhash64("x")).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "q": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        x, q = matrix(left.column("x").combine_chunks()), matrix(right.column("x").combine_chunks())
        ids, own, code = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy(), right.column("q").to_numpy()
        x, ids, begin, end = distinct(x, ids, k)
        first = ids[begin]
        last = ids[end - 1]  # of the 2k smallest; more than one id if it differs
        second = np.array([ids[b + np.searchsorted(ids[b:e], ids[b], "right")] if ids[b] != ids[e - 1] else ids[b] for b, e in zip(begin, end)], ids.dtype)
        at, best = search(x, first, second, first != last, q, own, min(k, len(x)), factor)
        i, j = np.nonzero(at >= 0)
        v, score = at[i, j], best[i, j]
        size = end[v] - begin[v]
        i, score, v = np.repeat(i, size), np.repeat(score, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[v], size)
        other = ids[v] != own[i]
        i, score, v = i[other], score[other], v[other]
        order = np.lexsort((ids[v], -score, i))
        i, v, score = i[order], v[order], score[order]
        first = np.searchsorted(i, np.arange(len(q)))
        keep = np.arange(len(i)) - first[i] < k
        return pa.table({"query_id": own[i[keep]], "q": code[i[keep]], "vec_id": ids[v[keep]], "score": score[keep]})

    parts = base.groupBy("shard", "block", "w").cogroup(asked.groupBy("shard", "block", "w")).applyInArrow(run, "query_id long, q long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
