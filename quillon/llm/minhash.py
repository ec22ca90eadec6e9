"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF word shingles.

1. A task hashes its documents' shingles of five words, up to 1,024 documents (a slice) at a time, and
   sends them sorted, as 54 bits of hash with 10 bits of document, in blobs by range of hash. A shingle of
   64 or more of a slice's documents goes to its range once, with their number; so one that a third of all
   documents share costs its range 16 bytes for each slice.
2. Per range, document frequencies over all documents follow from one sort. Shingles of one document
   alone go no further: for a weighted Jaccard similarity s, shared shingles must hold the share s
   of a document's whole weight. The rest returns to its slice.
3. Per slice, documents that can reach the threshold get weights tf * idf (a shingle of one document
   counts as one of two, so that in a pair an edit weighs what it replaces) and band keys from
   consistent weighted samples (ICWS: a hash draws r, c and beta for each shingle and function).
4. Bands link documents to the smallest key of their bucket; connected components of these links are
   the candidate groups. Each group is verified with weighted Jaccard similarities of the original
   vectors: every pair of it that isn't yet joined, in blocks of bounded size, so a group of any
   size loses no link between its members.

Texts are known by 128-bit digests: whole copies are one text, and doc_ids may repeat or be null. Slices
are numbered by place, so an input that isn't read from files alone is first written to the shared folder:
a task that runs again reads the same rows. Texts of more than a million bytes are read in pieces.

Defined cases: a stretch of half a million bytes without white space is cut into words; null, empty and blank texts have no shingles and are alone in their class; texts of
one to four words are one shingle; repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, gives_back, mix64, partitions, pieces, small_batches
from .suffix_dedup import BYTE, R, text_key

SLICE_BITS = 10
SLICE = 1 << SLICE_BITS
SLICE_BYTES = 1 << 23
LOW = np.uint64(SLICE - 1)
_powers: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n."""
    size = max(1 << 20, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        a, b = np.full(size, R, np.uint64), np.full(size, pow(R, -1, 1 << 64), np.uint64)
        a[0] = b[0] = 1
        _powers[size] = np.cumprod(a), np.cumprod(b)
    return _powers[size][0][:n], _powers[size][1][:n]


def shingle_hashes(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle of n words, repeats included; words lie between ASCII white space."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    doc_at = np.cumsum(size) - size
    word = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.diff(np.r_[np.int8(0), word.view(np.int8)])
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * up[:-1], out=total[1:])
    h = mix64((total[stop] - total[start]) * down[start])
    doc = np.searchsorted(doc_at, start, "right") - 1
    count = np.bincount(doc, minlength=len(texts))
    mult = [np.uint64(pow(R, k + 1, 1 << 64)) for k in range(n)]
    m = max(0, len(h) - n + 1)
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc += h[k : k + m] * mult[k]
    whole = doc[:m] == doc[n - 1 :] if m else np.zeros(0, bool)
    docs, hashes = [doc[:m][whole]], [mix64(acc[whole])]
    first = np.cumsum(count) - count
    for d in np.flatnonzero((count > 0) & (count < n)):
        x = np.uint64(0)
        with np.errstate(over="ignore"):
            for k in range(count[d]):
                x = x + h[first[d] + k] * mult[k]
        docs.append(np.array([d])), hashes.append(mix64(np.array([x], np.uint64)))
    return np.concatenate(docs), np.concatenate(hashes)


def read_again(docs: DataFrame) -> DataFrame:
    """docs, as files give the same rows in the same order again; what comes from a shuffle is written first."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    return cut(docs) if re.search("Aggregate|Join|Repartition|Rebalance|Window|Sort|Limit|Distinct|Sample|LogicalRDD", plan) else docs


def slice_shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (hash and document) of the texts' shingles, and how often each occurs."""
    found, held, docs, size = [np.zeros(0, np.uint64)], [], [], 0
    for i, t in enumerate(texts):
        for _, piece in pieces(t, 1 << 20, n - 1):
            held.append(piece), docs.append(i)
            size += len(piece)
            if size >= 1 << 20:
                d, h = shingle_hashes(held, n)
                found.append((h & ~LOW) | np.array(docs, np.uint64)[d])
                held, docs, size = [], [], 0
    if held:
        d, h = shingle_hashes(held, n)
        found.append((h & ~LOW) | np.array(docs, np.uint64)[d])
    x = np.sort(np.concatenate(found))
    new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])[: len(x)]
    return x[new], np.diff(np.r_[new, len(x)])


def hashed(docs: DataFrame, ranges: int, n: int, frequent: int) -> DataFrame:
    """Blobs by range of hash: (r, base, keys, more, many, k, total, held, held_tf). keys: hash and document of the slice; more:
    (place in keys, tf) where tf > 1; many: (place, documents) of frequent shingles; one row of each slice has its
    documents' k and total and, held, the keys of its frequent shingles with their tf."""
    bits = ranges.bit_length() - 1

    def blobs(base: int, keys: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
        x, tf = slice_shingles(texts, n)
        total = np.bincount((x & LOW).astype(np.int64), weights=tf, minlength=len(texts))
        h = x & ~LOW
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[: len(h)]
        count = np.diff(np.r_[new, len(h)])
        often = np.repeat(count >= frequent, count)
        held, held_tf = x[often], tf[often]
        x, tf, docs = np.r_[x[~often], h[new[count >= frequent]]], np.r_[tf[~often], np.ones((count >= frequent).sum(), np.int64)], np.r_[np.ones((~often).sum(), np.int64), count[count >= frequent]]
        order = np.argsort(x, kind="stable")
        x, tf, docs = x[order], tf[order], docs[order]
        edges = np.searchsorted(x, np.arange(ranges, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(x)]
        out = [[] for _ in range(9)]
        pack = lambda v, z: np.stack([m := np.flatnonzero(v[z] > 1), v[z][m]]).astype("<u4").tobytes()
        for r in range(ranges):
            z = slice(edges[r], edges[r + 1])
            own = r == (base // SLICE) % ranges
            if edges[r] == edges[r + 1] and not own:
                continue
            mine = (b"".join(keys), total.tobytes(), held.tobytes(), held_tf.astype("<u4").tobytes()) if own else (None,) * 4
            for c, v in zip(out, (r, base, x[z].tobytes(), pack(tf, z), pack(docs, z), *mine)):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *[pa.array(c, pa.binary()) for c in out[2:]]], names=["r", "base", "keys", "more", "many", "k", "total", "held", "held_tf"])

    def run(batches):
        base, keys, texts, size = TaskContext.get().partitionId() << 36, [], [], 0
        for b in batches:
            for s in range(0, b.num_rows, 128):
                part = b.slice(s, 128)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    keys.append(k), texts.append((t or "").lower().encode("utf-8", "surrogatepass"))
                    size += len(texts[-1])
                    if len(keys) == SLICE or size >= SLICE_BYTES:
                        yield blobs(base, keys, texts)
                        base, keys, texts, size = base + SLICE, [], [], 0
        if keys:
            yield blobs(base, keys, texts)

    return docs.mapInArrow(gives_back(run), "r int, base long, keys binary, more binary, many binary, k binary, total binary, held binary, held_tf binary")


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of rows that share the first column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        c = b.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
        for s, e in zip(edges[:-1], edges[1:]):
            if held and held[-1].column(0)[0].as_py() != c[s]:
                yield pa.Table.from_batches(held)
                held = []
            if e > s:
                held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def shared(blobs: DataFrame, ranges: int) -> DataFrame:
    """Per range and slice the shingles of several documents: (base, keys, df, tf, often), and the slices' own columns."""

    def run(batches):
        for t in by_group(batches):
            base, keys = t.column(1).to_numpy(), t.column(2).to_pylist()
            x = np.concatenate([np.frombuffer(k, np.uint64) for k in keys])
            size = np.array([len(k) // 8 for k in keys])
            tf, docs = np.ones(len(x), np.uint32), np.ones(len(x), np.uint32)
            for values, column in ((tf, 3), (docs, 4)):
                for at, m in zip(np.cumsum(size) - size, t.column(column).to_pylist()):
                    place, times = np.frombuffer(m, "<u4").reshape(2, -1)
                    values[at + place] = times
            h = x & ~LOW
            order = np.argsort(h)
            s = h[order]
            new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])[: len(s)]
            df = np.empty(len(x), np.uint32)
            if len(x):
                df[order] = np.repeat(np.add.reduceat(docs[order].astype(np.int64), new).astype(np.uint32), np.diff(np.r_[new, len(s)]))
            out, at = [], 0
            for i, n in enumerate(size):
                z = slice(at, at + n)
                keep = df[z] > 1
                at += n
                own = [t.column(c)[i].as_py() for c in (5, 6, 7, 8)]
                if keep.any() or own[0] is not None:
                    out.append((int(base[i]), x[z][keep].tobytes(), df[z][keep].tobytes(), tf[z][keep].tobytes(), (docs[z][keep] > 1).tobytes(), *own))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["base", "keys", "df", "tf", "often", "k", "total", "held", "held_tf"])

    return blobs.repartition(max(2, ranges // 2), "r").sortWithinPartitions("r").mapInArrow(gives_back(run), "base long, keys binary, df binary, tf binary, often binary, k binary, total binary, held binary, held_tf binary")


def icws(h: np.ndarray, w: np.ndarray, starts: np.ndarray, functions: int, seed: int) -> np.ndarray:
    """Consistent weighted samples: hashes (functions, sets) of each set's sampled (element, level).

    h, w: elements and positive weights of all sets, one set after another, by rising hash."""
    out = np.empty((functions, len(starts)), np.uint64)
    lnw, part, sizes = np.log(w).astype(np.float32), np.uint64((1 << 21) - 1), np.diff(np.r_[starts, len(h)])
    unit = lambda x, s: (((x >> np.uint64(s)) & part).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21)
    for j in range(functions):
        x = mix64(h + np.uint64(((2 * (j + seed) + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
        y = mix64(x)
        r = -np.log(unit(x, 0) * unit(x, 21))
        ln_c = np.log(-np.log(unit(x, 42) * unit(y, 0)))
        beta = unit(y, 21)
        t = np.floor(lnw / r + beta)
        ln_a = ln_c - r * (t - beta) - r
        low = np.minimum.reduceat(ln_a, starts)
        hit = np.flatnonzero(ln_a == np.repeat(low, sizes))
        own = np.searchsorted(starts, hit, "right") - 1
        hit = hit[np.r_[True, own[1:] != own[:-1]]]
        out[j] = mix64(h[hit] ^ mix64(t[hit].astype(np.int64).view(np.uint64)))
    return out


def vectors(parts: DataFrame, n_docs: int, threshold: float, bands: int, rows: int, seed: int) -> DataFrame:
    """(k, total, hashes, weights, keys): documents whose shared shingles may reach the threshold, with band keys."""
    idf = lambda df: np.log((1.0 + n_docs) / (1.0 + np.maximum(df, 2))) + 1.0

    def run(batches):
        for t in by_group(batches):
            col = lambda i, kind: np.concatenate([np.frombuffer(v, kind) for v in t.column(i).to_pylist()])
            x, df, tf, often = col(1, np.uint64), col(2, np.uint32), col(3, np.uint32), col(4, np.bool_)
            own = next(i for i in range(t.num_rows) if t.column(5)[i].as_py() is not None)
            k, total = t.column(5)[own].as_py(), np.frombuffer(t.column(6)[own].as_py(), np.float64)
            held, held_tf = np.frombuffer(t.column(7)[own].as_py(), np.uint64), np.frombuffer(t.column(8)[own].as_py(), "<u4")
            frequent, order = x[often], np.argsort(x[often])
            held_df = df[often][order][np.searchsorted(frequent[order], held & ~LOW)] if len(held) else np.zeros(0, np.uint32)
            x, df, tf = np.r_[x[~often], held], np.r_[df[~often], held_df], np.r_[tf[~often], held_tf]
            w = (tf * idf(df)).astype(np.float32)
            d = (x & LOW).astype(np.int64)
            some, times = np.bincount(d, weights=w, minlength=len(total)), np.bincount(d, weights=tf, minlength=len(total))
            weight = some + (total - times) * idf(1)
            can = (some >= (threshold - 1e-6) * weight) & (total > 0)
            keep = can[d]
            x, w, d = x[keep] & ~LOW, w[keep], d[keep]
            if not len(x):
                continue
            order = np.lexsort((x, d))
            x, w, d = x[order], w[order], d[order]
            starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            sig = icws(x, w, starts, bands * rows, seed)
            keys = np.empty((len(starts), bands), np.uint64)
            for b in range(bands):
                acc = np.full(len(starts), b + 1, np.uint64)
                for j in range(rows):
                    acc = mix64(acc ^ sig[b * rows + j])
                keys[:, b] = acc
            ends = np.r_[starts[1:], len(x)]
            doc = d[starts]
            for s in range(0, len(doc), 256):
                z = range(s, min(s + 256, len(doc)))
                cols = [pa.array([k[16 * doc[i] : 16 * doc[i] + 16] for i in z], pa.binary()), pa.array([weight[doc[i]] for i in z], pa.float64()), pa.array([x[starts[i] : ends[i]].tobytes() for i in z], pa.binary()), pa.array([w[starts[i] : ends[i]].tobytes() for i in z], pa.binary()), pa.array([keys[i].view(np.int64) for i in z], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "total", "hashes", "weights", "keys"])

    return parts.repartition("base").sortWithinPartitions("base").mapInArrow(gives_back(run), "k binary, total double, hashes binary, weights binary, keys array<long>")


def linked(hashes: list[np.ndarray], weights: list[np.ndarray], totals: np.ndarray, threshold: float) -> np.ndarray:
    """The component of each set (its smallest member's place) under weighted Jaccard similarity >= threshold.

    Every pair is compared unless its members are joined already or their totals rule it out."""
    m = len(hashes)
    comp = np.arange(m)
    size = np.array([len(h) for h in hashes])
    _, f = np.unique(np.concatenate(hashes), return_inverse=True)
    w = np.concatenate(weights).astype(np.float64)
    at = np.r_[0, np.cumsum(size)]
    dense = np.zeros(int(f.max()) + 1)
    for i in range(m - 1):
        other = np.arange(i + 1, m)
        t = totals[i + 1 :]
        other = other[(comp[i + 1 :] != comp[i]) & (np.minimum(t, totals[i]) >= (threshold - 1e-9) * np.maximum(t, totals[i]))]
        if not len(other):
            continue
        mine = slice(at[i], at[i + 1])
        dense[f[mine]] = w[mine]
        n = size[other]
        begin = np.cumsum(n) - n
        e = np.arange(n.sum()) - np.repeat(begin, n) + np.repeat(at[other], n)
        common = np.add.reduceat(np.minimum(w[e], dense[f[e]]), begin)
        dense[f[mine]] = 0
        for j in other[common >= (threshold - 1e-9) * (totals[i] + totals[other] - common)]:
            if comp[j] != comp[i]:
                low, high = sorted((comp[i], comp[j]))
                comp[comp == high] = low
    return comp


def near_classes(docs: DataFrame, *, words: int = 5, threshold: float = 0.8, bands: int = 14, rows: int = 3, seed: int = 1, block: int = 1_500_000, frequent: int = 64) -> DataFrame:
    """(k, rep): each text that may be a near copy, by text_key, with the smallest key of its class. Other texts are alone."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = read_again(docs.select("text"))
    ranges = 1 << max(4, (2 * partitions(spark) - 1).bit_length())
    n_docs = docs.count()
    keyed = docs.select(text_key(F.col("text")).alias("k"), "text")
    vec = cut(vectors(shared(hashed(keyed, ranges, words, frequent), ranges), n_docs, threshold, bands, rows, seed))
    keys = vec.select("k", F.posexplode("keys").alias("band", "key")).distinct()
    low = keys.groupBy("band", "key").agg(F.min("k").alias("v"), F.max("k").alias("high")).where("v <> high").drop("high")
    groups = cut(components(keys.join(low, ["band", "key"]).select(F.col("k").alias("u"), "v")).select(F.col("node").alias("k"), F.col("component").alias("g")))
    n = groups.count()
    side = F.broadcast(groups) if n * 64 <= 16 << 20 else groups  # by its size; otherwise a shuffled join
    members = vec.drop("keys").join(side, "k")
    sizes = vec.select("k", F.length("hashes").alias("n")).join(side, "k").groupBy("g").agg((F.sum("n") / 8).alias("n"))
    big = cut(sizes.where(F.col("n") > block).select("g", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    split = big.count() > 0
    if split:
        x = members.join(big, "g", "left").withColumn("b", F.pmod(F.xxhash64("k"), F.coalesce("blocks", F.lit(1))).cast("int"))
        x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        members = x.withColumn("g", F.concat("g", F.encode(F.concat_ws(",", F.least("b", "o"), F.greatest("b", "o")), "utf-8"))).select(*members.columns)

    def verify(batches):
        for t in by_group(batches):
            row = {k: i for i, k in enumerate(t.column(1).to_pylist())}  # a text once, of however many copies
            k, at = list(row), list(row.values())
            hashes, weights = t.column(3).to_pylist(), t.column(4).to_pylist()
            comp = linked([np.frombuffer(hashes[i], np.uint64) for i in at], [np.frombuffer(weights[i], np.float32) for i in at], t.column(2).to_numpy()[at], threshold)
            low = {}
            for key, c in zip(k, comp.tolist()):
                low[c] = min(low.get(c, key), key)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array([low[c] for c in comp.tolist()], pa.binary())], names=["k", "rep"])

    found = members.select("g", "k", "total", "hashes", "weights").repartition("g").sortWithinPartitions("g").mapInArrow(gives_back(verify), "k binary, rep binary")
    joined = side.select("k")
    if split:
        found = cut(components(found.select(F.col("k").alias("u"), F.col("rep").alias("v"))).select(F.col("node").alias("k"), F.col("component").alias("rep")))
        joined = found.select("k")  # what no link joins is missing there
    alone = vec.select("k").distinct().join(joined, "k", "left_anti").select("k", F.col("k").alias("rep"))
    return found.unionByName(alone)


def dedup(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, k, class_id, class_size, kept): class_id is the smallest doc_id of the class; one row of each is kept."""
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("k"))
    classes = near_classes(docs, **options)
    per_text = keyed.groupBy("k").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    x = per_text.join(classes, "k").select("k", "rep", "low", "n")
    of_class = x.groupBy("rep").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    x = x.join(of_class, "rep").select("k", "class_id", "class_size", "rep")
    r = keyed.join(x, "k", "left")
    return r.select("doc_id", "k", F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.when(F.col("rep").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without near copies: of each class the row with the smallest doc_id, text key stays, once."""
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("k"))
    classes = cut(near_classes(docs, **options))
    x = keyed.join(classes, "k")
    best = x.groupBy("rep").agg(F.min(F.struct("doc_id", "k")).alias("best"))
    drop = cut(x.join(best, "rep").where(~F.struct("doc_id", "k").eqNullSafe(F.col("best"))).select(F.col("doc_id").alias("_d"), F.col("k").alias("_k")).distinct())
    again = x.join(best, "rep").where(F.struct("doc_id", "k").eqNullSafe(F.col("best"))).groupBy("doc_id", "k").count().where("count > 1")
    side = F.broadcast(drop) if drop.count() * 64 <= 16 << 20 else drop  # by its size; otherwise a shuffled join
    on = F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_k") == text_key(F.col("text")))
    kept = docs.join(side, on, "left_anti")
    if again.isEmpty():
        return kept
    twice = again.select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"))
    one = kept.join(twice, on, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, on, "left_anti").unionByName(one)
