"""Suffix-array removal of repeated byte strings, by blockwise difference-cover sorting.

Suffixes are sorted only to the depth that matters, `length` bytes, one bucket at a time. A suffix's
bucket is the smallest hash of a 32-byte gram in its first `length` bytes, so equal strings always
meet in one bucket whatever document they start in, and buckets whose hash occurs once are never
built. A block of buckets is concatenated; ranks of the suffixes at a difference-cover sample of its
positions are computed by prefix doubling; suffixes are sorted by bucket and first 32 bytes, and long
ties are resolved by the cover ranks at the offset that the two positions' residues share. Neighbours
in that order with a common prefix of `length` bytes mark each other.

A bucket of more than `hot` bytes (a licence that a third of all texts hold, say) is salted by places into
sub-buckets of about that size, each suffix-sorted like any other; of each, one place of every distinct
string goes on by its 128-bit hash, and strings that several sub-buckets hold are marked at these places.

Texts that occur as whole copies are sorted once, as one text; they are removed entirely if they have
`length` bytes. Keys are 128-bit digests of texts, so null or repeated doc_ids don't matter. Texts are read
in windows of `WINDOW` bytes that overlap by length - 1, so memory is bounded for a text of any size
but for a few copies of its bytes. A join on k with a text that a third of all rows hold is one that
adaptive execution splits: the side of this operator has one row for each k.

Defined cases: null text is empty (n_bytes 0, nothing removed); texts shorter than `length` keep all;
repeated rows count as copies; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, gives_back, mix64, slices, small_batches

GRAM = 32
WINDOW = 1 << 18
V, COVER = 31, (1, 5, 11, 24, 25, 27)  # every difference modulo 31 is one of two members
IN_COVER = np.full(V, -1, np.int64)
IN_COVER[list(COVER)] = np.arange(len(COVER))
DELTA = np.array([[next(d for d in range(V) if (i + d) % V in COVER and (j + d) % V in COVER) for j in range(V)] for i in range(V)])
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
R = 0x9E3779B97F4A7C15


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def grams_and_minima(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 32-byte grams, and for each start the smallest one within `length` bytes."""
    h, s = BYTE[buf], 1
    while s < GRAM:
        h = h[:-s] * np.uint64(pow(R, s, 1 << 64)) + h[s:]
        s *= 2
    h = mix64(h)
    w, m, s = length - GRAM + 1, h, 1
    while s * 2 <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return h, np.minimum(m[: len(m) - (w - s)], m[w - s :])


def runs(texts: list[bytes], length: int, block: int = 1 << 16) -> Iterator[tuple]:
    """Maximal runs of starts with one minimum: (document, first, last, minimum, repeats within) as arrays; a window's end ends a run."""
    group, begins, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, WINDOW):
            group.append(i), begins.append(at), held.append(t[at : at + WINDOW + length - 1])
            size += len(held[-1])
            if size >= block:
                yield _runs(np.array(group), np.array(begins), held, length)
                group, begins, held, size = [], [], [], 0
    if group:
        yield _runs(np.array(group), np.array(begins), held, length)


def _runs(group: np.ndarray, begins: np.ndarray, held: list[bytes], length: int) -> tuple:
    h, m = grams_and_minima(np.frombuffer(b"".join(held), np.uint8), length)
    sizes = np.array([len(t) for t in held])
    begin = np.cumsum(sizes) - sizes
    at = np.concatenate([np.arange(b, b + n - length + 1) for b, n in zip(begin, sizes)])
    doc = np.repeat(np.arange(len(group)), sizes - length + 1)
    v = m[at]
    new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    own = np.r_[0, np.cumsum(h[at] == v)]
    shift = (begins - begin)[doc[new]]
    return group[doc[new]], at[new] + shift, at[last] + shift, v[new], own[last] > own[new]


def anchors(keyed: DataFrame, length: int) -> DataFrame:
    """(h, k, own, size): each document's minima once; own: it may hold a repeat within the document; size: bytes of its runs."""

    def find(batches):
        for b in slices(batches):
            keys, found = b.column(0), list(runs(b.column(1).to_pylist(), length))
            if not found:
                continue
            doc, first, last, v, own = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((v, doc))
            d, x, o, n = doc[order], v[order], own[order], (last - first + length)[order]
            new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])])
            several = np.diff(np.r_[new, len(d)]) > 1
            yield pa.RecordBatch.from_arrays([pa.array(x[new].view(np.int64)), keys.take(pa.array(d[new])), pa.array(np.logical_or.reduceat(o, new) | several), pa.array(np.add.reduceat(n, new))], names=["h", "k", "own", "size"])

    return keyed.mapInArrow(gives_back(find), "h long, k binary, own boolean, size long")


def dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    s = key[order]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]]).astype(np.uint64)
    return rank


def cover_ranks(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks, to at least depth bytes, of the suffixes at the cover's positions, in order of position."""
    at = (np.arange(-(-n // V))[:, None] * V + np.array(COVER)).ravel()
    size = len(at)
    rank = dense(words[np.minimum(at, n)])
    for k in range(1, 4):
        rank = dense(rank << np.uint64(32) | dense(words[np.minimum(at + 8 * k, n)]))
    step = 1
    while step * V < depth:
        ahead = np.zeros(size, np.uint64)
        if step * len(COVER) < size:
            ahead[: size - step * len(COVER)] = rank[step * len(COVER) :] + np.uint64(1)
        rank = dense(rank << np.uint64(32) | ahead)
        step *= 2
    return rank.astype(np.int64)


def repeated(buf: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Which of the starts `at` (ascending) share their first `length` bytes with another of their bucket."""
    n = len(buf)
    words = np.zeros(n + length + 16, np.uint64)
    words[:n] = buf
    for s in (1, 2, 4):
        words[:-s] = words[:-s] << np.uint64(8 * s) | words[s:]
    rank = cover_ranks(words, n, length)
    cover = lambda p: rank[p // V * len(COVER) + IN_COVER[p % V]]
    # buckets, then the first 32 bytes; what is alone drops out
    group, slot = dense(bucket), np.arange(len(at))
    for k in range(4):
        key = group << np.uint64(32) | dense(words[at[slot] + 8 * k])
        order = np.argsort(key)
        s = key[order]
        first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
        label = np.cumsum(first) - 1
        several = np.bincount(label)[label] > 1 if len(s) else first
        slot, group = slot[order][several], label[several].astype(np.uint64)
    result = np.zeros(len(at), bool)
    if not len(slot):
        return result
    pos, tie = at[slot], dense(group).astype(np.int64)
    prefix = tie.copy()  # neighbours are compared within a tie of 32 bytes
    active, part = np.arange(len(pos)), tie
    while len(active):
        p = pos[active]
        new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        count = np.diff(np.r_[new, len(part)])
        pivot = np.repeat(p[new + count // 2], count)
        d = DELTA[p % V, pivot % V]
        order_of = np.sign(cover(p + d) - cover(pivot + d))
        order = np.lexsort((order_of, part))
        pos[active], slot[active] = p[order], slot[active][order]
        c, g = order_of[order], part[order]
        same = c == 0
        result[slot[active[same & (np.repeat(np.add.reduceat(same.astype(np.int64), new), count) > 1)]]] = True
        fresh = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]
        label = np.cumsum(fresh) - 1
        left = ~same & (np.bincount(label)[label] > 1)
        active, part = active[left], label[left]
    a, b = pos[:-1], pos[1:]
    pair = np.flatnonzero((prefix[1:] == prefix[:-1]) & ~(result[slot[:-1]] & result[slot[1:]]))
    for k in [*range(32, length - 7, 8), length - 8]:
        pair = pair[words[a[pair] + k] == words[b[pair] + k]]
    result[slot[pair]] = result[slot[pair + 1]] = True
    return result


def segments(texts: DataFrame, length: int) -> DataFrame:
    """(g, k, first, seg, hot): runs whose minimum is among the text's shared ones, with the bytes of all their strings.

    texts(k, t, shared, salts): minima and into how many sub-buckets g each one's bucket is salted."""

    def cut_out(batches):
        for b in slices(batches):
            keys, data = b.column(0), b.column(1).to_pylist()
            salt = np.array([int.from_bytes(k[:7], "little") for k in keys.to_pylist()], np.int64)
            shared, salts = [], []
            for x, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                own = np.array(x, np.int64).view(np.uint64)
                order = np.argsort(own)
                shared.append(own[order]), salts.append(np.array(n, np.int64)[order])
            for doc, first, last, v, _ in runs(data, length):
                keep, n = np.zeros(len(doc), bool), np.ones(len(doc), np.int64)
                edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
                for s, e in zip(edges[:-1], edges[1:]):
                    own = shared[doc[s]]
                    at = np.minimum(np.searchsorted(own, v[s:e]), len(own) - 1)
                    keep[s:e], n[s:e] = own[at] == v[s:e], salts[doc[s]][at]
                doc, first, last, v, n = doc[keep], first[keep], last[keep], v[keep], n[keep]
                part = (mix64((salt[doc] ^ first >> 16).view(np.uint64)) % n.astype(np.uint64)).astype(np.uint64)
                g = np.where(n > 1, mix64(v ^ mix64(part + np.uint64(1))), v)
                for s in range(0, len(doc), 2048):
                    z = slice(s, s + 2048)
                    segs = [data[d][x : y + length] for d, x, y in zip(doc[z], first[z], last[z])]
                    yield pa.RecordBatch.from_arrays([pa.array(g[z].view(np.int64)), keys.take(pa.array(doc[z])), pa.array(first[z]), pa.array(segs, pa.binary()), pa.array(n[z] > 1)], names=["g", "k", "first", "seg", "hot"])

    # n comes along, so that all readers of the texts share one exchange
    return texts.select("k", "t", "shared", "salts", "n").mapInArrow(gives_back(cut_out), "g long, k binary, first long, seg binary, hot boolean")


def string_hashes(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """128-bit hashes of the strings of `length` bytes at the starts, from those of the 32-byte grams that tile them."""
    h, s = BYTE[buf], 1
    while s < GRAM:
        h = h[:-s] * np.uint64(pow(R, s, 1 << 64)) + h[s:]
        s *= 2
    a = b = np.zeros(len(at), np.uint64)
    for k in [*range(0, length - GRAM, GRAM), length - GRAM]:
        x = h[at + k]
        a, b = mix64(a ^ mix64(x)), mix64(b * np.uint64(R) + mix64(x + np.uint64(R)))
    return np.stack([a, b], 1)


def repeats(segs: DataFrame, length: int, block: int = 1 << 20, merge: bool = False) -> DataFrame:
    """(k, start, stop, a, b): bytes covered by strings that repeat in a bucket, b null; whole buckets at a time, in blocks of some MB.

    merge: also one place of each distinct string of a sub-bucket, with the halves a and b of its hash, stop null. a of other rows spreads them."""

    names = ["k", "start", "stop", "a", "b"]

    def solve(g: np.ndarray, keys: list, first: np.ndarray, segs: list[bytes], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in segs])
        begin = np.cumsum(sizes) - sizes
        n = sizes - length + 1
        row = np.repeat(np.arange(len(segs)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[row]
        buf = np.frombuffer(b"".join(segs), np.uint8)
        hit = repeated(buf, at, g[row], length)
        r, p = row[hit], at[hit]
        new = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)][: len(r)]
        stop = np.r_[new[1:], True][: len(r)]
        start = first[r[new]] + p[new] - begin[r[new]]
        spread = mix64(g[r[new]].view(np.uint64) ^ start.astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in r[new]], pa.binary()), pa.array(start), pa.array(start + p[stop] - p[new] + length), pa.array(spread), pa.nulls(len(start), pa.int64())], names=names)
        if merge:
            row, at = row[hot[row]], at[hot[row]]
            for s in range(0, len(at), 1 << 18):
                part, of = at[s : s + (1 << 18)], row[s : s + (1 << 18)]
                w = np.column_stack([string_hashes(buf, part, length), g[of].view(np.uint64)]).copy()
                _, once = np.unique(w.view("V24").ravel(), return_index=True)
                once.sort()
                for z in np.split(once, range(1 << 15, len(once), 1 << 15)):
                    a, b = (pa.array(w[z, i].view(np.int64)) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in of[z]], pa.binary()), pa.array(first[of[z]] + part[z] - begin[of[z]]), pa.nulls(len(z), pa.int64()), a, b], names=names)

    def blocks(batches):
        held, size = [], 0
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                g = part.column(0).to_numpy()
                if size >= block:
                    # the last bucket may go on; what is before it is whole
                    g0 = held[-1].column(0)[-1].as_py()
                    same = int(np.searchsorted(g, g0, "right")) if g[0] == g0 else 0
                    if same < len(g):
                        held.append(part.slice(0, same))
                        yield from solved(held)
                        held, size, part = [], 0, part.slice(same)
                held.append(part)
                size += part.column(3).nbytes
        if held:
            yield from solved(held)

    def solved(held):
        t = pa.Table.from_batches(held)
        return solve(t.column(0).to_numpy(), t.column(1).to_pylist(), t.column(2).to_numpy(), t.column(3).to_pylist(), t.column(4).to_numpy(zero_copy_only=False))

    return segs.repartition("g").sortWithinPartitions("g").mapInArrow(gives_back(blocks), "k binary, start long, stop long, a long, b long")


def remove_repeats(docs: DataFrame, *, length: int = 400, with_text: bool = False, hot: int = 2 << 20) -> DataFrame:
    """One row for each distinct text: (k, n_bytes, n_removed, n_spans, kept_sha256[, kept]).

    k is text_key(text); kept: the bytes that stay, as text (halves of letters that a cut leaves are left out)."""
    small_batches(docs.sparkSession)
    keyed = docs.select(text_key(F.col("text")).alias("k"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    # as a join would ask for it: so the exchange of the texts is the same for all its readers
    texts = keyed.where("k is not null").groupBy("k").agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("n"))
    found = cut(anchors(keyed, length))
    h = found.groupBy("h").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.max("own").alias("own"), F.sum("size").alias("size"))
    h = h.where("own or low <> high").select("h", F.ceil(F.col("size") / hot).alias("salts"))
    of_text = found.select("h", "k").join(h, "h").groupBy("k").agg(F.collect_set(F.struct("h", "salts")).alias("s"))
    of_text = cut(of_text.select("k", F.col("s.h").alias("shared"), F.col("s.salts").alias("salts")))
    split = not of_text.where("exists(salts, n -> n > 1)").isEmpty()
    spans = repeats(segments(texts.join(of_text, "k"), length), length, merge=split)
    if split:
        # one exchange of spans and places, and no checkpoint: so the texts' exchange is shared here too
        spans = spans.withColumn("n", F.count("b").over(Window.partitionBy("a", "b"))).where("stop is not null or n > 1")
        spans = spans.select("k", "start", F.coalesce("stop", F.col("start") + length).alias("stop"))
    spans = spans.groupBy("k").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def finish(batches):
        for b in slices(batches):
            n_bytes, removed, count, sha, kept = [], [], [], [], []
            for data, n, found in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)]):
                merged: list[list[int]] = []
                for x in [{"start": 0, "stop": len(data)}] if n > 1 and len(data) >= length else sorted(found or [], key=lambda x: x["start"]):
                    if merged and x["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["stop"])
                    else:
                        merged.append([x["start"], x["stop"]])
                ends = [0, *[y for x in merged for y in x], len(data)]
                rest = b"".join(data[s:e] for s, e in zip(ends[::2], ends[1::2]))
                n_bytes.append(len(data)), removed.append(len(data) - len(rest)), count.append(len(merged)), sha.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest.decode(errors="ignore"))
            cols = [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.string())] if with_text else []), names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    schema = "k binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    return texts.join(spans, "k", "left").select("k", "t", "n", "spans").mapInArrow(gives_back(finish), schema)
