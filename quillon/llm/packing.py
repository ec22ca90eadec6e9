"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents are tokenised in Arrow batches and cut into pieces of at most `capacity` ids. Pieces get
a salt and are written to the shared folder, so that a lost task can't salt them anew; by salts they go
to shards of a bounded number of documents, also where a third of all rows are one text. A shard's bin-packing problem is a histogram of
lengths; `islands` rows for each shard evolve populations apart from one another, in tasks of their
own, and between epochs each island's elite moves to the next island by a shuffle. A crossover
injects whole well-filled bins of one parent into the other, removes the bins that hold the same
documents, and places displaced documents by best fit. An island rests once it meets the lower bound.
The best solution of a shard then numbers its pieces, a shard in a task.

Defined cases: null or empty text is one piece, the end id 0 alone; repeated rows are packed each;
an empty table gives no rows; only doc_id and text are read; extra columns don't matter.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gives_back, mix64, partitions, slices, small_batches

SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_loaded: dict = {}


class WordTokenizer:
    """ids of a word-end BPE, as little-endian uint32 bytes, equal to the tokenizers library's.

    Words recur: two bounded generations of a cache keep their ids. A batch's new words go through
    tiktoken's merge loop in one call, each ended by the byte 0, which stands for the end-of-word
    mark. White space bounds every token, so chunks with letters beyond Latin, with byte 0 or with
    special tokens' strings go through the library alone."""

    def __init__(self, path: str, cache: int = 100_000):
        import regex
        import tiktoken

        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        byte = {c: b for b, c in char.items()}
        end = "</w>"
        raw = lambda s: bytes(byte[c] for c in s.removesuffix(end)) + b"\0" * s.endswith(end)
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(256)}
        ids = [vocab[char[b]] for b in range(256)] + [vocab[char[b] + end] for b in range(256)]
        for a, b in merges:
            ranks[raw(a + b)] = len(ids)
            ids.append(vocab[a + b])
        self.ids = np.array(ids, "<u4")
        self.ends = np.zeros(len(ids), bool)
        self.ends[[r for t, r in ranks.items() if t[-1] == 0]] = True
        self.core = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.ascii_words = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
        self.other = re.compile("[^\x01-\u024f]").search
        self.most, self.new, self.old = cache, {}, {}

    @property
    def slow(self):
        """The library's tokenizer, loaded where a text needs it."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def learn(self, words: set[str]) -> None:
        """Puts words into the newer generation of the cache."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        missing = []
        for w in words - self.new.keys():
            if w in self.old:
                self.new[w] = self.old[w]
            else:
                missing.append(w)
        if missing:
            ranks = self.core.encode_to_numpy("\0".join(missing) + "\0")
            data, at = self.ids[ranks].tobytes(), 0
            for w, e in zip(missing, ((np.flatnonzero(self.ends[ranks]) + 1) * 4).tolist()):
                self.new[w] = data[at:e]
                at = e

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        split = [self.ascii_words(t.lower()) if t.isascii() and "\0" not in t and "<|" not in t else None if self.other(t) or "<|" in t else self.words(t.lower()) for t in texts]
        self.learn(set().union(*[x for x in split if x is not None]))
        known = self.new
        return [b"".join([known[w] for w in x]) if x is not None else self.by_chunk(t) for t, x in zip(texts, split)]

    def by_chunk(self, text: str) -> bytes:
        out = []
        for c in text.replace("\n", " ").split(" "):
            if self.other(c) or any(s in c for s in SPECIAL):
                out.append(np.array(self.slow.encode(c, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                words = self.words(c.lower())
                self.learn(set(words))
                out += [self.new[w] for w in words]
        return b"".join(out)


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, salt[, ids]); every document ends with id 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        row = 0
        for batch in slices(batches, 256):
            ids, texts = batch.column(0), batch.column(1)
            at, n, start, length, crc, data = [], [], [], [], [], []
            for i, b in enumerate(tok.encode_batch([t or "" for t in texts.to_pylist()])):
                b += b"\0\0\0\0"
                for k in range(0, len(b), 4 * capacity):
                    part = b[k : k + 4 * capacity]
                    at.append(i), n.append(k // (4 * capacity)), start.append(k // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if keep_ids:
                        data.append(part)
            c = np.array(crc, np.uint64)
            salt = mix64(c ^ mix64(np.array(at, np.uint64) + np.uint64(row) << np.uint64(24) ^ np.array(n, np.uint64))) >> np.uint64(1)
            row += batch.num_rows
            cols = [ids.take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(salt.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(data, pa.binary())] if keep_ids else []), names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"] + ["ids"] * keep_ids)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(gives_back(cut_up), schema)


class Bins:
    """A partial packing: best fit over residual room, ties to the newest bin."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.room, self.sizes, self.at = capacity, [], [], [], defaultdict(list)

    def _file(self, b: int) -> None:
        r = self.room[b]
        if not self.at[r]:
            insort(self.sizes, r)
        self.at[r].append(b)

    def add_bin(self, items: list[int], length: list[int]) -> None:
        self.bins.append(list(items))
        self.room.append(self.capacity - sum(length[i] for i in items))
        self._file(len(self.bins) - 1)

    def place(self, i: int, n: int) -> None:
        k = bisect_left(self.sizes, n)
        if k == len(self.sizes):
            self.bins.append([i])
            self.room.append(self.capacity - n)
            self._file(len(self.bins) - 1)
            return
        r = self.sizes[k]
        b = self.at[r].pop()
        if not self.at[r]:
            del self.sizes[k]
        self.bins[b].append(i)
        self.room[b] = r - n
        self._file(b)


def best_fit(order, length: list[int], capacity: int, kept: list[list[int]] = ()) -> list[list[int]]:
    x = Bins(capacity)
    for b in kept:
        x.add_bin(b, length)
    for i in order:
        x.place(i, length[i])
    return x.bins


def fitness(bins: list[list[int]], length: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then Falkenauer's mean squared fill."""
    return -len(bins), sum((sum(length[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: list[list[int]], b: list[list[int]], length: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Whole well-filled bins of b enter a; bins of a that share items with them go; best fit places the displaced."""
    filled = sorted(b, key=lambda x: -sum(length[i] for i in x))
    good = filled[: max(1, int(len(filled) * rng.uniform(0.3, 0.9)))]
    taken = {i for x in good for i in x}
    stay = [x for x in a if not any(i in taken for i in x)]
    out = [i for x in a if any(j in taken for j in x) for i in x if i not in taken]
    out.sort(key=lambda i: -length[i])
    return best_fit(out, length, capacity, [*stay, *good])


def evolve(population: list, length: list[int], capacity: int, generations: int, rng: np.random.Generator, size: int = 6) -> list:
    """The population after some generations, best first; stops at the lower bound."""
    bound = -(-sum(length) // capacity)
    n = np.array(length)
    if not population:
        population = [best_fit(np.argsort(-n, kind="stable").tolist(), length, capacity)]
    if len(population[0]) > bound:
        while len(population) < size:
            noise = n * rng.uniform(0.8, 1.25, len(n))
            population.append(best_fit(np.argsort(-noise).tolist(), length, capacity))
    score = lambda x: fitness(x, length, capacity)
    population.sort(key=score, reverse=True)
    for _ in range(generations):
        if len(population[0]) <= bound:
            break
        i, j = rng.choice(len(population), 2, replace=False)
        child = crossover(population[min(i, j)], population[max(i, j)], length, capacity, rng)
        population[-1] = child
        population.sort(key=score, reverse=True)
    return population


def _dump(bins: list[list[int]]) -> bytes:
    flat = [x for b in bins for x in (*b, -1)]
    return np.array(flat, "<i4").tobytes()


def _load(data: bytes) -> list[list[int]]:
    x = np.frombuffer(data, "<i4")
    ends = np.flatnonzero(x == -1)
    return [x[s:e].tolist() for s, e in zip(np.r_[0, ends[:-1] + 1] if len(ends) else [], ends)]


def pack(docs: DataFrame, path: str, *, capacity: int = 2048, shard_docs: int = 4096, islands: int = 2, epochs: int = 2, generations: int = 12, seed: int = 7, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    small_batches(docs.sparkSession)
    shards = max(1, -(-docs.count() // shard_docs))
    cut_up = cut(pieces(docs, path, capacity, keep_ids).withColumn("shard", F.pmod("salt", F.lit(shards))))
    counts = cut_up.where(F.col("length") < capacity).groupBy("shard", "length").count()
    problems = counts.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", "count"))).alias("h"))  # at most `capacity` entries
    state = problems.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("h.length").alias("lengths"), F.col("h.count").alias("counts"), F.lit(None).cast("array<binary>").alias("population"), F.lit(None).cast("binary").alias("guest"))
    schema = "shard long, island int, lengths array<bigint>, counts array<bigint>, population array<binary>, elite binary, n_bins int"

    def epoch(k: int):
        def run(frames):
            for f in frames:
                out = []
                for r in f.itertuples(index=False):
                    length = np.repeat(np.array(r.lengths), np.array(r.counts))[::-1].tolist()
                    rng = np.random.default_rng([seed, int(r.shard), int(r.island), k])
                    population = [] if r.population is None else [_load(b) for b in r.population]
                    if r.guest is not None:
                        population.append(_load(r.guest))
                    population = evolve(population, length, capacity, generations, rng)
                    dumped = [_dump(b) for b in population]
                    out.append((r.shard, r.island, r.lengths, r.counts, dumped, dumped[0], len(population[0])))
                yield _frame(out)

        return run

    for k in range(epochs):
        evolved = state.repartition(partitions(docs.sparkSession), "shard", "island").mapInPandas(epoch(k), schema)  # by number, as rows are small and work is long
        if k + 1 < epochs:
            evolved = cut(evolved)
            guests = evolved.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("guest"))
            state = evolved.drop("elite", "n_bins").join(guests, ["shard", "island"])
    best = evolved.groupBy("shard").agg(F.min(F.struct("n_bins", "island", "elite")).alias("b")).select("shard", F.col("b.elite").alias("elite"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    result = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * keep_ids

    def place(key: tuple, t: pa.Table, b: pa.Table) -> pa.Table:
        """A shard's pieces by falling length are the items of its solution; full pieces fill sequences of their own."""
        length = t.column("length").to_numpy()
        order = np.lexsort((t.column("salt").to_numpy(), -length))
        full = int((length == capacity).sum())
        seq, off = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        seq[order[:full]] = np.arange(full)
        if b.num_rows:
            rest = order[full:]
            for k, items in enumerate(_load(b.column("elite")[0].as_py())):
                at = rest[items]
                seq[at], off[at] = full + k, np.concatenate([[0], np.cumsum(length[at])[:-1]])
        seq += int(key[0].as_py()) << 32
        cols = {n: t.column(n) for n in names if n in t.column_names} | {"sequence_id": pa.array(seq), "offset": pa.array(off)}
        return pa.table({n: cols[n] for n in names})

    return cut_up.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(place, result)


def _frame(rows: list):
    import pandas as pd

    return pd.DataFrame(rows, columns=["shard", "island", "lengths", "counts", "population", "elite", "n_bins"])
