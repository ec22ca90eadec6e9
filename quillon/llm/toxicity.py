"""Counterfactually regularised toxicity classifier.

Features say which hashed words and word beginnings a text has. Weights are fitted by proximal
AdaGrad on the logistic loss of a bounded, seeded sample of labelled rows (`max_rows` for each class,
which weigh the same), with an L1 term. In labelled texts that mention an identity group the terms, in four
languages, are swapped for others of their kind, and hidden; a quarter of all texts also get a neutral
mention; the squared change of the score's logit is penalised, so that the mention by itself doesn't
move a score. Texts of more than a million bytes are read in pieces. Fitting runs in one task; weights that aren't zero, at most `size` of
them, go to the tasks that score whole texts.

Defined cases: null text is empty, with the intercept's score; labels that are null are left out; a
document with several labels counts with each; with no labels, or labels of one class, all
scores are near that class (0 without labels); rows repeat as they are; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import gives_back, slices, small_batches
from .words import Words, groups

IDENTITY = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indian"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants", "tourists"),
    ("disabled", "deaf", "blind", "elderly", "young", "old"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "flüchtlinge", "einwanderer", "einheimische", "touristen"), ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"), ("behinderte", "gehörlose", "blinde", "senioren"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("étrangers", "réfugiés", "immigrés", "touristes"), ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"), ("handicapés", "sourds", "aveugles", "aînés"),
    ("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("extranjeros", "refugiados", "inmigrantes", "turistas"), ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"), ("discapacitados", "sordos", "ciegos", "ancianos"),
)
SIZE = 1 << 18


def features(texts: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), each once and in order; with weights, only features that have one. Long texts are read in pieces."""
    found = [np.zeros(0, np.int64)]
    for places, _, data in groups(texts):
        w = Words(data)
        doc = places[w.doc] if len(w.doc) else np.zeros(0, np.int64)
        parts = [(doc, w.hash(w.start, w.stop, 1))]
        for n in (4, 5, 6, 7, 8):
            long = np.flatnonzero(w.stop - w.start > n)
            parts.append((doc[long], w.hash(w.start[long], w.start[long] + n, 1 + n)))
        keys = []
        for d, h in parts:
            f = (h & np.uint64(SIZE - 1)).astype(np.int64)
            if weights is not None:
                d, f = d[weights[f] != 0], f[weights[f] != 0]
            keys.append(d * SIZE + f)
        found.append(np.unique(np.concatenate(keys)))
    key = np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]
    return (key // SIZE).astype(np.int32), (key % SIZE).astype(np.int32)


def swapped(texts: list[str], terms=IDENTITY) -> tuple[list[int], list[str]]:
    """Texts that mention identity terms, twice: each term swapped for the next of its kind, and each
    term hidden; and the texts' places."""
    following = {t: g[(i + 1) % len(g)] for g in terms for i, t in enumerate(g)}
    term = re.compile(r"\b(?:" + "|".join(sorted(following, key=len, reverse=True)) + r")\b", re.I)
    at, out = [], []
    for i, t in enumerate(texts):
        s = term.sub(lambda m: following[m.group().lower()], t)
        if s != t:
            at += [i, i]
            out += [s, term.sub("_", t)]
    return at, out


def mentions(texts: list[str], terms=IDENTITY, every: int = 4) -> tuple[list[int], list[str]]:
    """Some of the texts, by their bytes, with a neutral mention of an identity term at the end; and the texts' places.

    So that the mention itself is held neutral where the labelled texts have few mentions or none."""
    terms = [t for g in terms for t in g]
    at, out = [], []
    for i, t in enumerate(texts):
        h = zlib.crc32(t.encode("utf-8", "surrogatepass"))
        if terms and h % every == 0:
            at.append(i), out.append(f"{t} {terms[h // every % len(terms)]}")
    return at, out


class Sample:
    """Features of labelled texts and of their counterfactuals, gathered batch by batch; texts aren't kept."""

    def __init__(self, groups=IDENTITY):
        self.groups, self.n, self.pairs, self.swaps = groups, 0, 0, 0
        self.y: list = []
        self.rows: list = []  # for each batch: feature, and the bounds of each text in it
        self.changes: list = []  # for each batch: feature, +1 or -1, and the bounds of each pair

    def add(self, texts: list[str], y) -> None:
        doc, f = features(texts)
        self.y.append(np.asarray(y, np.float64))
        self.rows.append((f, np.searchsorted(doc, np.arange(len(texts) + 1))))
        at, changed = swapped(texts, self.groups)
        self.swaps += len(at)
        more, mentioned = mentions(texts, self.groups)
        at, changed = at + more, changed + mentioned
        self.n += len(texts)
        self.pairs += len(at)
        # a pair keeps only the features that one of its sides lacks
        keys = [d.astype(np.int64) * SIZE + x for d, x in (features([texts[i] for i in at]), features(changed))]
        gone, come = np.setdiff1d(*keys), np.setdiff1d(*keys[::-1])
        key = np.concatenate([gone, come])
        order = np.argsort(key, kind="stable")
        sign = np.repeat([1.0, -1.0], [len(gone), len(come)])[order]
        self.changes.append(((key[order] % SIZE).astype(np.int32), sign, np.searchsorted(key[order] // SIZE, np.arange(len(at) + 1))))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def logits(doc: np.ndarray, f: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=w[f], minlength=n)


def fit(sample: Sample, *, penalty: float = 4.0, l1: float = 3e-3, rounds: int = 80, rate: float = 0.3, shift: float = -0.5) -> tuple[np.ndarray, float]:
    """Weights and intercept, for classes of equal weight; shift is added to the intercept. A batch of texts at a time, so few copies are made."""
    n = sample.n
    y = np.concatenate(sample.y) if n else np.zeros(0)
    if not n or y.min() == y.max():
        share = float(y.mean()) if n else 0.0
        return np.zeros(SIZE), 30.0 if share == 1 else -30.0
    share = float(y.mean())
    each = 0.5 / n / np.array([1 - share, share])  # either class weighs half
    w, b, g2, gb2 = np.zeros(SIZE), 0.0, np.full(SIZE, 1e-8), 1e-8
    for _ in range(rounds):
        g, gb = np.zeros(SIZE), 0.0
        for (f, bounds), own in zip(sample.rows, sample.y):
            p = 1 / (1 + np.exp(-np.clip(sums(w[f], bounds) + b, -30, 30)))
            e = (p - own) * each[own.astype(int)]
            g += np.bincount(f, weights=np.repeat(e, np.diff(bounds)), minlength=SIZE)
            gb += e.sum()
        for f, sign, bounds in sample.changes:
            change = penalty / n * sums(w[f] * sign, bounds)
            g += np.bincount(f, weights=np.repeat(change, np.diff(bounds)) * sign, minlength=SIZE)
        g2 += g * g
        step = rate / np.sqrt(g2)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        gb2 += gb**2
        b -= rate * gb / np.sqrt(gb2)
    b += shift
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 3000, groups=IDENTITY, penalty: float = 4.0, seed: int = 3) -> tuple[np.ndarray, float]:
    """Fits on docs(doc_id, text) joined to labels(doc_id, toxic): at most max_rows of each class, by seeded hash."""
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if known.isEmpty():
        return np.zeros(SIZE), -30.0
    h = F.xxhash64(F.lit(seed), "doc_id", "toxic")
    some = [known.where(F.col("toxic") == c).orderBy(h, "doc_id").limit(max_rows) for c in (0, 1)]
    sample = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * max_rows rows of two numbers
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id").select("text", "toxic")

    def run(batches):
        sample = Sample(groups)
        for b in slices(batches):
            sample.add(b.column(0).to_pylist(), b.column(1).to_pylist())
        w, b = fit(sample, penalty=penalty)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()]), pa.array([w[at].astype("<f4").tobytes()]), pa.array([b])], names=["at", "w", "b"])

    r = rows.repartition(1).mapInArrow(gives_back(run), "at binary, w binary, b double").first()
    w = np.zeros(SIZE)
    if r is None:  # no labelled row has a document
        return w, -30.0
    w[np.frombuffer(bytes(r.at), "<i4")] = np.frombuffer(bytes(r.w), "<f4")
    return w, r.b


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs(text, ...) with score and predicted, whatever else docs has."""
    small_batches(docs.sparkSession)
    w, bias = model
    at = np.flatnonzero(w)
    values, place = w[at], docs.columns.index("text")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches):
        full = np.zeros(SIZE)
        full[at] = values
        for b in slices(batches):
            texts = [t or "" for t in b.column(0).field(place).to_pylist()]
            doc, f = features(texts, full)
            p = 1 / (1 + np.exp(-np.clip(logits(doc, f, full, len(texts)) + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["row", "score"])

    scored = row.mapInArrow(gives_back(run), StructType([*row.schema, StructField("score", DoubleType())]))
    return scored.select("row", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
